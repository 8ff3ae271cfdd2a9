"""The near-dedup stage gets its pairs from SimHash fingerprints: blocks, tiles and bit counts against brute force, and recall at the threshold."""

import random
import tracemalloc
from itertools import combinations

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from textloom.llm import similar, simhash

MASK = np.uint64((1 << similar.BITS) - 1)


def prints(rng, n, words=similar.WORDS):
    """Fingerprints in families: members differ from the first one in few bits, or in many."""
    out = []
    while len(out) < n:
        base = rng.integers(0, 1 << 64, words, dtype=np.uint64)
        for share in (0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4):
            flips = np.packbits(rng.random((words, 64)) < share, axis=1, bitorder="little").view(np.uint64)[:, 0]
            out.append(base ^ flips)
    return np.array(out[:n])


def may_meet(a, b):
    """Whether two fingerprints share a block and are within the radius."""
    differ = a ^ b
    shared_block = any(((differ >> np.uint64(similar.BITS * k)) & MASK == 0).any() for k in range(64 // similar.BITS))
    return shared_block and np.bitwise_count(differ[:2]).sum() <= similar.RADIUS


@pytest.mark.parametrize(("chunk", "large"), [(8192, 16), (4, 16), (8192, 2), (4, 2)])
def test_meetings_against_brute_force(spark, monkeypatch, chunk, large):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    fps = prints(np.random.default_rng(7), 64)
    fps[40:52] = fps[40] ^ np.arange(12, dtype=np.uint64)[:, None] << np.uint64(61)  # a crowd in most buckets
    n = [100 if k % 3 else 90 for k in range(64)]
    n[1] = 10  # too small to be similar to any
    rows = [(k, n[k], [int(x) for x in fps[k].view(np.int64)]) for k in range(64)]
    table = spark.createDataFrame(rows, "node long, n int, fp array<long>")
    met = simhash.meetings(table, similar.BITS, similar.RADIUS, similar.CLOSE, 0.8, large).collect()
    listed = {(r.u, r.v) for r in met if r.kind == 0}
    crowds = {}
    for r in met:
        if r.kind == 1:
            assert r.n == n[r.v] and [r.a, r.b] == rows[r.v][2][:2]
            crowds.setdefault(r.u, set()).add(r.v)
    again = {p for c in crowds.values() for p in combinations(sorted(c), 2)}
    wanted = {(i, j) for i, j in combinations(range(64), 2) if 1 not in (i, j) and may_meet(fps[i], fps[j])}
    assert listed and listed <= wanted <= listed | again
    assert sum(len(c) for c in crowds.values()) < 64 * 100


def test_wide_fingerprints():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 254, 255, 256, 7000):
        hashes = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        found = simhash.wide(hashes, 5)
        assert len(found) == 5 and int(found[0]) == simhash.majority(hashes)
        assert n < 255 or len(set(found.tolist())) == 5


@pytest.mark.parametrize(("n", "m", "both"), [(4, 5, 4), (9, 9, 8), (90, 90, 80), (400, 500, 400)])
def test_pairs_at_the_threshold_meet(n, m, both):
    rng, met = np.random.default_rng(n), 0
    for _ in range(1000):
        hashes = rng.integers(0, 1 << 64, n + m - both, dtype=np.uint64)
        met += may_meet(simhash.wide(hashes[:n], similar.WORDS), simhash.wide(hashes[n - both :], similar.WORDS))
    assert met >= 998


def test_stage_takes_its_pairs_from_fingerprints(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(base).upper(), "one two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = lambda: sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    assert kept() == [0, 3]
    meetings = simhash.meetings
    monkeypatch.setattr(simhash, "meetings", lambda *args: meetings(*args).limit(0))
    assert kept() == [0, 1, 3]  # texts with equal shingles alone


def test_a_large_group_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(5)
    base, texts = [f"w{rng.randrange(900)}" for _ in range(150)], []
    for k in range(120):
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(len(copy))] = f"new{rng.random()}"
        texts.append(" ".join(copy))
    sets = [set(similar.shingle_set(t).tolist()) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i, j in combinations(range(len(texts)), 2):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    assert kept == sorted(set(label))


def test_dense_texts_leave_few_rows(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 64, similar.WORDS, dtype=np.uint64)
    flips = np.packbits(rng.random((80, similar.WORDS, 64)) < 0.1, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    sketches = rng.integers(-(1 << 62), 1 << 62, (80, 16))  # none allows a link, but for one pair
    sketches[7] = sketches[5]
    rows = [(k, 100, [int(x) for x in (base ^ flips[k]).view(np.int64)], True, k, sketches[k].tolist()) for k in range(80)]
    table = spark.createDataFrame(rows, "node long, n int, fp array<long>, dense boolean, component long, sketch array<long>")
    asked = (similar.BITS, similar.RADIUS, similar.CLOSE, 0.8, similar.LARGE)
    assert {(r.kind, r.u, r.v) for r in simhash.meetings(table, *asked).collect()} == {(0, 5, 7)}
    marks = simhash.meetings(table.select("node", "n", "fp"), *asked, 0, 10, 4).where("kind = 2").collect()
    assert {r.v for r in marks}


def test_a_crowd_is_compared_in_bounded_memory(monkeypatch):
    k, rng = 2048, np.random.default_rng(11)
    flips = np.packbits(rng.random((k, 2, 64)) < 0.13, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    fp = (rng.integers(0, 1 << 64, 2, dtype=np.uint64) ^ flips).view(np.int64)
    sketches = rng.integers(-(1 << 62), 1 << 62, (k, 16))
    sketches[1::64] = sketches[1]  # texts that may be similar
    rows = pd.DataFrame({"bucket": 40 << similar.BITS, "i": 0, "j": 0, "c": 0, "node": np.arange(k), "n": 100, "a": fp[:, 0], "b": fp[:, 1], "dense": np.arange(k) % 64 < 60, "component": np.arange(k)})
    rows["sketch"] = [s if d else None for s, d in zip(sketches, rows.dense)]
    meet = simhash._meet(similar.BITS, similar.RADIUS, similar.CLOSE, 0.8, similar.LARGE, similar.DENSE)
    tracemalloc.start()
    found = meet(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and set(found.kind) == {0, 1, 2}
    for pairs in (1 << 30, 999):
        monkeypatch.setattr(simhash, "PAIRS", pairs, raising=False)
        assert meet(rows).equals(found)
