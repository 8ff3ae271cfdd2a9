import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow.fs
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

from textloom.llm import components, media, mixing, omh, quality, shared, sharding, simhash, substring, tokens, warc


def test_simhash_against_brute_force(spark, docs, none):
    rows = simhash.groups(docs).collect()
    assert len(rows) == 12
    fps = [r.fp & (2**64 - 1) for r in rows]
    ids = [r.doc_id for r in rows]
    label = list(range(12))
    for _ in range(12):
        label = [min(label[j] for j in range(12) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(12)]
    for i, r in enumerate(rows):
        own = [x for x, y in zip(ids, label) if y == label[i] and x is not None]
        assert r.component_id == (min(own) if own else None)
    assert simhash.groups(none).count() == 0
    assert simhash.fingerprint(b"") == 0


def test_one_of_each_keeps_columns(docs, none):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 5, 6, 7, 8, 9, 10]
    assert simhash.one_of_each(none).count() == 0


def test_tiles_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 64, 8)]]))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    want = components.forest(*np.nonzero(close), len(fps))
    monkeypatch.setattr(simhash, "TILE", 7)
    u, v = simhash.tile_links(fps, None, 3)
    at = {x: i for i, x in enumerate(fps.tolist())}
    got = components.forest(np.array([at[x] for x in u.tolist()], int), np.array([at[x] for x in v.tolist()], int), len(fps))
    assert (got == want).all()
    monkeypatch.setattr(simhash, "CHUNK", 3)
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    pairs = simhash.links(table).toPandas()
    u, v = (np.array([at[int(np.int64(x).view(np.uint64))] for x in pairs[c]], int) for c in "uv")
    assert (components.forest(u, v, len(fps)) == want).all()


@pytest.mark.parametrize("small", [0, 10**6])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 103), (5, 5), (103, 100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 1000])
def test_permutation(n):
    p = sharding.Permutation(n)
    assert sorted(p.place(np.arange(n)).tolist()) == list(range(n))
    assert (p.row(p.place(np.arange(n))) == np.arange(n)).all()


def test_shards(docs, none):
    rows = sharding.shuffle(docs, shards=5).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert (r.shard, r.slot) == tuple(int(x[0]) for x in sharding.shard_and_slot(np.array([r.row]), 12, 5))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # row numbers are ranks by id, nulls first; the shuffle is the permutation of them
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in docs.collect())
    assert [(-1 if r.doc_id is None else r.doc_id) for r in sorted(rows, key=lambda r: r.row)] == ids
    place = sharding.Permutation(12).place(np.arange(12))
    assert {r.row: (r.shard, r.slot) for r in rows} == {i: (int(p) % 5, int(p) // 5) for i, p in enumerate(place)}
    by = {r.doc_id: r for r in rows}
    assert (by[3].size, by[3].text_crc32) == (16, 0) and by[10].text_crc32 == zlib.crc32(b"ab")
    assert sharding.shuffle(none).count() == 0


def encode(text):
    whole = tokenizers.Tokenizer.from_file(tokens.default_path())
    return whole.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    fast, _ = tokens.encoder(tokens.default_path())
    for t in ["", "Hello  world's\n\n 12,5 ß 日本 🎉", "a" * 5000, " " * 3000 + "x", "<|endoftext|> b", "\x00\x1c é"]:
        assert fast(t).tolist() == encode(t)


def test_balanced_packing(docs, none):
    rows = tokens.pack_balanced(docs, capacity=64, group_tokens=1 << 30).collect()
    used = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    texts = {r.doc_id: r.text for r in docs.where("doc_id <> 1").collect()}
    for key, text in texts.items():
        ids = encode(text) + [1]
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == key)
        assert [s for s, *_ in own] == np.cumsum([0, *(n for _, n, *_ in own)])[:-1].tolist()
        for start, n, crc, total in own:
            assert total == len(ids) and crc == zlib.crc32(struct.pack(f"<{n}I", *ids[start : start + n]))
    total = sum(r.length for r in rows)
    assert len(used) == -(-total // 64) and max(r.length for r in rows) <= 32
    assert tokens.pack_balanced(none).count() == 0


def test_balance_is_by_cost():
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.lognormal(5.5, 1, 4000).astype(int) + 1, 1024)
    cost, used = collections.Counter(), collections.Counter()
    placed = tokens.balance(lengths, 2048, 1.0, 1 / 2048)
    for _, _, n, s, offset in placed:
        assert offset == used[s]
        used[s] += n
        cost[s] += n + n * n / 2048
    assert max(used.values()) <= 2048 and sum(used.values()) == lengths.sum() and len(used) == -(-lengths.sum() // 2048)
    values = np.array(list(cost.values()))
    assert np.std(values) < 0.05 * values.mean()
    # until nothing fits, each piece goes to the cheapest sequence with room for it
    n, room, sums = len(used), [2048] * len(used), [0.0] * len(used)
    for i, begin, take, s, _ in placed:
        fits = [x for x in range(n) if room[x] >= lengths[i]]
        if begin or not fits:
            break
        assert s == min(fits, key=lambda x: (sums[x], x))
        room[s] -= take
        sums[s] += take + take * take / 2048


def test_encoder_equals_the_library_on_any_text():
    fast, _ = tokens.encoder(tokens.default_path())
    rng = np.random.default_rng(6)
    points = [c for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    for _ in range(150):
        t = "".join(chr(c) for c in rng.choice(points, 40)) + "".join(rng.choice(list(" \n\t a1'.é日\u00a0\u2003s"), 40))
        assert fast(t).tolist() == encode(t)
    for at in range(0, len(points), 64):
        t = " ".join(chr(c) for c in points[at : at + 64])
        assert fast(t).tolist() == encode(t)


def test_matrices_round_trip(spark, docs, none):
    folder = shared.folder(spark, "test")
    rows = tokens.pack_matrices(docs, capacity=128, directory=folder).collect()
    got = collections.defaultdict(dict)
    for r in rows:
        _, base = shared.filesystem(folder)
        matrix = np.load(f"{base}/{r.file}")
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        for key, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            got[key][start] = matrix[r.row, a:b].tolist()
        assert (matrix[r.row, r.n_tokens :] == 50256).all()
    for r in docs.collect():
        assert sum((got[r.doc_id][s] for s in sorted(got[r.doc_id])), []) == encode(r.text) + [1]
    assert tokens.pack_matrices(none).count() == 0


def test_best_fit_against_brute_force():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 65, 300))[::-1]
    room = []
    for n, s in zip(lengths.tolist(), tokens.best_fit(lengths, 64)):
        fits = [x for x in room if x >= n]
        if s == len(room):
            assert not fits
            room.append(64)
        else:
            assert room[s] == min(fits)
        room[s] -= n


def test_substring_against_brute_force(docs, none, monkeypatch):
    for window, wide in ((35, 400), (3, 400), (3, 1)):
        monkeypatch.setattr(substring, "WIDE", wide)
        rows = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
        counts = collections.Counter(tuple(w[i : i + window]) for _, w in rows for i in range(len(w) - window + 1))
        want = {}
        for key, w in rows:
            cut = {i + j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(window)}
            want[key] = (len(w), len(cut), b" ".join(x for i, x in enumerate(w) if i not in cut).decode())
        done = substring.deduplicate(docs, window)
        assert done.count() == 12
        assert done.columns == [c for c in docs.columns if c != "n_removed"] + ["kept_text", "n_words", "n_removed", "spans"]
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in done.collect()} == want
    assert substring.deduplicate(none).count() == 0


def test_a_phrase_in_most_texts(spark, monkeypatch):
    """A shared phrase with other words around it each time, copies, and near copies: anchors of many segments at every level."""
    monkeypatch.setattr(substring, "WIDE", 8)
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in range(300)]
    phrase = " ".join(f"c{i}" for i in range(12))
    texts = [f"{' '.join(rng.choice(words, 15))} {phrase} {' '.join(rng.choice(words, 15))}" for _ in range(60)]
    texts += texts[:10] + [t + " tail" for t in texts[5:12]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [t.split() for t in texts]
    counts = collections.Counter(tuple(w[i : i + 20]) for w in rows for i in range(len(w) - 19))
    want = {k: " ".join(x for i, x in enumerate(w) if not any(counts[tuple(w[s : s + 20])] > 1 for s in range(max(0, i - 19), min(i, len(w) - 20) + 1))) for k, w in enumerate(rows)}
    assert {r.doc_id: r.kept_text for r in substring.deduplicate(docs, 20).collect()} == want


def test_automaton_counts():
    sa = substring.SuffixAutomaton()
    sa.add([1, 2, 3, 1, 2], 1)
    sa.add([1, 2, 4], 1)
    sa.finish()
    assert sa.repeated([1, 2, 4], 2) == [0] and sa.repeated([2, 3, 1], 2) == []


def test_media(spark, docs, none):
    rows = media.media_columns(docs).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    for r in docs.where("doc_id IS NOT NULL").collect():
        data = (r.text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        got = by[r.doc_id]
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert media.media_columns(none).count() == 0


def test_media_retries_by_member(spark, docs):
    folder = shared.folder(spark, "broken")
    archive = media.write_archives(docs, folder).first().archive
    _, path = shared.filesystem(archive)
    data = bytearray(open(path, "rb").read())
    at = data.index(b"IDAT")
    data[at + 6] ^= 255
    open(path, "wb").write(data)
    rows = media.read_archives(spark, folder, splitBytes="700", retries="2").collect()
    bad = [r for r in rows if r.error]
    assert len(rows) == 12 and len(bad) == 1 and bad[0].attempts == 3 and all(r.attempts == 1 for r in rows if not r.error)


def test_warc(spark, none):
    big = "y" * 2000
    rows = [(1, "u1", big, "x"), (7, "u7", big, "x"), (3, None, "small", "x"), (4, "u4", "small", "x"), (5, "u\n5", None, "x"), (None, "n", big, "x"), (7, "u7", big, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset string")
    got = warc.deduplicate(pages).collect()
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == {(1, "revisit", 7, 2000): 1, (7, "revisit", 7, 2000): 1, (7, "response", None, 2000): 1, (None, "revisit", 7, 2000): 1, (3, "response", None, 5): 1, (4, "response", None, 5): 1, (5, "response", None, 0): 1}
    assert {r.payload_digest for r in got if r.payload_bytes == 2000} == {hashlib.sha1(big.encode()).hexdigest()}
    assert warc.deduplicate(pages.limit(0)).count() == 0


def test_a_late_second_attempt_writes_the_same_archive(spark):
    folder = shared.folder(spark, "attempts")
    date, seen = warc.now(), []
    for _ in range(2):
        writer = warc.Writer(folder, 3)
        places = [writer.add(warc.record(warc.fresh(writer.record_id(), date, "response", i, f"u{i}", 2, "d"), b"ab")) for i in range(5)]
        writer.close()
        fs, base = shared.filesystem(folder)
        with fs.open_input_file(f"{base}/{places[0][0]}") as f:
            seen.append((places, f.read()))
    assert seen[0] == seen[1] and len(fs.get_file_info(pyarrow.fs.FileSelector(base))) == 1


def test_shared_root_is_a_uri(spark):
    assert shared.root(spark).startswith("file:///")


def test_warc_joins_old_revisits(spark):
    head = [("a", 0, 9, 1, "u", 50, "d", "response", None, None), ("a", 9, 9, 2, "u", 50, "d", "revisit", None, None), ("a", 18, 9, 3, "u", 50, "e", "revisit", None, None)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.resolve(spark.createDataFrame(head, warc.HEADER)).collect()}
    assert got == {1: ("response", None), 2: ("revisit", 1), 3: ("revisit", None)}


def plain_entries(text):
    """Order MinHash of a text by its definition: tuples of (k-mer, occurrence) in text order; None without a word."""
    long = lambda x: (x & (2**64 - 1)).to_bytes(8, "little")
    digest = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    high = lambda x: (x >> 32) - (1 << 32 if x >> 63 else 0)  # noqa: E731  Spark shifts with the sign
    words = [digest(w.encode()) for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    grams = [high(digest(long(y), digest(long(x)))) for x, y in zip(words, words[1:])] if len(words) > 1 else [high(digest(long(x))) for x in words]
    seen, members = collections.Counter(), []
    for at, g in enumerate(grams):
        members.append((high(digest(seen[g].to_bytes(4, "little"), digest(long(g)))), at))
        seen[g] += 1
    least = lambda j: min((high(digest(j.to_bytes(4, "little"), digest(long(m)))), at) for m, at in members)
    if not members:
        return None
    return [tuple(h for _, h in sorted((at, h) for h, at in (least(j), least(j + 1)))) for j in range(0, omh.ENTRIES * omh.TUPLE, 2)]


def plain_likeness(a, b):
    a, b = plain_entries(a), plain_entries(b)
    return float(a == b) if a is None or b is None else sum(map(tuple.__eq__, a, b)) / omh.ENTRIES


def test_omh_against_brute_force(docs, none, spark):
    rows = omh.fingerprint_edits(docs).collect()
    assert len(rows) == 12
    table = sorted(((r.doc_id if r.doc_id is not None else -(2**63), r.text or "") for r in docs.collect()), reverse=True)
    order = [t for _, t in table]
    got = sorted(rows, key=lambda r: -(2**63) if r.doc_id is None else r.doc_id, reverse=True)
    assert [r.n_chars for r in got] == [len(t) for t in order]
    prints = {}
    for i, r in enumerate(got):
        text, other = order[i], order[(i + 1) % len(order)]
        k = len(text) // 3
        changed = text[: len(text) - k] + other[:k]
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == plain_likeness(text, changed) and r.near_next == plain_likeness(text, other)
        for f, t in ((r.fingerprint, text), (r.edited_fingerprint, changed)):
            e = plain_entries(t)
            assert prints.setdefault(f, e) == e  # equal fingerprints just for equal entries
    assert omh.fingerprint_edits(none).count() == 0
    alone = omh.fingerprint_edits(docs.where("doc_id = 10")).first()
    assert alone.near_next == 1.0


def test_omh_follows_order_and_occurrence(spark):
    a = " ".join(f"a{i} b{i}" for i in range(400))
    words = a.split()
    moved = " ".join(words[400:] + words[:400])
    texts = [(0, a), (1, moved), (2, "same words " * 20), (3, "same words " * 200), (4, a)]
    e = {r.n: r.e for r in omh.fingerprints(spark.createDataFrame(texts, "n int, text string"), ["n"], "text").collect()}
    like = lambda x, y: sum(map(int.__eq__, e[x], e[y])) / omh.ENTRIES
    assert like(0, 4) == 1.0 and like(0, 1) < 0.8  # the same k-mers in another order are not the same
    assert like(2, 3) < 0.5  # nor are ten times as many


def test_omh_pairs_as_single_texts(spark):
    a = " ".join(f"w{i}" for i in range(40))
    pairs = [(a, a), (a, a[:90] + " other end"), (a, "nothing alike"), ("x " * 30, "x " * 20 + "y x x"), ("", a), (a, ""), ("", ""), ("  ", None), ("one", "one two"), ("a b a b", "b a b a")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "n int, text string, other string")
    both = {(r.n, r.side): r.e for r in omh.fingerprints_of_pairs(rows, ["n"], "text", "other").collect()}
    assert both == {(r.n, side): r.e for side, c in enumerate(("text", "other")) for r in omh.fingerprints(rows, ["n"], c).collect()}


def test_omh_selects_shared_kmers_once(spark):
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(90))) for i in range(200)]
    found = omh.fingerprint_edits(spark.createDataFrame(texts, "doc_id long, text string").repartition(2))
    assert found.count() == len(found.collect()) == 200

    def generated(plan):
        plan = plan.plan() if plan.getClass().getSimpleName() == "ResultQueryStageExec" else plan
        own = [plan.metrics().apply("numOutputRows").value()] if plan.getClass().getSimpleName() == "GenerateExec" else []
        return sum((generated(plan.children().apply(i)) for i in range(plan.children().size())), own)

    ghosts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # one a bucket at most
    most = max(generated(found._jdf.queryExecution().executedPlan().executedPlan()))
    # a third of the edited text is new, with the k-mers across the edge; all of both texts would be 400 * 89
    assert 200 * 89 < most <= 200 * (89 + 36) + ghosts * 91


def test_mixing(spark, docs, none):
    labels = spark.createDataFrame([(1, "high"), (2, "high"), (7, "low"), (8, "low"), (None, "high"), (5, "odd")], "doc_id long, domain string")
    plan = mixing.mixed(docs, labels, {"high": 0.5, "low": 0.5})
    rows = plan.collect()
    assert len(rows) == 12 and all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 for r in rows)
    assert all(r.rate == 1 for r in rows if not r.n_tokens)
    applied = mixing.mixture(docs, labels, {"high": 0.5, "low": 0.5})
    assert applied.columns == docs.columns
    want = collections.Counter()
    for r in rows:
        want[r.doc_id] += r.copies
    assert collections.Counter(r.doc_id for r in applied.collect()) == +want
    assert mixing.mixed(none, labels, {"high": 1.0}).count() == 0 and mixing.mixture(none, labels, {"high": 1.0}).count() == 0
    assert mixing.mixed(docs, labels.limit(0), {"high": 0.5, "low": 0.5}).count() == 12


def test_posteriors_against_plain_softmax(spark):
    """Posteriors of the rows equal softmax of prior and weights summed over distinct features, computed in numpy."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice([f"g{j}" for j in range(40)] if i % 3 else [f"b{j}" for j in range(40)], 30)) + f" w{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "high" if i % 3 else "low") for i in range(0, 300, 2)], "doc_id long, domain string")
    model = mixing.train(docs, labels, ["high", "low"])
    digest = lambda w, seed=None: np.int64(np.uint64(xxhash.xxh64_intdigest(w.encode(), 42) if seed is None else xxhash.xxh64_intdigest((3).to_bytes(4, "little"), xxhash.xxh64_intdigest(w.encode(), 42))))
    got = {r.doc_id: r.p for r in mixing.mixed(docs, labels, {"high": 0.5, "low": 0.5}).collect()}
    for key, text in rows:
        own = {int(digest(w)) % mixing.WORDS for w in text.split()} | {mixing.WORDS + int(digest(w[-3:], 3)) % mixing.ENDINGS for w in text.split()}
        z = model.prior + model.trust * model.weights[sorted(own)].sum(axis=0)
        e = np.exp(z - z.max())
        assert np.allclose(got[key], e / e.sum(), atol=1e-4)
    assert np.mean([(got[i][0] > 0.5) == bool(i % 3) for i in range(1, 300, 2)]) > 0.95


def plain_rates(n, p, share, steps=20000):
    """Plain projected gradient on the squared residuals, from rates of 1, with a small fixed step."""
    r, target = np.ones(len(n)), share * ((n[:, None] * p).sum(axis=0)[np.argmax(share)] / share.max())
    a = (n[:, None] * p).T / n.sum()
    for _ in range(steps):
        r = np.maximum(0, r - 0.9 / np.linalg.norm(a, 2) ** 2 * (a.T @ (a @ r - target / n.sum())))
    return a @ r * n.sum(), target


@pytest.mark.parametrize("alpha, share", [([0.3, 0.3, 0.3], [0.7, 0.2, 0.1]), ([1.6, 0.2, 0.2], [0.98, 0.01, 0.01]), ([2.0, 2.0, 2.0], [0.5, 0.3, 0.2])])
def test_rates_against_plain_projected_gradient(spark, alpha, share):
    rng = np.random.default_rng(2)
    p, n = rng.dirichlet(alpha, 300), rng.integers(1, 900, 300)
    want, target = plain_rates(n.astype(float), p, np.array(share))
    soft = spark.createDataFrame([(int(x), [float(y) for y in v]) for x, v in zip(n, p)], "n_tokens long, p array<double>")
    rate, report = mixing.fit_rates(soft, share)
    assert np.allclose(report["targets"], target)
    # it comes at least as near to the targets as many steps of the plain method
    assert np.abs(np.array(report["reached"]) - target).max() <= max(2e-4 * target.sum(), 1.01 * np.abs(want - target).max())
    r = np.array([x.r for x in soft.select(rate.alias("r")).collect()])
    assert (r >= 0).all() and abs(np.abs((n * r) @ p - target).max() / target.sum() - report["miss"]) < 1e-6


def test_a_fit_that_misses_says_so(spark):
    soft = spark.createDataFrame([(100, [1.0, 0.0])] * 5, "n_tokens long, p array<double>")
    _, report = mixing.fit_rates(soft, [0.5, 0.5])
    assert report["miss"] > 0.1


def test_quality(spark, docs, none):
    rows = [(i, "plain words stand here in order " * 3 if i % 5 else "$$$ %%% ### &&& " * 6) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = table.select("doc_id", (F.col("doc_id") % 5 != 0).cast("int").alias("quality"))
    weights = quality.train(table, labels, positives=200, unlabelled=400)
    scored = quality.scored(table, weights).collect()
    right = np.mean([(r.score >= 0.5) == bool(r.doc_id % 5) for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 == 2])
    assert right > 0.95
    assert quality.scored(docs, weights).count() == 12
    prior = quality.train(none, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, prior).collect())
    assert quality.scored(none, prior).count() == 0


def test_fit_never_sees_held_out_labels(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    one = rows.select("doc_id", F.lit(1).alias("quality"))
    other = rows.select("doc_id", F.when(held, 0).otherwise(1).alias("quality"))
    assert np.allclose(quality.train(rows, one), quality.train(rows, other), rtol=1e-3, atol=1e-4)
