import random

import corpus_pipeline
import pytest
from textloom.llm import similar

WORDS = [f"Word{i}" for i in range(500)]


def near_copies():
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = rng.choices(WORDS, k=rng.randint(30, 300))
        for edits in (0, 0, 1, 1, 2, 3, 4, 5, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            texts.append(" ".join(copy))
    passage = " ".join(rng.choices(WORDS, k=40))
    texts += [f"{' '.join(rng.choices(WORDS, k=60))} {passage}" for _ in range(60)]
    return [*texts, "", None, " \n", "one two", "ONE  two", texts[5].upper()]


def kept_by_brute_force(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    n = len(sets)
    links = [(i, j) for i in range(n) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    label = list(range(n))
    for _ in range(n):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return sorted(set(label))


@pytest.mark.parametrize("large", [32, 2])
def test_near_dedup_stage_finds_every_pair(spark, monkeypatch, large):
    monkeypatch.setattr(similar, "LARGE", large)
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    assert kept == kept_by_brute_force(texts)
