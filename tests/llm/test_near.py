"""The pipeline's near-dedup against brute force on whole shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import near

SCHEMA = "doc_id bigint, text string, node string"


def brute(pairs):
    """The texts that stay, by all pairs."""
    sets = [set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} for w in ((t or "").encode().lower().split() for _, t in pairs)]
    root = list(range(len(pairs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, p in enumerate(pairs):
        groups.setdefault(top(i), []).append(p)
    return sorted(min((i is None, i or 0) for i, _ in g) for g in groups.values())


@pytest.mark.parametrize(("part", "singly"), [(3, 16), (3, 1), (512, 2), (512, 16)])
def test_near_stage_is_whole(spark, sf, monkeypatch, part, singly):
    """Near copies at 0.8 and just below, chains, case, nulls, rows that share a doc_id; small parts cut the buckets."""
    monkeypatch.setattr(near, "PART", part)
    monkeypatch.setattr(near, "SINGLY", singly)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    pairs = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(8):
            pairs.append((len(pairs), " ".join(base)))
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = word()
    a, b = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(60))
    pairs += [(900, a), (900, b), (901, b + " tail"), (902, a.upper()), (903, None), (904, ""), (905, " \n"), (None, "x y"), (None, "X  y"), (None, word())]
    got = corpus_pipeline.near_stage(spark, spark.createDataFrame([(i, t, "x") for i, t in pairs], SCHEMA).repartition(3), sf)
    assert got.columns == ["doc_id", "text", "node"]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == brute(pairs)
    assert corpus_pipeline.near_stage(spark, got.limit(0), sf).count() == 0


def test_forest_connects_what_links_connect():
    rng = random.Random(11)
    for round_ in range(60):
        base = [rng.sample(range(400), 40) for _ in range(3)]
        sets = []
        for _ in range(rng.randint(2, 50)):
            b = list(rng.choice(base))
            for _ in range(rng.randint(0, 9)):
                b[rng.randrange(40)] = rng.randrange(400, 900)
            sets.append(np.unique(np.array(b, np.uint64)))
        labels = [rng.randrange(12) for _ in sets] if round_ % 2 else list(range(len(sets)))

        def merged(links, labels=labels, n=len(sets)):
            root = list(range(n))
            first = {}
            for k, x in enumerate(labels):
                root[k] = first.setdefault(x, k)
            for a, b in links:
                root = [root[a] if r == root[b] else r for r in root]
            return [root.index(r) for r in root]

        every = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
        assert merged(near.forest(sets, labels)) == merged(every)
