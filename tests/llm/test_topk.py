"""Exact top-k against brute force: ties, copies, tiny, huge and odd vectors, several shards and dimensions."""

import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, topk

TYPE = "vec_id bigint, embedding array<double>"


def brute(data, every=50, k=5):
    whole = {}
    for n, (i, v) in enumerate(data):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole[n] = i, [math.floor(Fraction(x) * 256) for x in v]
    out = []
    for i, q in whole.values():
        if i % every == 0:
            near = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in whole.values() if j != i and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(near, 1)]
    return sorted(out)


def found(df, **args):
    got = topk.search(df, F.col("vec_id") % 50 == 0, **args)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("shard", [16_384, 130])
def test_topk(spark, shard):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    x = centres[rng.integers(0, 6, 600)] + 0.1 * rng.standard_normal((600, 8))
    x[100:300:2] = x[50]  # copies of a query
    x[7] = 0
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (950, []), (1000, [float("nan")] * 8), (1050, [None] * 8), (1100, [0.5] * 3), (1150, [1.0] * 3), (None, [1.0] * 8), (1, x[1].tolist()), (50, x[50].tolist()), (1200, [0.0] * 8), (1250, [float("inf")] * 8)]
    df = spark.createDataFrame(data, TYPE).repartition(5)
    assert found(df, shard=shard) == brute(data)
    named = df.select("vec_id", "embedding", *[F.lit("x").alias(c) for c in ("row", "d", "shard", "kind", "score")])
    assert found(named, shard=shard) == brute(data)
    assert found(df.limit(0)) == [] and found(spark.createDataFrame(data[:4], TYPE)) == brute(data[:4])


def test_topk_of_huge_and_tiny_numbers(spark):
    data = [(0, [1e3, -1e-9]), (50, [1e30, 3.0]), (100, [1e308, -1e308]), (1, [-1e308, 1e308]), (2, [1e15, 7.0]), (3, [1e15, 8.0]), (4, [5e-324, -5e-324]), (5, [-1.0, 2**40 + 0.5])]
    assert found(spark.createDataFrame(data, TYPE)) == brute(data)


def test_blocks_are_spared_on_clustered_vectors_only():
    rng = np.random.default_rng(4)
    for centres, most in ((rng.standard_normal((40, 64)) / 8, 0.2), (np.zeros((40, 64)), 1.0)):
        x = centres[rng.integers(0, 40, 8_000)] + (0.02 if most < 1 else 0.125) * rng.standard_normal((8_000, 64))
        held = topk.Blocks()
        held.add(np.arange(8_000), x)
        got = held.answer(np.arange(100), np.arange(100), x[:100])
        whole = np.floor(x * 256)
        for k, (_, _, ids, _) in enumerate(got):
            score = whole @ whole[k]
            score[k] = -np.inf
            assert ids.tolist() == np.lexsort((np.arange(8_000), -score))[:5].tolist()
        assert held.scored <= most * 100 * 8_000


def test_topk_sql(spark, sf):
    want = duckdb.sql(topk.ORACLE.replace("FROM embeddings", f"FROM '{sf}/embeddings.parquet'")).fetchall()
    assert sorted(map(tuple, queries.op13_topk(spark, sf).collect())) == sorted(want) and want
