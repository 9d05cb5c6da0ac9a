"""Rows that share a vec_id are queries of their own."""

import collections

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import neighbours


def test_repeated_query_rows(spark):
    x = np.random.default_rng(7).standard_normal((300, 16))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 3 + [(20, x[21].tolist())]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, share=1.0, shard=100).collect():
        got[r["query_id"], r["rank"]].append(r["vec_id"])
    ids, y = np.array([i for i, _ in data]), np.array([v for _, v in data])
    for q in range(0, 300, 20):
        want = []
        for v in y[ids == q]:
            found = np.flatnonzero(ids != q)
            want.append(ids[found[np.lexsort((ids[found], -(y[found] * v).sum(axis=1)))[:20]]].tolist())
        for rank in range(1, 21):
            assert sorted(got[q, rank]) == sorted(w[rank - 1] for w in want)


def test_tiny_and_huge_vectors_take_part(spark):
    """Squares of components vanish or overflow in double precision; the vectors are still no zero vectors."""
    data = [(20, [1e-170, 2e-170]), (1, [3.0, 4.0]), (2, [1e-300, -1e-300]), (3, [0.0, 0.0]), (4, [1e200, 1e200]), (40, [-1e200, 1e200])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[20] == [4, 40, 1, 2] and set(got[40]) == {1, 2, 4, 20}
