"""Exact top-k search by integer inner product, a block of documents at a time.

A vector's components x become the integers floor(256 * x), each a term with an impact; a negative query weight meets the
least impact instead of the largest. A shard orders its vectors so that like ones lie together (halved again and again at
the median of the component that spreads most) and cuts that order into ranges of BLOCK vectors, each with its forward
index, the vectors themselves, and its term maxima. A query orders the blocks by its summed term maxima, which no vector in
a block exceeds, and scores whole blocks from the highest bound on, until the bounds fall below the kth score found. At a
bound equal to that score a block still counts if it holds an id smaller than the kth's. The result is exact.

How many blocks that spares depends on the data: on clustered vectors most of them, on vectors that point evenly in all
of 64 directions none, and then each query is multiplied with each vector. Work grows with queries times vectors, as the
queries are a share of the table; shards and their streams are those of the sharded module.

Defined cases: null or empty vectors, and those that hold null or non-finite components, take no part, as query or
candidate; nor do rows without vec_id. Zero vectors do. Vectors of different dimensions are searched apart. With fewer
candidates than k all are returned. Ties go to the smaller vec_id. Repeated vec_ids are candidates each for itself; a
query's own vec_id is none. Rows that share a vec_id are queries of their own. Integers of any size are added up exactly;
a score beyond the range of a long counts as the end of that range. Other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import sharded

SCALE, BLOCK, K = 256, 64, 5
LONG = 2**63 - 1
#: Below this, sums of products are exact in double precision.
EXACT = 2**53


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x): as doubles where every inner product among such vectors is exact in them, else as Python's integers."""
    with np.errstate(over="ignore"):
        small = np.floor(vectors * SCALE)
    if vectors.shape[1] * max(1.0, np.abs(small).max(initial=0)) ** 2 < EXACT:
        return small
    return np.array([[floor(Fraction(x) * SCALE) for x in row] for row in vectors.tolist()], object).reshape(vectors.shape)


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as Python's integers if one is, or if their products could leave what doubles hold exactly."""
    big = a.dtype == object or b.dtype == object or a.shape[1] * max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) >= EXACT
    whole = lambda x: x if x.dtype == object else np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return (whole(a), whole(b)) if big else (a, b)


def clipped(score: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(score, -LONG - 1), LONG) if score.dtype == object else score


def like_together(x: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """An order of x's rows in which each range of size rows is narrow; equal rows stay in their order."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = x[rows]
        with np.errstate(over="ignore"):
            widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        rows = rows[np.argsort(part[:, widest], kind="stable")]
        half = size * max(1, len(rows) // size // 2)
        todo += [rows[half:], rows[:half]]  # the last one comes first
    return np.concatenate(out) if out else np.empty(0, int)


class Blocks:
    """A shard's vectors in blocks, and the best k for queries."""

    def __init__(self, k: int = K, size: int = BLOCK) -> None:
        self.k, self.size = k, size
        self.ids: list[np.ndarray] | np.ndarray = []
        self.parts: list[np.ndarray] = []
        self.x: np.ndarray | None = None
        self.scored = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids.append(ids)
        self.parts.append(vectors)

    def index(self) -> None:
        x, ids = np.concatenate(self.parts), np.concatenate(self.ids)
        order = like_together(x, self.size)
        self.x, self.ids = integers(x)[order], ids[order]
        starts = np.arange(0, len(x), self.size)
        self.high, self.low = np.maximum.reduceat(self.x, starts), np.minimum.reduceat(self.x, starts)
        self.least_id = np.minimum.reduceat(self.ids, starts)

    def answer(self, rows: np.ndarray, own: np.ndarray, queries: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        if not self.parts:
            return []
        if self.x is None:
            self.index()
        x, asked = alike(self.x, integers(queries))
        high, low = (self.high, self.low) if x is self.x else (self.high.astype(object), self.low.astype(object))
        bounds = clipped(np.maximum(asked, 0) @ high.T + np.minimum(asked, 0) @ low.T)
        out = []
        for k, q in enumerate(asked):
            ids, score = self.best(x, q, int(own[k]), bounds[k])
            out.append((np.full(len(ids), rows[k]), np.full(len(ids), own[k]), ids, score.astype(np.int64)))
        return out

    def best(self, x: np.ndarray, q: np.ndarray, own: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-bounds, kind="stable")
        ids, score = np.empty(0, np.int64), np.empty(0, x.dtype)
        at, step = 0, 1
        while at < len(order):
            blocks = order[at : at + step]
            if len(ids) == self.k:  # bounds fall, so none of the later blocks counts where the first of these does not, ids apart
                if bounds[blocks[0]] < score[-1]:
                    break
                blocks = blocks[(bounds[blocks] > score[-1]) | (bounds[blocks] == score[-1]) & (self.least_id[blocks] < ids[-1])]
            at, step = at + step, step * 2
            if not len(blocks):
                continue
            places = (blocks[:, None] * self.size + np.arange(self.size)).ravel()
            places = places[places < len(x)]
            places = places[self.ids[places] != own]
            self.scored += len(places)
            ids, score = np.concatenate([ids, self.ids[places]]), np.concatenate([score, clipped(x[places] @ q)])
            if len(ids) > self.k:
                floor_ = np.partition(score, len(score) - self.k)[len(score) - self.k] if score.dtype != object else sorted(score)[-self.k]
                near = score >= floor_
                ids, score = ids[near], score[near]
            top = np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[: self.k], int)
            ids, score = ids[top], score[top]
        return ids, score


def search(vectors: DataFrame, queries: Column, k: int = K, shard: int = sharded.SHARD) -> DataFrame:
    """vectors(vec_id, embedding); queries: the condition on vec_id. query_id, rank, vec_id, score."""
    return sharded.search(vectors, queries, sharded.finite(F.col("embedding")), k, shard, lambda: Blocks(k), "bigint")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5"""
