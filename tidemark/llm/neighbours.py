"""Approximate nearest neighbours by a hash-prefix forest: sorted arrays of hash strings, read from long to short prefixes.

A vector's hash string in a tree is the signs of its products with that tree's random directions, as bits from most to
least significant. A shard keeps, per tree, its vectors sorted by hash string. A query descends each tree by binary
search to the range that shares its longest prefix and then ascends all trees together, a bit at a time, until the
ranges hold VOTES places for each vector of the shard on average. What a candidate shares with the query over all trees,
each tree at that level and at each of the DEEPER ones below it being one vote, tells their angle, and with its length the product to expect; the SHARE of the
shard with the largest expectation, LEAST vectors at least, is scored exactly, ties with the last of it included.

Shards and their streams are those of the sharded module: a task builds a shard's forest once and then answers the queries.
Work grows with queries times vectors, as the queries are a share of the table; a forest makes the constant smaller.

Defined cases: null or empty vectors, and those that hold null or non-finite components or are zero, take no part, as
query or candidate; nor do rows without vec_id. Vectors of different dimensions are searched apart. With fewer
candidates than k all are returned. Ties go to the smaller vec_id. Repeated vec_ids are candidates each for itself; a
query's own vec_id is none. Every row that meets the condition is a query of its own: rows that share a vec_id have k
neighbours and ranks each. Other columns are not read; an empty table has no neighbours.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import sharded

TREES, DEPTH, VOTES, SHARE, SEED = 64, 20, 8, 0.25, 11
#: Levels below the common one whose shared bits count as votes, too, and the least number of candidates.
DEEPER, LEAST = 2, 1_024
#: How far above its expectation a product may lie, as a cosine: long vectors are looked at in spite of some doubt.
DOUBT = 0.3


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to a largest component of one, and what they were scaled by: squares neither vanish nor overflow."""
    size = np.abs(vectors).max(axis=1)
    return vectors / size[:, None], size


class Forest:
    """The sorted hash strings of a shard's vectors, which come in order of their ids."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> None:
        self.vectors, self.depth = vectors, depth
        unit, size = scaled(vectors)
        self.length = size * np.linalg.norm(unit, axis=1)
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((trees, vectors.shape[1], depth))
        self.strings, self.order = [], []
        for t in range(trees):
            codes = self.codes(unit, t)
            order = np.argsort(codes, kind="stable").astype(np.int32)
            self.strings.append(codes[order])
            self.order.append(order)

    def codes(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        bits = vectors @ self.directions[tree] > 0
        return (bits @ (1 << np.arange(self.depth - 1, -1, -1))).astype(np.int32)

    def ranges(self, queries: list[np.ndarray], level: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query and tree the range of strings that share the first level bits."""
        shift = self.depth - level
        lo, hi = [], []
        for strings, codes in zip(self.strings, queries, strict=True):
            prefix = codes >> shift << shift
            lo.append(np.searchsorted(strings, prefix))
            hi.append(np.searchsorted(strings, prefix + (1 << shift)))
        return np.array(lo).T, np.array(hi).T

    def candidates(self, queries: np.ndarray, wanted: int, votes: int = VOTES):
        """For each query its place and the places of its candidates, wanted at least unless there are fewer."""
        trees, n = len(self.strings), len(self.vectors)
        queries = scaled(queries)[0]
        codes = [self.codes(queries, t) for t in range(trees)]
        pending = np.arange(len(queries))
        for level in range(self.depth, -1, -1):
            lo, hi = self.ranges([c[pending] for c in codes], level)
            enough = (hi - lo).sum(axis=1) >= votes * n if level else np.ones(len(pending), bool)
            if enough.any():
                nested = [(lo, hi), *(self.ranges([c[pending] for c in codes], below) for below in range(level + 1, min(level + DEEPER, self.depth) + 1))]
                for k in np.flatnonzero(enough):
                    places = np.concatenate([self.order[t][a[k, t] : b[k, t]] for a, b in nested for t in range(trees)])
                    yield int(pending[k]), self.likely(np.bincount(places, minlength=n), level, wanted)
            pending = pending[~enough]
            if not len(pending):
                return

    def likely(self, seen: np.ndarray, level: int, wanted: int) -> np.ndarray:
        """The places of the largest products to expect, given the votes from level on."""
        if wanted >= len(seen):
            return np.arange(len(seen))
        # Two vectors at an angle of pi * (1 - p) share a bit with chance p, and levels as a geometric sequence has it.
        p = np.linspace(0.2, 0.9999, 512)
        mean = (p**level - p ** (min(level + DEEPER, self.depth) + 1)) / (1 - p)
        votes = np.arange(seen.max() + 1) / len(self.strings)
        expected = self.length * (np.cos(np.pi * (1 - np.interp(votes, mean, p))) + DOUBT)[seen]
        least = np.partition(expected, len(seen) - wanted)[len(seen) - wanted]
        return np.flatnonzero(expected >= least)


def usable(embedding: Column) -> Column:
    return sharded.finite(embedding) & F.exists(embedding, lambda x: x != 0)


class Shard:
    """A shard as it streams by: its vectors, then its queries."""

    def __init__(self, k: int, share: float) -> None:
        self.k, self.share = k, share
        self.ids: list[np.ndarray] = []
        self.parts: list[np.ndarray] = []
        self.forest: Forest | None = None

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids.append(ids)
        self.parts.append(vectors)

    def answer(self, rows: np.ndarray, own: np.ndarray, queries: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """(row, query_id, vec_id, score) of the best k of each query."""
        if not self.parts:
            return []
        if self.forest is None:
            self.all_ids, self.forest = np.concatenate(self.ids), Forest(np.concatenate(self.parts))
        ids, x, out = self.all_ids, self.forest.vectors, []
        for at, found in self.forest.candidates(queries, max(self.k + 1, LEAST, int(self.share * len(x)))):
            found = found[ids[found] != own[at]]
            score = x[found] @ queries[at]
            if len(found) > self.k:  # the matrix product's last digits depend on a row's place: take near ties, too
                least = np.partition(score, len(score) - self.k)[len(score) - self.k]
                if np.isfinite(least):
                    found = found[score >= least - 1e-9 * max(1.0, abs(least))]
            score = (x[found] * queries[at]).sum(axis=1)
            best = np.lexsort((ids[found], -score))[: self.k]
            out.append((np.full(len(best), rows[at]), np.full(len(best), own[at]), ids[found[best]], score[best]))
        return out


def search(vectors: DataFrame, queries: Column, k: int = 20, share: float = SHARE, shard: int = sharded.SHARD) -> DataFrame:
    """vectors(vec_id, embedding); queries: the condition on vec_id. query_id, rank, vec_id, score."""
    return sharded.search(vectors, queries, usable(F.col("embedding")), k, shard, lambda: Shard(k, share), "double")
