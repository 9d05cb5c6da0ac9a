"""Searches of some rows' vectors against all: vectors dealt into shards of bounded size, every query sent to every shard.

Shards are dealt by a hash of the row, so no vector is left out and no value of a vector makes a shard large. A task reads
a shard's vectors first, as they stream by in order of their ids, and then answers the queries in blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.util import shuffle_width

SHARD, BLOCK = 16_384, 1_024


class Shard(Protocol):
    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None: ...

    def answer(self, rows: np.ndarray, own: np.ndarray, queries: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """(row, query_id, vec_id, score) of the best k of each query."""


def finite(embedding: Column) -> Column:
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def search(vectors: DataFrame, queries: Column, usable: Column, k: int, shard: int, make: Callable[[], Shard], score: str) -> DataFrame:
    """vectors(vec_id, embedding); queries, usable: conditions on their rows. query_id, rank, vec_id, score (of the type named)."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), queries.alias("asked"), "embedding", F.size("embedding").alias("d"), F.monotonically_increasing_id().alias("row"))
    good = good.where(F.col("vec_id").isNotNull() & usable)
    shards = good.groupBy("d").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = good.join(shards, "d")
    own = F.pmod(F.xxhash64("vec_id", "row"), F.col("shards")).cast("int")
    points = dealt.select("d", own.alias("shard"), F.lit(0).alias("kind"), "row", "vec_id", "embedding")
    asked = dealt.where("asked").select("d", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), "row", "vec_id", "embedding")
    streamed = points.unionByName(asked).repartition(shuffle_width(vectors.sparkSession), "d", "shard").sortWithinPartitions("d", "shard", "kind", "vec_id")
    kind_of_score = pa.float64() if score == "double" else pa.int64()

    def answer(batches):
        key, held = None, make()
        for batch in batches:
            if not batch.num_rows:
                continue
            d, number, kind, row, vec_id = (batch[c].to_numpy() for c in ("d", "shard", "kind", "row", "vec_id"))
            flat, starts = batch["embedding"].values.to_numpy().astype(np.float64), batch["embedding"].offsets.to_numpy()
            fresh = np.flatnonzero((np.diff(d) != 0) | (np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            bounds = np.unique(np.r_[0, fresh, np.arange(0, len(d), BLOCK), len(d)])
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if (d[lo], number[lo]) != key:
                    key, held = (d[lo], number[lo]), make()
                part = flat[starts[lo] : starts[hi]].reshape(hi - lo, -1)
                if kind[lo] == 0:
                    held.add(vec_id[lo:hi].copy(), part.copy())
                elif found := held.answer(row[lo:hi], vec_id[lo:hi], part):
                    cols = [np.concatenate(c) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:3]), pa.array(cols[3], kind_of_score)], ["row", "query_id", "vec_id", "score"])

    answers = streamed.mapInArrow(answer, f"row bigint, query_id bigint, vec_id bigint, score {score}")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
