"""Suffix-array dedup: remove every byte that a repeated 200-byte string covers.

Within a text, names double: the name of 2h bytes at a place is made of the names of h bytes at that place and h
further on, up to the threshold. Between texts Spark reranks, and at each offset the places that are unique leave:

1. Each window of the threshold's length is ranked by the least name of its 64-byte substrings, so equal windows have
   equal ranks, and neighbouring windows that owe their rank to the same place are one run. Ranks that occur once leave.
2. The runs left are reranked by their whole content. A run whose content occurs again is repeated window by window.
3. Where one rank has runs of different content, a run is split by how far its windows begin before the ranking place,
   and the parts are reranked by the 184 bytes that all of a part's windows share.
4. The windows of the parts left are reranked at the full threshold.

So a row stands for many places, about one for 65 bytes instead of one a byte. Ranks of the first step are 64-bit names,
which only filter; those that decide are 128-bit digests of the bytes themselves.

What a slice of a batch shows already is not asked of Spark: of equal content in it one row (r = 0) goes where the content
is counted, and the others, which are repeated for certain, anywhere. The same holds of several contents under one
rank. So a passage that a third of all texts share puts one row a slice, not one a text, into the task that counts it.

Texts are stored once per distinct text, bucketed by a 128-bit key, so that later steps join to them without moving them
again; the table that this needs is dropped when the result is written.

Defined cases: null counts as empty. Texts shorter than the threshold lose nothing. Matches may overlap and may lie in
one text; they never cross texts. Copies of a text of the threshold's length or more lose everything. Spans are cut on
bytes, so what is kept need not be whole characters. Null doc_id and repeated rows count as documents of their own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.util import cut, fresh_path, shuffle_width

LENGTH, GRAM = 200, 64
#: Windows of a part of a run.
PART = 17
#: Bytes whose names a task computes at once; places within them fit in PLACE bits.
SEGMENT, PLACE = 1 << 17, 18
#: Bytes of text, and rows, that a task turns into rows at once.
SLICE, ROWS = 1 << 22, 50_000


def pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit name of each pair of names."""
    z = left * np.uint64(0x9E3779B97F4A7C15)
    z += right
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    return z


def gram_names(data: np.ndarray) -> np.ndarray:
    """The name of the GRAM bytes at each place, by doubling."""
    names = pair_names(data.astype(np.uint64), np.full(len(data), 0x94D049BB133111EB, np.uint64))
    h = 1
    while h < GRAM:
        names = pair_names(names[:-h], names[h:])
        h *= 2
    return names


def owners(names: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of length bytes the place of its least name, the leftmost of equal ones."""
    width = length - GRAM + 1
    least = (names >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(names), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    return (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)


def segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, start, bytes) of SEGMENT bytes or so; long texts in parts that overlap by a window less a byte."""
    group, size = [], 0
    for k, text in enumerate(texts):
        for start in range(0, max(1, len(text) - length + 1), SEGMENT):
            part = text[start : start + SEGMENT + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > SEGMENT + length:
                yield group
                group, size = [], 0
            group.append((k, start, part))
            size += len(part)
    if group:
        yield group


def runs(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(text, first window, windows, ranking place, rank, digest of the bytes that the windows cover)."""
    for group in segments(texts, length):
        data = b"".join(part for _, _, part in group)
        names = gram_names(np.frombuffer(data, np.uint8))
        owner = owners(names, length)
        base = 0
        for k, start, part in group:
            own = owner[base : base + len(part) - length + 1]
            firsts = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
            counts = np.diff(np.r_[firsts, len(own)])
            ranks = names[own[firsts]].view(np.int64)
            for first, n, place, rank in zip(firsts.tolist(), counts.tolist(), (own[firsts] - base).tolist(), ranks.tolist(), strict=True):
                yield k, start + first, n, start + place, rank, hashlib.blake2b(part[first : first + n + length - 1], digest_size=16).digest()
            base += len(part)


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """k, c (a 128-bit key), text, copies: each distinct text once, in buckets of its key; and the name of its table."""
    spark, width = docs.sparkSession, shuffle_width(docs.sparkSession)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(*key(F.col("text")), "text")
    once = texts.groupBy("k", "c").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"tidemark_texts_{uuid.uuid4().hex}"
    once.write.option("compression", "zstd").bucketBy(width, "k", "c").option("path", fresh_path(spark, "texts")).saveAsTable(name)
    return spark.table(name), name


def key(text: Column) -> tuple[Column, Column]:
    sha = F.sha2(text, 256)
    return F.xxhash64(sha).alias("k"), F.xxhash64(F.lit(1), sha).alias("c")


def with_places(texts: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """texts joined to the list of their places(k, c, ...); only the places are shuffled."""
    by = places.groupBy("k", "c").agg(F.collect_list(F.struct(*places.columns[2:])).alias("places"))
    none = F.array().cast(by.schema["places"].dataType)
    return texts.join(by, ["k", "c"], how).select("k", "c", F.col("text").cast("binary").alias("text"), "copies", F.coalesce("places", none).alias("places"))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in parts of SLICE bytes of text or so."""
    ends = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch["text"]])
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def per_text(texts: DataFrame, places: DataFrame, find: Callable[[bytes, list[dict]], Iterator[tuple]]) -> DataFrame:
    """k, c, at, n, own, u1, u2, times, r: what find yields, as (at, n, own, digest), of each text and its places."""

    def made(keys: list[tuple], got: list[tuple]) -> pa.RecordBatch:
        (k, c), (at, n, own, digest) = zip(*keys, strict=True), zip(*got, strict=True)
        u = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        lead, times = equal_rows(u)
        cols = [pa.array(x, t) for x, t in zip((k, c, at, n, own, u[:, 0].copy(), u[:, 1].copy()), TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(times), pa.array(anywhere(lead))], [*NAMES, "times", "r"])

    def run(batches):
        keys: list[tuple] = []
        got: list[tuple] = []
        for batch in (part for whole in batches for part in slices(whole)):
            for k, c, text, own in zip(*(batch[x].to_pylist() for x in ("k", "c", "text", "places")), strict=True):
                for row in find(text, own):
                    keys.append((k, c))
                    got.append(row)
                    if len(got) >= ROWS:
                        yield made(keys, got)
                        keys, got = [], []
        if got:
            yield made(keys, got)

    return with_places(texts, places, "inner").mapInArrow(run, f"{SCHEMA}, times int, r int")


def equal_rows(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of u whether it is the first of its equals, and how many they are."""
    order = np.lexsort((np.arange(len(u)), *u.T[::-1]))
    fresh = np.r_[True, (np.diff(u[order], axis=0) != 0).any(axis=1)]
    lead, times = np.zeros(len(u), bool), np.zeros(len(u), np.int32)
    lead[order] = fresh
    times[order] = np.diff(np.r_[np.flatnonzero(fresh), len(u)])[np.cumsum(fresh) - 1]
    return lead, times


def anywhere(lead: np.ndarray) -> np.ndarray:
    """0 for rows that must meet their equals, other numbers for those that need not."""
    return np.where(lead, 0, np.arange(1, len(lead) + 1)).astype(np.int32)


SCHEMA = "k bigint, c bigint, at bigint, n int, own bigint, u1 bigint, u2 bigint"
NAMES, TYPES = SCHEMA.replace(" bigint", "").replace(" int", "").split(", "), [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def again(df: DataFrame) -> DataFrame:
    """Rows whose content occurs more than once."""
    return df.withColumn("same", F.sum("times").over(Window.partitionBy("u1", "u2", "r"))).where("same > 1").drop("same", "times", "r")


def ranked_runs(texts: DataFrame, length: int) -> DataFrame:
    """The runs of all texts with their rank h, and what their slice of a batch says of them.

    times: how often the slice has the run, lead: whether the row stands for it. Of the leads of a rank the first has
    r = 0 and weight, the number of the slice's runs under the rank; mixed: whether the slice has other content under it.
    """

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            keys, checks = batch["k"].to_numpy(), batch["c"].to_numpy()
            got = list(runs(batch["text"].to_pylist(), length))
            if not got:
                continue
            k, at, n, own, rank, digest = zip(*got, strict=True)
            k, rank = np.array(k), np.array(rank, np.int64)
            u = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            lead, times = equal_rows(u)
            first, weight = equal_rows(rank[:, None])
            mixed = times < weight
            cols = [pa.array(x, t) for x, t in zip((keys[k], checks[k], at, n, own, u[:, 0].copy(), u[:, 1].copy()), TYPES, strict=True)]
            # The first row of a rank is the first of its content, too, and so a lead.
            yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, (rank, times, lead, anywhere(first), weight, mixed))], [*NAMES, "h", "times", "lead", "r", "weight", "mixed"])

    binary = texts.select("k", "c", F.col("text").cast("binary").alias("text"))
    return binary.mapInArrow(run, f"{SCHEMA}, h bigint, times int, lead boolean, r int, weight int, mixed boolean")


def repeated(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """k, c, at, n: runs of repeated windows of the texts."""
    every = cut(ranked_runs(texts, length), "runs", "zstd")
    rank, content = Window.partitionBy("h", "r"), Window.partitionBy("h", "u1", "u2")
    left = cut(
        every.where("lead")
        .withColumn("same_rank", F.sum("weight").over(rank))
        .where("same_rank > 1 OR mixed")
        .withColumn("same", F.sum("times").over(content))
        .withColumn("nth", F.row_number().over(content.orderBy("k", "at")))
        # Another content under the same rank: some run is not a copy of all the others.
        .select("k", "c", "at", "n", "own", (F.col("same") > 1).alias("whole"), ((F.col("mixed") | (F.col("same") < F.col("same_rank"))) & (F.col("nth") == 1)).alias("open")),
        "left",
    )

    def parts(text: bytes, places: list[dict]) -> Iterator[tuple]:
        for p in places:
            for b in range((p["own"] - p["at"] - p["n"] + 1) // PART, (p["own"] - p["at"]) // PART + 1):
                core = p["own"] - PART * b
                first, last = max(p["at"], core - PART + 1), min(p["at"] + p["n"] - 1, core)
                yield first, last - first + 1, p["own"], hashlib.blake2b(text[core : core + length - PART + 1], digest_size=16, salt=b.to_bytes(4, "little")).digest()

    def windows(text: bytes, places: list[dict]) -> Iterator[tuple]:
        for p in places:
            for at in range(p["at"], p["at"] + p["n"]):
                yield at, 1, p["own"], hashlib.blake2b(text[at : at + length], digest_size=16).digest()

    own, places = ["k", "c", "at", "n", "own"], ["k", "c", "at", "n"]
    shared = again(per_text(texts, left.where("open").select(*own), parts))
    single = again(per_text(texts, shared.select(*own), windows))
    # Runs that stand for no other and of which their slice has several are repeated already.
    return every.where("times > 1").select(*places).union(left.where("whole").select(*places)).union(single.select(*places))


def prune(docs: DataFrame, length: int = LENGTH, content: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if content, kept (the remaining bytes) of every row of docs."""
    texts, name = distinct_texts(docs)
    schema = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * content

    def cover(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * content]
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            places = batch["places"]
            for i, (text, copies) in enumerate(zip(batch["text"].to_pylist(), batch["copies"].to_pylist(), strict=True)):
                gone = np.zeros(len(text) + 1, np.int64)
                at, n = places[i].values.field("at").to_numpy(), places[i].values.field("n").to_numpy().astype(np.int64)
                if copies > 1 and len(text) >= length:
                    at, n = np.array([0]), np.array([len(text) - length + 1])
                np.add.at(gone, at, 1)
                np.add.at(gone, at + n + length - 1, -1)
                off = np.cumsum(gone)[:-1] > 0
                kept = np.frombuffer(text, np.uint8)[~off].tobytes()
                rows.append((len(text), int(off.sum()), int((off & ~np.r_[False, off[:-1]]).sum()) if len(off) else 0, hashlib.sha256(kept).hexdigest(), *[kept] * content))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch["k"], batch["c"], *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], ["k", "c", *schema.split()[::2]])

    done = with_places(texts, repeated(texts, length), "left").mapInArrow(cover, f"k bigint, c bigint, {schema}")
    rows = docs.select("doc_id", *key(F.coalesce("text", F.lit(""))))
    result = cut(rows.join(done, ["k", "c"]).drop("k", "c"), "pruned")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    return result


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    return prune(docs, content=False)
