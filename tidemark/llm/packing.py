"""Variable-capacity best-fit packing of token runs into training sequences of several permitted lengths.

Texts are encoded by the tokenizer's merges (bpe), and a document's ids, or runs of them, are the items. Best-fit
depends on lengths only, and lengths are whole numbers up to the greatest capacity, so the plan is made from their
histogram: at most one count per length, whatever the corpus holds. Going down the lengths, items go to the open bins in
which they leave least room, alike bins being handled as one class with a count; when none has room, the capacity opened
is the one of least cost for an item of that length. At the end every bin is downsized to the least capacity that holds
its contents. Items then take their places in the plan by their rank within their length. Ranks follow a hash of the
document, so that bins do not depend on how files are split, and are counted in salted parts, so that a length that a
third of all items share is no single group.

Defined cases: a document longer than the greatest capacity is cut into pieces, all whole but the last; nothing is
dropped. Null and empty texts, and those without tokens, take no bin: bin_id is null, the piece's length 0; sequences
have no place for them. Repeated rows are packed each for itself; null doc_id is packed like any other. An empty table
gives no rows, and extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.util import cut, row_key, text_digest

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a bin besides its tokens: what a sequence takes whatever its length.
OVERHEAD = 32
#: Items of a salted part, about; a plan of more rows than this is joined without broadcast.
PART, PLAN_ROWS = 50_000, 200_000


def with_key(docs: DataFrame) -> DataFrame:
    return docs.select(row_key(F.col("doc_id"), text_digest()).alias("key"), "doc_id", "text")


def tokens(docs: DataFrame, vocabulary: str, width: int) -> DataFrame:
    """key (of doc_id and text), doc_id, total, ids (of width bytes each) of every row of docs, written once."""
    encoded = bpe.encode(with_key(docs), vocabulary, "key", "doc_id", width=width)
    return cut(encoded.select("key", "doc_id", (F.length("ids") / width).cast("int").alias("total"), "ids"), "tokens", "zstd")


def plan(counts: dict[int, int], capacities=CAPACITIES, overhead: int = OVERHEAD) -> list[tuple[int, int, int, int, int, int, int]]:
    """counts: items by length. Rows (length, first rank, last rank + 1, items a bin, first bin, offset in the bin, capacity).

    The items of one length with ranks in a row's range go, so many a bin, to consecutive bins from the first bin on.
    Bins of equal contents are one class (first bin, how many, used, contents), split when only some take an item.
    """
    sizes = sorted(capacities)
    placed: dict[int, list] = {}  # class id: [first bin, bins, used, [(length, first rank, items a bin, offset)]]
    room: dict[int, list[int]] = defaultdict(list)  # classes by room left
    rooms: list[int] = []
    bins = made = 0

    def put(entry) -> None:
        nonlocal made
        placed[made] = entry
        left = entry[4] - entry[2]
        if left not in room or not room[left]:
            insort(rooms, left)
        room[left].append(made)
        made += 1

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                key = max(room[left], key=lambda k: placed[k][2])  # of equal room the bin that holds most
                room[left].remove(key)
                if not room[left]:
                    rooms.pop(at)
                first, n, used, contents, cap = placed.pop(key)
                each = min(left // length, todo)  # what is left of a best fit fits best again
                take = min(n, todo // each)
                if n > take:
                    put([first + take, n - take, used, [(a, b + c * take, c, d) for a, b, c, d in contents], cap])
                put([first, take, used + each * length, [*contents, (length, rank, each, used)], cap])
            else:
                fits = [c for c in sizes if c >= length]
                cap = min(fits, key=lambda c: ((c + overhead) / (c // length), -c))
                each = min(cap // length, todo)
                take = todo // each
                put([bins, take, each * length, [(length, rank, each, 0)], cap])
                bins += take
            rank += take * each
            todo -= take * each
    out = []
    for first, n, used, contents, _ in placed.values():
        cap = next(c for c in sizes if c >= used)
        out += [(length, rank, rank + n * each, each, first, offset, cap) for length, rank, each, offset in contents]
    return out


def place(items: DataFrame, capacities=CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """items(key, doc_id, total): key, doc_id, piece, start, n_tokens, bin_id, bin_capacity, bin_offset of every piece."""
    spark, most = items.sparkSession, max(capacities)
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / most).cast("int") - 1)
    pieces = cut(
        items.select("key", "doc_id", "total", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
        .withColumn("start", F.col("piece") * most)
        .withColumn("n_tokens", F.least(F.lit(most), F.col("total") - F.col("start")))
        .drop("total"),
        "pieces",
    )
    salts = 64
    while salts * PART < pieces.count():  # from the file footers
        salts *= 2
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.lit(salts)))
    parts = pieces.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(parts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    # One row per length: no more than the greatest capacity.
    counts = {r["n_tokens"]: r["n"] for r in offsets.groupBy("n_tokens").agg(F.sum("n").alias("n")).where("n_tokens > 0").collect()}
    rows = plan(counts, capacities, overhead)
    schema = "size int, low bigint, high bigint, each int, first bigint, bin_offset int, bin_capacity int"
    planned = spark.createDataFrame(rows, schema)
    planned = F.broadcast(planned) if len(rows) <= PLAN_ROWS else planned.hint("merge")
    within = Window.partitionBy("n_tokens", "salt").orderBy("key", "piece")
    ranked = (
        pieces.withColumn("nth", F.row_number().over(within) - 1)
        .join(offsets.select("n_tokens", "salt", "ahead").hint("merge"), ["n_tokens", "salt"])  # partitioned as the window is
        .withColumn("rank", F.col("ahead") + F.col("nth"))
        .drop("nth", "ahead", "salt")
    )
    nth = F.col("rank") - F.col("low")
    return ranked.join(planned, F.expr("n_tokens = size AND rank >= low AND rank < high"), "left").select(
        "key",
        "doc_id",
        "piece",
        "start",
        "n_tokens",
        (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("bin_id"),
        "bin_capacity",
        (F.col("bin_offset") + nth % F.col("each") * F.col("n_tokens")).cast("int").alias("bin_offset"),
    )


def pack(docs: DataFrame, vocabulary: str, capacities=CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id, bin_capacity, bin_offset: which of a document's ids lie where, a row per piece of every row of docs."""
    return place(bpe.count(with_key(docs), vocabulary, "key", "doc_id"), capacities, overhead).drop("key")


def sequences(docs: DataFrame, vocabulary: str, capacities=CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """bin_id, bin_capacity, n_tokens, ids ARRAY<INT>, doc_ids, pieces: a row per training sequence; a bin holds no more than its capacity.

    pieces tell, in the order of ids, the document, the piece and how many tokens it has.
    """
    width = bpe.encoder(vocabulary).width
    encoded = tokens(docs, vocabulary, width)
    placed = place(encoded.select("key", "doc_id", "total"), capacities, overhead).where("bin_id IS NOT NULL")
    # Repeated rows share a key and their ids; each has its own place.
    once = encoded.where("total > 0").select("key", "ids", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))).alias("nth")).where("nth = 1").drop("nth")
    run = F.substring(F.col("ids"), F.col("start") * width + 1, F.col("n_tokens") * width)
    parts = placed.join(once, "key").select("bin_id", "bin_capacity", F.struct("bin_offset", "doc_id", "piece", "start", "n_tokens", run.alias("ids")).alias("part"))
    bins = parts.groupBy("bin_id", "bin_capacity").agg(F.array_sort(F.collect_list("part")).alias("parts"))

    def joined(batches):
        for batch in batches:
            lists = batch["parts"]
            flat = lists.flatten()
            raw = flat.field("ids").to_pylist()
            ends = np.cumsum([sum(map(len, raw[a:b])) // width for a, b in zip(lists.offsets.to_pylist()[:-1], lists.offsets.to_pylist()[1:], strict=True)]) if len(lists) else []
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(np.frombuffer(b"".join(raw), f"<u{width}").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["bin_id"], batch["bin_capacity"], batch["pieces"], batch["doc_ids"], ids], ["bin_id", "bin_capacity", "pieces", "doc_ids", "ids"])

    pieces = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["start"].alias("start"), p["n_tokens"].alias("n_tokens")))
    doc_ids = F.transform("parts", lambda p: p["doc_id"])
    given = bins.select("bin_id", "bin_capacity", pieces.alias("pieces"), doc_ids.alias("doc_ids"), F.transform("parts", lambda p: F.struct(p["ids"].alias("ids"))).alias("parts"))
    kind = given.schema["doc_ids"].dataType.simpleString()
    made = given.mapInArrow(joined, f"bin_id bigint, bin_capacity int, pieces {given.schema['pieces'].dataType.simpleString()}, doc_ids {kind}, ids array<int>")
    return made.select("bin_id", "bin_capacity", F.size("ids").alias("n_tokens"), "ids", "doc_ids", "pieces")
