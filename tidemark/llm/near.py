"""Near-dedup by similarity of word shingles: SimHash groups first, MinHash bands for the rest, exact similarity decides.

Two texts are linked where the sets of their shingles of five words have a Jaccard similarity of 0.8 or more; of each
connected component one document stays. Candidates come in buckets, and no bucket decides a link:

1. SimHash: the components of the Gray-order index (simhash.links) over fingerprints of five-word shingles.
2. MinHash: texts that agree on all values of a band share a bucket. Fingerprints of texts at 0.8 differ by about ten
   bits of 64, which no index of few differing bits reaches, so these buckets find what the first ones miss. A pair at
   0.8 shares none of the 32 bands with a chance of 5e-8, and a more similar one with less.

In a bucket texts are compared on their whole shingle sets until each pair is known to be linked, not linked, or within
one component already. A bucket of more than a task should hold is cut into parts that share some pivots; buckets whose
texts all are in one component after that are done, which a group of thousands of near copies is. In the others every
text that is not of the bucket's main component meets every part, so that no pair of different components is left out.
That work grows with the texts outside the main component times the bucket's size.

Defined cases: null texts count as empty; those without words are alike. Fewer words than a shingle make one shingle of
all of them. Upper and lower case of A-Z are the same. Of a component the row of least doc_id stays, a null one only
where all lack one; rows that share a doc_id, or lack one, are told apart by their texts. An empty table stays empty,
and extra columns stay as they are.
"""

from __future__ import annotations

from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components
from tidemark.llm.util import cut, keep_rows, row_key, shuffle_width, text_digest

WORDS, SEED = 5, 42
#: The least similarity of a link, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 32, 4
#: Texts, and shingles, of a bucket that a task compares at once, about; the pivots that a bucket's parts share.
PART, WEIGHT, PIVOTS = 512, 500_000, 8
SALTS = 64
#: Bytes of a shingle's hash in a set.
WIDTH = 6
#: Texts that a part compares with all others one by one before it compares all pairs at once.
SINGLY = 16
_RNG = np.random.default_rng(SEED)
MULTIPLY = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The 64-bit hashes of a text's shingles, in order."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    found = map(b" ".join, zip(*(parts[k:] for k in range(words)))) if len(parts) >= words else [b" ".join(parts)]  # noqa: B905
    return np.array(array("Q", map(xxhash.xxh64_intdigest, found, repeat(SEED))))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Their first 48 bits, sorted and distinct: what sets are compared by. A chance hit among two sets of 20,000 has a chance of 1e-6."""
    return np.unique(shingle_hashes(text, words) >> np.uint64(64 - 8 * WIDTH))


def packed(values: np.ndarray) -> bytes:
    """WIDTH bytes a value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.reshape(-1).view("<u8")


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key per band, of its MinHash values."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 2048):
        least = np.minimum(least, (low[at : at + 2048, None] * MULTIPLY + ADD).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node (the text's digest), fp (SimHash), bands of every row. Narrow: no shuffle."""
    docs = docs.select("doc_id", text_digest().alias("node"), "text")

    def run(batches):
        for batch in batches:
            hashes = [shingle_hashes(t.as_py()) for t in batch["text"]]
            fp = np.array([simhash.majority(h) for h in hashes], np.uint64).view(np.int64)
            keys = [bands(np.unique(h)) for h in hashes]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["node"], pa.array(fp), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "fp", "bands"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node binary, fp bigint, bands array<bigint>")


def simhash_groups(signed: DataFrame) -> DataFrame:
    """band, key, node of the texts of each component of the Gray-order index."""
    fps = signed.select("fp", "node").distinct()
    roots = components(simhash.links(fps.select("fp").distinct()))
    grouped = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return grouped.select(F.lit(-1).alias("band"), F.coalesce("root", "fp").alias("key"), "node")


def buckets(rows: DataFrame) -> DataFrame:
    """rows(band, key, node), distinct: band, key, n, node of every bucket of two texts or more, each set of texts once. Large buckets are counted in parts."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    digest = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "node"))
    same = [F.min("node").alias("least"), F.count("*").alias("n"), digest(1).alias("x"), digest(2).alias("y")]
    groups = (
        rows.groupBy("band", "key", "salt")
        .agg(*same)
        .groupBy("band", "key")
        .agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.collect_list("salt").alias("salts"))
        .where("n > 1")
        .groupBy("least", "n", "x", "y")
        .agg(F.min(F.struct("band", "key", "salts")).alias("one"))
        .select("one.band", "one.key", "n", F.explode("one.salts").alias("salt"))
    )
    return rows.join(groups, ["band", "key", "salt"]).select("band", "key", "n", "node")


def stars(found: list[tuple[int, int]], nodes: list[bytes], pivots: list[bool]) -> list[tuple[int, int]]:
    """The same components with all links from one centre: the least of the pivots that it holds, or of all of its texts."""
    root: dict[int, int] = {}

    def top(k: int) -> int:
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in found:
        root[top(b)] = top(a)
    groups: dict[int, list[int]] = {}
    for k in list(root):
        groups.setdefault(top(k), []).append(k)
    out = []
    for members in groups.values():
        centre = min(members, key=lambda k: (not pivots[k], nodes[k]))
        out += [(centre, k) for k in members if k != centre]
    return out


class Links:
    """Which of a part's texts are in one component, as far as is known, and the links found."""

    def __init__(self, labels: list) -> None:
        first: dict = {}
        self.root = np.array([first.setdefault(x, k) for k, x in enumerate(labels)])
        self.found: list[tuple[int, int]] = []

    def join(self, a: int, b: int) -> None:
        x, y = self.root[a], self.root[b]
        if x != y:
            self.root[self.root == y] = x
            self.found.append((a, b))


def forest(sets: list[np.ndarray], labels: list | None = None) -> list[tuple[int, int]]:
    """Positions of linked pairs that connect whatever links connect among sets; equal labels are connected already."""
    m = len(sets)
    links = Links(list(range(m)) if labels is None else labels)
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.r_[0, np.cumsum(sizes)[:-1]]
    p, q = LEAST
    settled = np.zeros(m, bool)  # compared with every other one
    for _ in range(SINGLY):
        counts = np.bincount(links.root, minlength=m)
        largest = int(counts.argmax())
        left = np.flatnonzero(~settled & (links.root != largest)) if counts[largest] > 1 else np.flatnonzero(~settled)
        if not len(left) or counts[largest] == m or settled.sum() >= m - 1:
            return links.found
        k = int(left[np.argmax(counts[links.root[left]])]) if counts[largest] > 1 else int(left[0])
        at = np.minimum(np.searchsorted(sets[k], flat), sizes[k] - 1)
        shared = np.add.reduceat(sets[k][at] == flat, starts)
        for v in np.flatnonzero((p + q) * shared >= p * (sizes + sizes[k])).tolist():
            links.join(k, v)
        settled[k] = True
    shared = intersections(sets)
    near = ((p + q) * shared >= p * (sizes[:, None] + sizes[None, :])) & (links.root[:, None] != links.root[None, :])
    for a, b in np.argwhere(np.triu(near)).tolist():
        links.join(a, b)
    return links.found


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    more = often[column] > 1
    owner, column = owner[more], column[more]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.cumsum(np.diff(column[order], prepend=-1) != 0) - 1
    shared = np.zeros((m, m), np.float32)  # whole numbers below 2 ** 24
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        held = np.zeros((m, 4096), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        shared += held @ held.T
    return shared.astype(np.int64)


def compare(dealt: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """dealt(band, key, i, j, node, label, pivot), the texts of each group to compare: links (a, b) found between different labels, a being a centre."""
    group = ["band", "key", "i", "j"]
    given = dealt.join(sets.select("node", "set"), "node").select(*group, "node", "label", "pivot", "set").repartition(width, *group).sortWithinPartitions(*group)

    def run(batches):
        held_key, nodes, labels, pivots, held = None, [], [], [], []

        def close():
            if len(held) < 2 or len(set(labels)) < 2:
                return []
            return [(nodes[a], nodes[b]) for a, b in stars(forest(held, labels), nodes, pivots)]

        def made(out):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["a", "b"])

        for batch in batches:
            out = []
            keys = zip(*(batch[c].to_pylist() for c in group), strict=True)
            for at, (key, n, label, pivot) in enumerate(zip(keys, *(batch[c].to_pylist() for c in ("node", "label", "pivot")), strict=True)):
                if key != held_key:
                    out += close()
                    held_key, nodes, labels, pivots, held = key, [], [], [], []
                nodes.append(n)
                labels.append(label)
                pivots.append(pivot)
                held.append(unpacked(batch["set"][at].as_py()))
            yield made(out)
        yield made(close())

    return cut(given.mapInArrow(run, "a binary, b binary"), "links", "zstd")


def mixed(members: DataFrame, roots: DataFrame | None, sets: DataFrame) -> DataFrame:
    """members(band, key, n, node) of buckets that still hold texts of different components, with label, main (the label most have), size and parts."""
    lab = members.join(sets.select("node", "size"), "node")
    if roots is None:
        lab = lab.withColumn("label", F.col("node"))
    else:
        lab = lab.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    by_label = lab.groupBy("band", "key", "label").agg(F.count("*").alias("k"), F.sum("size").alias("w"), F.max("n").alias("n"))
    parts = F.ceil(F.greatest(F.sum("k") / PART, F.sum("w") / WEIGHT)).cast("int").alias("parts")
    open_ = by_label.groupBy("band", "key").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("labels"), parts, F.max("n").alias("n")).where("labels > 1")
    # A large bucket's texts meet what is known of it in salted parts.
    salts = F.ceil(F.col("n") / PART).cast("int")
    salted = open_.select("band", "key", "main", "parts", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return lab.withColumn("salt", F.pmod(F.xxhash64(F.lit(9), "node"), salts).cast("int")).join(salted, ["band", "key", "salt"]).drop("salt")


def in_parts(members: DataFrame) -> DataFrame:
    """A bucket's texts part by part, and its pivots in every part."""
    own = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("parts")).cast("int")
    pivot = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("n")) < PIVOTS
    i = F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own)))
    return members.select("band", "key", i.alias("i"), F.lit(0).alias("j"), "node", "label", pivot.alias("pivot"))


def crosswise(members: DataFrame) -> DataFrame:
    """Parts of the texts outside a bucket's main component, each with every part of the bucket."""
    outside = F.col("label") != F.col("main")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    blocks = F.ceil(F.greatest(F.count("*") / PART, F.sum("size") / WEIGHT)).cast("int").alias("blocks")
    strangers = members.where(outside).groupBy("band", "key").agg(blocks, F.first("parts").alias("parts")).select("band", "key", "blocks", F.explode(every("parts")).alias("part"))
    part = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("parts")).cast("int")
    both = members.withColumn("part", part).join(strangers, ["band", "key", "part"])
    block = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks")).cast("int")
    cols = ["band", "key", "node", "label"]
    asked = both.where(outside).select(*cols, block.alias("i"), F.explode(every("parts")).alias("j"))
    met = both.select(*cols, F.explode(every("blocks")).alias("i"), F.col("part").alias("j"))
    return asked.unionByName(met).distinct().select("band", "key", "i", "j", "node", "label", F.lit(False).alias("pivot"))


def linked(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """node, root of every text that a link touches."""
    width = shuffle_width(docs.sparkSession)
    grouped = cut(buckets(simhash_groups(signed)), "groups", "zstd")
    banded = cut(buckets(signed.select("node", F.posexplode("bands").alias("band", "key")).distinct()), "buckets", "zstd")
    asked = grouped.select("node").union(banded.select("node")).distinct()
    texts = docs.select(text_digest().alias("node"), "text").join(asked, "node", "left_semi")

    def hashed(batches):
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(map(len, found), pa.int64()), pa.array(map(packed, found), pa.binary())], ["node", "size", "set"])

    sets = cut(texts.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(hashed, "node binary, size bigint, set binary"), "sets", "zstd")
    # A text is in one group only, so that its centre there says enough of its component to go on with.
    found = compare(in_parts(mixed(grouped, None, sets)), sets, width)
    centres = found.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    centres = cut(centres.unionByName(found.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root")), "centres")
    open_ = cut(mixed(banded, centres, sets), "mixed", "zstd")
    found = found.union(compare(in_parts(open_), sets, width))
    roots = components(found)
    # Small buckets have been compared whole; of the large ones those are left whose texts are not yet one component.
    large = cut(mixed(grouped, None, sets).where("parts > 1").unionByName(open_.where("parts > 1")).select("band", "key", "n", "node"), "large")
    if large.limit(1).count():
        left = cut(mixed(large, roots, sets), "left")
        if left.limit(1).count():
            roots = components(found.union(compare(crosswise(left), sets, width)))
    return roots


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component one, with all columns."""
    signed = cut(signatures(docs), "signatures", "zstd")
    roots = linked(docs, signed).withColumnRenamed("node", "__node")
    least = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("one")
    one = least.join(roots, F.col("node") == F.col("__node"), "left").groupBy(F.coalesce("root", "node").alias("component")).agg(first)
    return keep_rows(docs, one.select(row_key(F.col("one.doc_id"), F.col("one.node")).alias("__key")))
