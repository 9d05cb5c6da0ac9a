"""SimHash near-dedup with a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so that neighbours share long bit patterns. The upper nodes of the index
are patterns under a mask: of four blocks of the bits not yet masked, two fingerprints at three or fewer differing bits
share one, so every link lies below a common node, and Spark deals the nodes out. A node with more fingerprints than a
task should hold gets children, whose masks take a further block; what the last level cannot hold is dealt out as pairs
of parts. Within a node,
runs of the Gray order become leaves with the bits that all their members share; a pair of leaves that already differs
in more bits than allowed under both masks is pruned as a whole, and a group's links go out as a spanning forest.

Defined cases: null and empty texts, and those without words, have fingerprint zero and link like any other. Fewer
words than a shingle make one shingle of all of them. Copies share a fingerprint and are expanded at the end only.
Null doc_id takes part in links but is never a component's id unless all of its documents lack one.
"""

from __future__ import annotations

from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.util import cut, keep_rows, row_key, shuffle_width, text_digest

WORDS, SEED, BITS, DISTANCE = 3, 42, 64, 3
#: Fingerprints of a node that a task holds at once; of a node of the last level that has more, two parts of half as many.
NODE = 8192
LEAF = 32
LEVELS = 3


def fingerprint(text: str | None, words: int = WORDS) -> int:
    parts = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not parts:
        return 0
    shingles = list(map(b" ".join, zip(*(parts[k:] for k in range(words))))) if len(parts) >= words else [b" ".join(parts)]  # noqa: B905
    return majority(np.array(array("Q", map(xxhash.xxh64_intdigest, shingles, repeat(SEED)))))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * counts > len(hashes)))


def fingerprints(docs: DataFrame, words: int = WORDS, keyed: bool = False) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer, and if keyed digest, the text's. Narrow: no shuffle."""
    docs = docs.select("doc_id", "text", *[text_digest().alias("digest")] * keyed)
    rest = ["digest"] * keyed

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp), *[batch[c] for c in rest]], ["doc_id", "fp", *rest])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint" + ", digest binary" * keyed)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of a bit string in Gray's order."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def blocks(mask: int) -> list[int]:
    """The bits that mask leaves, in DISTANCE + 1 nearly equal blocks."""
    free = [k for k in range(BITS) if not mask >> k & 1]
    n = DISTANCE + 1
    return [sum(1 << k for k in free[len(free) * i // n : len(free) * (i + 1) // n]) for i in range(n)]


def masks(levels: int = LEVELS) -> list[list[int]]:
    """The masks of each level of upper nodes; node k of a level has children 4k to 4k + 3."""
    out = [blocks(0)]
    for _ in range(levels - 1):
        out.append([m | b for m in out[-1] for b in blocks(m)])
    return out


def forest(fp: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Positions of linked pairs that connect whatever links connect among the fingerprints of one node."""
    n = len(fp)
    order = np.argsort(gray_rank(fp), kind="stable")
    by = fp[order]
    starts = np.arange(0, n, LEAF)
    every, some = np.bitwise_and.reduceat(by, starts), np.bitwise_or.reduceat(by, starts)
    mask = ~(every ^ some)
    root = np.arange(n)
    out = []

    def tops(at: np.ndarray) -> np.ndarray:
        at = root[at]
        while not np.array_equal(above := root[at], at):
            at = above
        return at

    for i in range(len(starts)):
        differs = np.bitwise_count((every[i] ^ every[i:]) & mask[i] & mask[i:])
        own = by[starts[i] : starts[i] + LEAF]
        near = starts[i:][differs <= distance]
        if not len(near):
            continue
        span = (near[:, None] + np.arange(LEAF)).ravel()
        span = span[span < n]
        a, b = np.nonzero(np.bitwise_count(own[:, None] ^ by[span][None, :]) <= distance)
        x, y = a + starts[i], span[b]
        x0, y0 = tops(x), tops(y)
        apart = np.flatnonzero(x0 != y0)
        _, first = np.unique(x0[apart] * n + y0[apart], return_index=True)
        for k in apart[first].tolist():
            u, v = (int(tops(np.array([z]))[0]) for z in (x[k], y[k]))
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((int(order[x[k]]), int(order[y[k]])))
    return out


def search(nodes: DataFrame, by: list[str], most: int) -> DataFrame:
    """nodes(by, fp), sorted by node within partitions: links (a, b), or rows (a, null) of nodes of more than most fingerprints, with by."""
    kinds = [pa.int32() if dict(nodes.dtypes)[c] == "int" else pa.int64() for c in by] + [pa.int64(), pa.int64()]

    def run(batches):
        key, held, size, passing = None, [], 0, False
        out: list[tuple] = []

        def close():
            if passing or size < 2:
                return []
            fp = np.concatenate(held)
            return [(*key, int(fp[a]), int(fp[b])) for a, b in forest(fp.view(np.uint64))]

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [*by, "a", "b"])

        for batch in batches:
            cols = [batch[c].to_numpy() for c in by]
            fp = batch["fp"].to_numpy()
            fresh = np.any([np.diff(c) != 0 for c in cols], axis=0) if len(fp) > 1 else np.empty(0, bool)
            bounds = np.r_[0, np.flatnonzero(fresh) + 1, len(fp)]
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                if (own := tuple(int(c[lo]) for c in cols)) != key:
                    out += close()
                    key, held, size, passing = own, [], 0, False
                held.append(fp[lo:hi].copy())
                size += hi - lo
                if passing or size > most:
                    out += [(*key, x, None) for part in held for x in part.tolist()]
                    held, passing = [], True
                if len(out) > 50_000:
                    yield made()
                    out.clear()
        out += close()
        if out:
            yield made()

    return nodes.mapInArrow(run, ", ".join([*[f"{c} {dict(nodes.dtypes)[c]}" for c in by], "a bigint", "b bigint"]))


def links(fps: DataFrame, levels: int = LEVELS) -> DataFrame:
    """fps(fp), distinct: pairs (a, b) at DISTANCE or fewer differing bits that connect what all such pairs connect."""
    spark = fps.sparkSession
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    width = shuffle_width(spark)
    found = None

    def settle(rows: DataFrame, by: list[str], most: int) -> DataFrame:
        nonlocal found
        done = cut(search(rows.repartition(width, *by).sortWithinPartitions(*by), by, most), "links")
        pairs = done.where("b IS NOT NULL").select("a", "b")
        found = pairs if found is None else found.union(pairs)
        return done.where("b IS NULL")

    rows = fps.select(F.explode(F.array(*[F.lit(k) for k in range(DISTANCE + 1)])).alias("mask"), "fp")
    for level, values in enumerate(masks(levels)):
        bits = F.array(*[F.lit(signed(m)) for m in values])
        split = settle(rows.withColumn("pattern", F.col("fp").bitwiseAND(F.get(bits, F.col("mask")))), ["mask", "pattern"], NODE)
        if not split.limit(1).count():
            return found
        if level < levels - 1:
            children = F.transform(F.array(*[F.lit(k) for k in range(DISTANCE + 1)]), lambda k: F.col("mask") * (DISTANCE + 1) + k)
            rows = split.select(F.explode(children).alias("mask"), F.col("a").alias("fp"))
    # No block is left to part these nodes by: every pair of their parts goes to a task of its own.
    half = max(1, NODE // 4)
    sizes = split.groupBy("mask", "pattern").agg(F.ceil(F.count("*") / half).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    dealt = split.join(sizes, ["mask", "pattern"]).select("mask", "pattern", own.alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"), F.col("a").alias("fp"))
    settle(dealt.select("mask", "pattern", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "fp"), ["mask", "pattern", "i", "j"], 1 << 62)
    return found


def components_of(fps: DataFrame) -> DataFrame:
    """fp, root, component_id of the distinct fingerprints of fps(doc_id, fp)."""
    least = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(least.select("fp")))
    rooted = cut(least.join(roots, least["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    return cut(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id"), "named")


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs."""
    fps = cut(fingerprints(docs), "fingerprints")
    return fps.join(components_of(fps), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns: of each component one row, of its least doc_id, and of rows that share that one the one of least text digest."""
    fps = cut(fingerprints(docs, keyed=True), "fingerprints")
    named = components_of(fps)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("one")
    stay = fps.join(named, "fp").groupBy("root").agg(first).select(row_key(F.col("one.doc_id"), F.col("one.digest")).alias("__key"))
    return keep_rows(docs, stay)
