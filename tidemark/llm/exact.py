"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so, and each chunk is known by a pair of 64-bit hashes. The chunk dictionary
holds every distinct chunk once and verifies the identifier: the least and the greatest chunk text under it must be
the same text. A text's recipe is its ordered list of identifiers; texts are equal when their recipes are. Long
documents move once, as chunks that are combined before the shuffle; all later steps move recipes only. A recipe with
an identifier that failed the check is compared together with the SHA-256 of its text.

Defined cases: null text counts as empty; empty texts equal each other. Of equal texts the row with the largest
doc_id stays (null is less than any); of repeated rows with that doc_id exactly one. A group of any size is counted in
parts, by salt, before its parts meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import cut, keep_rows, lower_ascii, row_key, shuffle_width

#: A chunk ends, after 1,024 characters at least and 8,191 at most, before a word that starts with one of these pairs.
CHUNKS = r"(?s).{1024,8191}?[\x20\n](?=[a-c][a-h])|.{1,8192}"
#: Parts of a group that are counted apart, at least.
SALTS = 64


def chunks(text):
    return F.regexp_extract_all(text, F.lit(CHUNKS), F.lit(0))


def chunk_id(chunk):
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(1), chunk, F.length(chunk)).alias("b"))


def classify(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    salts = max(SALTS, shuffle_width(docs.sparkSession))
    texts = docs.select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("t"))
    recipes = cut(
        texts.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.sha2("t", 256).alias("text_sha256"),
            F.transform(chunks(F.col("t")), chunk_id).alias("recipe"),
        ),
        "recipes",
    ).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    unverified = (
        texts.select(F.explode(chunks(F.col("t"))).alias("chunk"))
        .groupBy(chunk_id(F.col("chunk")).alias("id"))
        .agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest"))
        .where("least <> greatest")
        .select("id")
    )
    doubtful = (
        recipes.select("recipe", F.explode("recipe").alias("id")).join(unverified, "id").select("recipe").distinct()
        .select("recipe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(True).alias("doubt"))
    )
    keyed = recipes.join(doubtful, ["recipe", "salt"], "left").withColumn("tag", F.when(F.col("doubt"), F.col("text_sha256")).otherwise("")).drop("doubt")
    last = F.max(F.struct("doc_id", "row")).alias("last")
    groups = (
        keyed.groupBy("recipe", "tag", "salt")
        .agg(F.count("*").alias("n"), last)
        .groupBy("recipe", "tag")
        .agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.collect_list("salt").alias("salts"))
        .where("n > 1")
        .select("recipe", "tag", "n", "last", F.explode("salts").alias("salt"))
    )
    alone = F.col("n").isNull()
    return keyed.join(groups, ["recipe", "tag", "salt"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("last.row"))).alias("kept"),
        "text_sha256",
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    kept = classify(docs).where("kept").select(row_key(F.col("doc_id"), F.unhex("text_sha256")).alias("__key"))
    return keep_rows(docs, kept, F.unhex(F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256)))


def oracle(largest: str = "documents") -> str:
    return f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM {largest})
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY t)"""
