"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.shared import cut, fresh_path, shared_dir  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table; other columns of it are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same, and faster, in texts of ASCII characters alone."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def row_key(doc_id: Column, digest: Column) -> Column:
    """One value, never null, for a doc_id, null or not, and a text's digest."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"), F.lit(":").cast("binary"), digest))


def unused(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, stay: DataFrame, digest: Column | None = None) -> DataFrame:
    """The rows of docs whose row_key is in stay(__key), each key once. Rows move at most once: the join and the choice share a key."""
    key, nth = unused(docs, "__key"), unused(docs, "__nth")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), text_digest() if digest is None else digest))
    once = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))
    return keyed.join(stay.withColumnRenamed("__key", key), key, "left_semi").withColumn(nth, once).where(F.col(nth) == 1).drop(key, nth)
