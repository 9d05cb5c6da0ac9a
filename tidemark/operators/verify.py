"""Manifests: the last write of each key, and whether the destination has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import globs
from tidemark.functions.text import col, in_prefix, pct, seconds_between, strip_prefix
from tidemark.operators.ordering import nearest_ranks


def last_writes(manifest: DataFrame, *order: str) -> DataFrame:
    """The latest entry of each key; order: columns that break ties, the greater the later."""
    latest = F.max_by(F.struct(*manifest.columns), F.struct("written_at", *order)).alias("m")
    return manifest.groupBy("key").agg(latest, F.count("*").alias("writes")).select("m.*", "writes")


def last_writes_ranked(manifest: DataFrame, *order: str) -> DataFrame:
    """The same by a window: sorted within keys."""
    w = Window.partitionBy("key").orderBy(F.desc("written_at"), *[F.desc(c) for c in order])
    return manifest.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def destination_scope(manifest: DataFrame, prefix: str, include=(), exclude=()) -> DataFrame:
    """manifest with scope (target, out_of_scope, excluded) and dest_key."""
    own = strip_prefix("key", F.lit(prefix))
    scope = F.when(~in_prefix("key", F.lit(prefix)), "out_of_scope").when(~globs.matches(own, include, exclude), "excluded").otherwise("target")
    return manifest.withColumn("scope", scope).withColumn("dest_key", F.when(F.col("scope") == "target", own))


def outcome(size_only: bool, found, size, dest_size, sha, dest_sha, error=None) -> Column:
    hashed = F.coalesce(col(dest_sha) != "", F.lit(False)) if size_only else F.lit(True)
    differs = ~F.lower(F.coalesce(col(dest_sha), F.lit(""))).eqNullSafe(F.lower(col(sha)))
    failed = F.lit(False) if error is None else F.coalesce(col(error) != "", F.lit(False))
    return (
        F.when(failed, "error")
        .when(~col(found), "missing")
        .when(col(size) != col(dest_size), "size_mismatch")
        .when(hashed & differs, "sha256_mismatch")
        .otherwise("ok")
    )


def verify(manifest: DataFrame, dest: DataFrame, size_only: bool = False) -> DataFrame:
    """manifest(key, size, sha256, written_at) against dest(key, size, sha256, mod_time): outcome, the bytes that a hash vouches
    for, and lag_seconds of ok rows. dest may have an error column: what went wrong when an object was looked at."""
    error = F.col("error") if "error" in dest.columns else F.lit("")
    d = dest.select("key", F.col("size").alias("d_size"), F.col("sha256").alias("d_sha"), "mod_time", error.alias("d_error"), F.lit(True).alias("d_found"))
    said = outcome(size_only, F.coalesce("d_found", F.lit(False)), "size", "d_size", "sha256", "d_sha", "d_error")
    out = manifest.join(d, "key", "left").withColumn("outcome", said)
    hashed = F.col("outcome").isin("ok", "sha256_mismatch") & (F.coalesce("d_sha", F.lit("")) != "")
    return out.select(
        "key",
        "size",
        "sha256",
        "written_at",
        "outcome",
        F.when(hashed, F.col("size")).otherwise(0).alias("bytes_hashed"),
        F.when(F.col("outcome") == "ok", seconds_between("mod_time", "written_at")).alias("lag_seconds"),
    )


def load_summary(manifest: DataFrame) -> DataFrame:
    span = seconds_between("last_write", "first_write")
    out = manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.min("written_at").alias("first_write"),
        F.max("written_at").alias("last_write"), F.coalesce(F.max("size"), F.lit(0)).alias("max_size"))
    return out.withColumn("bytes_per_second", F.when(span > 0, F.col("bytes") / span).otherwise(0.0))


OUTCOMES = ("ok", "missing", "size_mismatch", "sha256_mismatch")


def summary(verified: DataFrame) -> DataFrame:
    """One row: counts by outcome, errors for every other one, bytes of ok files, bytes hashed, and whether all is well."""
    said = F.col("outcome")
    out = verified.agg(
        F.count("*").alias("files"),
        *[F.count_if(said == o).alias(o) for o in OUTCOMES],
        F.count_if(~said.isin(*OUTCOMES)).alias("errors"),
        F.coalesce(F.sum(F.when(said == "ok", F.col("size"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("bytes_hashed"), F.lit(0)).alias("bytes_hashed"),
    )
    return out.withColumn("passed", (F.col("ok") == F.col("files")) & (F.col("files") > 0)).withColumn("ok_pct", pct("ok", "files"))


def quantiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Nearest-rank p50, p95, p99 and the maximum; null without values."""
    return nearest_ranks(df, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, *by)


def top_failures(verified: DataFrame, n: int) -> DataFrame:
    """The first n failed keys in byte order."""
    return verified.where("outcome <> 'ok'").orderBy("key").limit(n)


def retry_missing(verified: DataFrame, manifest: DataFrame, dest_again: DataFrame) -> DataFrame:
    """verified with missing and wrong-size entries checked against a later look at the destination."""
    again = verified.where("outcome IN ('missing', 'size_mismatch')").select("key")
    return verified.join(again, "key", "left_anti").unionByName(verify(manifest.join(again, "key", "left_semi"), dest_again))


def record_agreement(manifest: DataFrame, record: DataFrame) -> DataFrame:
    """Whether records agree with the manifest: ok, no_record, size, sha256."""
    r = record.select("key", F.col("source_size").alias("r_size"), F.col("sha256").alias("r_sha"), F.lit(True).alias("r_found"))
    said = F.when(F.col("r_found").isNull(), "no_record").when(F.col("size") != F.col("r_size"), "size").when(F.lower("sha256") != F.lower("r_sha"), "sha256").otherwise("ok")
    return manifest.join(r, "key", "left").select("key", said.alias("agreement"))


def sampled_compare(source: DataFrame, dest: DataFrame) -> DataFrame:
    """source and dest(key, at, length, sha256): per key ok, ranges and sampled bytes."""
    d = dest.select("key", "at", "length", F.col("sha256").alias("d_sha"))
    return source.join(d, ["key", "at", "length"], "left").groupBy("key").agg(F.bool_and(F.coalesce(F.col("sha256") == F.col("d_sha"),
        F.lit(False))).alias("ok"), F.count("*").alias("ranges"), F.sum("length").alias("sampled_bytes"))
