"""Status: counts, lag and recent errors per pipeline, and queue depths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import seconds_between
from tidemark.operators.work import OPEN_STATES

RECENT = 5


def pipeline_stats(record: DataFrame) -> DataFrame:
    """Counts by status, synced bytes, last sync and oldest unsynced change per pipeline, in one pass."""
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    waiting = F.col("status").isin("pending", "copying")
    return record.groupBy("pipeline_id").agg(
        *[is_(s) for s in ("synced", "pending", "copying", "failed")],
        F.coalesce(F.sum(F.when(F.col("status") == "synced", F.col("source_size"))), F.lit(0)).alias("bytes_synced"),
        F.max("synced_at").alias("last_synced_at"),
        F.min(F.when(waiting, F.col("event_time"))).alias("oldest_event"),
    )


def recent_errors(record: DataFrame, order: str = "updated_at", n: int = RECENT) -> DataFrame:
    """The newest n errors of each pipeline; ties by key."""
    w = Window.partitionBy("pipeline_id").orderBy(F.desc(order), "key")
    rows = record.where("status = 'failed' OR last_error <> ''").withColumn("nth", F.row_number().over(w).cast("long")).where(F.col("nth") <= n)
    return rows.select("pipeline_id", "nth", "key", "status", "last_error", order)


def lag_seconds(now, oldest):
    return F.greatest(F.coalesce(seconds_between(now, oldest), F.lit(0.0)), F.lit(0.0))


def status_report(specs: DataFrame, record: DataFrame, now, order: str = "updated_at") -> DataFrame:
    """specs(pipeline_id, enabled, revision) with stats, lag and errors as 'key: error' in order; without records all zero."""
    errors = recent_errors(record, order).groupBy("pipeline_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "key",
        "last_error"))), lambda e: F.concat(e["key"], F.lit(": "), e["last_error"])), "; ").alias("errors"))
    out = specs.join(pipeline_stats(record), "pipeline_id", "left").join(errors, "pipeline_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("pipeline_id", "enabled", "revision", *[zero(c) for c in ("synced", "pending", "copying", "failed", "bytes_synced")],
        "last_synced_at", lag_seconds(now, "oldest_event").alias("current_lag_seconds"), F.coalesce("errors", F.lit("")).alias("errors"))


def oldest_pending(record: DataFrame, pipelines: DataFrame, now) -> DataFrame:
    """Seconds since the oldest waiting change of each running pipeline, 0 without one."""
    old = record.where("status IN ('pending', 'copying') AND event_time IS NOT NULL").groupBy("pipeline_id").agg(F.min("event_time").alias("oldest"))
    return pipelines.select("pipeline_id").join(old, "pipeline_id", "left").select("pipeline_id", lag_seconds(now, "oldest").alias("oldest_pending_seconds"))


def queue_depth(jobs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Open jobs of each pipeline's queue, 0 without one."""
    n = jobs.where(F.col("state").isin(*[s for s in OPEN_STATES if s != "pending"])).groupBy("pipeline_id").agg(F.count("*").alias("n"))
    return pipelines.select("pipeline_id").join(n, "pipeline_id", "left").select("pipeline_id", F.coalesce("n", F.lit(0)).alias("depth"))


def job_states(jobs: DataFrame) -> DataFrame:
    """Counts of jobs by state, one column each."""
    states = ("available", "running", "retryable", "scheduled", "completed", "discarded", "cancelled")
    return jobs.groupBy("pipeline_id").agg(F.count("*").alias("jobs"), *[F.count_if(F.col("state") == s).alias(s) for s in states])


def growth(samples: DataFrame, at: str, *counters: str) -> DataFrame:
    """Per hour growth of counters over a sample series."""
    hours = seconds_between("__last", "__first") / 3600
    out = samples.agg(F.min(at).alias("__first"), F.max(at).alias("__last"), *[(F.max(c) - F.min(c)).alias(c) for c in counters])
    return out.select(*[(F.col(c) / hours).alias(f"{c}_per_hour") for c in counters])


def counters_line(rows: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """Counters of each group as k=v in order of k. A group's counters are few."""
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col(key), F.lit("="), F.col(value).cast("string")))), " ").alias("line"))


def keyset_page(listing: DataFrame, after: str, n: int, prefix: str = "") -> DataFrame:
    """The first n keys after one, in byte order: the limit keeps n rows of each task."""
    return listing.where((F.col("key") > after) & F.col("key").startswith(prefix)).orderBy("key").limit(n)


def union_changes(events: DataFrame, reconciled: DataFrame) -> DataFrame:
    return events.withColumn("origin", F.lit("event")).unionByName(reconciled.withColumn("origin", F.lit("reconcile")), allowMissingColumns=True)


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")
