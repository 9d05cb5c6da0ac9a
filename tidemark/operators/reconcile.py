"""Listing against records: what to copy, what is gone, and the guards before anything is deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import globs
from tidemark.functions.text import etag_compare
from tidemark.functions.versions import lease_held
from tidemark.operators.ordering import ranged

MASS_LEAST, MASS_SHARE = 100, 4


def diff(listing: DataFrame, record: DataFrame, now, first_started=None, include=(), exclude=()) -> DataFrame:
    """pipeline_id, key, action, in_flight over the union of both sides' keys, each side filtered before the join.

    action: upsert, already_synced, ignored, delete_candidate or none. first_started: objects without a record that are
    older are ignored.
    """
    keep = lambda df: df.where(globs.matches("key", include, exclude))
    left = keep(listing).select("pipeline_id", "key", "version", "mod_time", F.lit(True).alias("listed"))
    right = keep(record).select("pipeline_id", "key", "synced_version", "status", "claimed_until", F.lit(True).alias("known"))
    both = left.join(right, ["pipeline_id", "key"], "full_outer")
    listed, known = F.coalesce("listed", F.lit(False)), F.coalesce("known", F.lit(False))
    old = F.lit(False) if first_started is None else F.coalesce(F.col("mod_time") < first_started, F.lit(False))
    same = (F.col("status") != "deleted") & (F.col("synced_version") != "") & (etag_compare("synced_version") == etag_compare("version"))
    action = (
        F.when(listed & ~known & old, "ignored")
        .when(listed & ~known, "upsert")
        .when(~listed & (F.col("status") != "deleted"), "delete_candidate")
        .when(~listed, "none")
        .when(same, "already_synced")
        .otherwise("upsert")
    )
    out = both.withColumn("action", action)
    flying = listed & known & (F.col("action") == "upsert") & lease_held("status", "claimed_until", now)
    return out.withColumn("in_flight", flying).select("pipeline_id", "key", "version", "status", "action", "in_flight", listed.alias("listed"), known.alias("known"))


def confirm(candidates: DataFrame, recheck: DataFrame) -> DataFrame:
    """Delete candidates that a second look at the source still lacks."""
    return candidates.join(recheck.select("pipeline_id", "key"), ["pipeline_id", "key"], "left_anti")


def stats(diffed: DataFrame, *by: str) -> DataFrame:
    is_ = lambda a: F.count_if(F.col("action") == a)
    return diffed.groupBy(*by).agg(F.count_if("listed").alias("listed"), is_("upsert").alias("emitted"), is_("delete_candidate").alias("deleted"),
        is_("already_synced").alias("already_synced"), F.count_if("in_flight").alias("in_flight"), is_("ignored").alias("ignored"))


def empty_source_guard(diffed: DataFrame) -> DataFrame:
    """Per pipeline listed, live and verdict: refuse when nothing is listed but records are live."""
    live = F.count_if(F.col("known") & (F.col("status") != "deleted"))
    out = diffed.groupBy("pipeline_id").agg(F.count_if("listed").alias("listed"), live.alias("live"))
    return out.withColumn("verdict", F.when((F.col("listed") == 0) & (F.col("live") > 0), "refuse").otherwise("ok"))


def mass_delete_guard(gone: DataFrame, diffed: DataFrame) -> DataFrame:
    """Per pipeline gone, live and verdict: refuse when over MASS_LEAST keys and over a quarter of the live ones are gone."""
    live = diffed.groupBy("pipeline_id").agg(F.count_if(F.col("known") & (F.col("status") != "deleted")).alias("live"))
    n = gone.groupBy("pipeline_id").agg(F.count("*").alias("gone"))
    out = live.join(n, "pipeline_id", "left").select("pipeline_id", F.coalesce("gone", F.lit(0)).cast("long").alias("gone"), "live")
    return out.withColumn("verdict", F.when((F.col("gone") > MASS_LEAST) & (F.col("gone") * MASS_SHARE > F.col("live")), "refuse").otherwise("ok"))


def allowed_deletes(gone: DataFrame, *guards: DataFrame) -> DataFrame:
    """gone of pipelines that every guard lets pass."""
    for guard in guards:
        gone = gone.join(guard.where("verdict = 'ok'").select("pipeline_id"), "pipeline_id", "left_semi")
    return gone


def order_check(listing: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Per pipeline the first key that does not follow its predecessor, by arrival. Spark's join needs no order; this reports it."""
    # Order is checked within ranges of arrivals; a range's first key is then compared with the last one of the range before.
    rows = ranged(listing.select("pipeline_id", "key", F.col(arrival).alias("arrival")), ["pipeline_id"], ["arrival"])
    previous = F.lag("key").over(Window.partitionBy("pipeline_id", "__part").orderBy("arrival"))
    within = rows.withColumn("previous", previous).select("pipeline_id", "key", "arrival", "previous")
    ends = rows.groupBy("pipeline_id", "__part").agg(F.min_by(F.struct("key", "arrival"), "arrival").alias("first"), F.max_by("key", "arrival").alias("last"))
    before = F.lag("last").over(Window.partitionBy("pipeline_id").orderBy("__part"))
    between = ends.withColumn("previous", before).select("pipeline_id", "first.*", "previous")
    wrong = within.unionByName(between).where("key <= previous")
    return wrong.groupBy("pipeline_id").agg(F.min_by(F.struct("key", "previous"), F.col("arrival")).alias("x"),
        F.count("*").alias("misordered")).select("pipeline_id", F.col("x.key").alias("key"), F.col("x.previous").alias("previous"), "misordered")


def snapshot_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys in both snapshots whose object was copied in between."""
    b, a = before.alias("b"), after.alias("a")
    changed = ~F.col("a.synced_at").eqNullSafe(F.col("b.synced_at")) | ~F.col("a.dest_version").eqNullSafe(F.col("b.dest_version"))
    return b.join(a, ["pipeline_id", "key"]).where(changed).select("pipeline_id", "key", F.col("b.synced_at").alias("before"), F.col("a.synced_at").alias("after"))
