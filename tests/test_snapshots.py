"""Snapshots in buckets and in pages: plans, files that stay, merges that die, pages against the sorted list."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reconcile
from tidemark.sources import snapshots


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted((r["pipeline_id"], r["key"], r["v"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "pipeline_id string, key string, v int")


def test_merges_rewrite_touched_buckets_only(spark, tmp_path, monkeypatch):
    path, held = f"file://{tmp_path}/record", {("p", f"k{n}"): n for n in range(300)}
    snapshots.write_buckets(frame(spark, [(*k, v) for k, v in held.items()]), path, 8)
    for step in range(3):
        new = {("p", f"k{n}"): -n - step for n in random.Random(step).sample(range(350), 2)}
        before = snapshots.published(spark, path)
        touched = snapshots.merge_buckets(frame(spark, [(*k, v) for k, v in new.items()]), path)
        after = snapshots.published(spark, path)
        held |= new
        assert 0 < len(touched) <= 2 and all((a == b) == (k not in touched) for k, (a, b) in enumerate(zip(before, after, strict=True)))
        assert rows_of(snapshots.read_buckets(spark, path)) == sorted((*k, v) for k, v in held.items())
    with monkeypatch.context() as m:  # a merge dies before it publishes
        m.setattr(snapshots, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            snapshots.merge_buckets(frame(spark, [("p", "k1", 1000)]), path)
    assert rows_of(snapshots.read_buckets(spark, path)) == sorted((*k, v) for k, v in held.items())
    snapshots.merge_buckets(frame(spark, [("p", "k1", 2000), (None, "k", 5)]), path)
    held |= {("p", "k1"): 2000}
    assert snapshots.remove_superseded(spark, path) > 3
    got = snapshots.read_buckets(spark, path)
    assert rows_of(got.where("pipeline_id IS NOT NULL")) == sorted((*k, v) for k, v in held.items()) and got.count() == len(held) + 1
    assert snapshots.merge_buckets(frame(spark, []), path) == set()


def test_buckets_join_without_exchange(spark, tmp_path):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    listing = spark.range(500).select(F.lit("p").alias("pipeline_id"), F.concat(F.lit("k"), F.col("id")).alias("key"), F.lit("v").alias("version"), F.current_timestamp().cast("timestamp_ntz").alias("mod_time"))
    record = listing.where("key LIKE '%1%'").select("pipeline_id", "key", F.lit("v").alias("synced_version"), F.lit("synced").alias("status"), F.lit(None).cast("timestamp_ntz").alias("claimed_until"))
    left, right = f"file://{tmp_path}/l", f"file://{tmp_path}/r"
    snapshots.write_buckets(listing, left, 4)
    snapshots.write_buckets(record, right, 4)
    snapshots.merge_buckets(record.where("key = 'k1'"), right)
    diff = reconcile.diff(snapshots.read_buckets(spark, left), snapshots.read_buckets(spark, right), F.current_timestamp().cast("timestamp_ntz"))
    assert "Exchange" not in plan(diff) and "Bucketed: true" in plan(diff) and "SortMergeJoin" in plan(diff)
    assert {r["action"]: r["count"] for r in diff.groupBy("action").count().collect()} == {"already_synced": record.count(), "upsert": 500 - record.count()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_pages_read_the_files_that_they_meet(spark, tmp_path):
    rng = random.Random(3)
    keys = sorted({"/".join(rng.choices(["a", "b", "é", "ab"], k=rng.randint(1, 3))) + f"/{rng.randint(0, 500)}" for _ in range(1500)}, key=lambda k: k.encode())
    path = f"file://{tmp_path}/pages"
    df = spark.createDataFrame([(k, len(k)) for k in rng.sample(keys, len(keys))], "key string, size int")
    snapshots.write_pages(df, path, 20)
    files = len(spark.read.parquet(f"{path}/rows").inputFiles())
    for prefix in ("", "a", "ab/", "é/", "zz"):
        for after in ("", "a/3", keys[700], keys[-2], "zzz"):
            for n in (1, 60):
                page = snapshots.read_page(spark, path, after, n, prefix)
                want = [k for k in keys if k.encode() > after.encode() and k.startswith(prefix)][:n]
                assert [r["key"] for r in page.collect()] == want
                assert files >= 15 and (not want or len(page.inputFiles()) <= 5)
