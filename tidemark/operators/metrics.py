"""Metrics: sums over scraped series, histograms and their quantiles, rates, and counters from logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import seconds_between
from tidemark.sources.readers import parse_number

# Upper bounds of the histograms' buckets, in seconds.
LAG_BOUNDS = (0.5, 1, 2, 5, 10, 15, 20, 30, 40, 50, 60, 75, 90, 120, 180, 300, 600, 1200, 1800, 3600)
DURATION_BOUNDS = (0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300, 600, 1800, 3600)
RECONCILE_BOUNDS = (1, 5, 15, 30, 60, 120, 300, 600, 1800, 3600, 7200)
INF = float("inf")


def label(name: str) -> Column:
    """A label's value; one that is missing is ''."""
    return F.coalesce(F.col("labels")[name], F.lit(""))


def series(samples: DataFrame, name: str, **want: str) -> DataFrame:
    keep = F.col("name") == name
    for k, v in want.items():
        keep = keep & (label(k) == v)
    return samples.where(keep)


def sum_series(samples: DataFrame, name: str, **want: str) -> DataFrame:
    return series(samples, name, **want).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


def sum_by(samples: DataFrame, name: str, by: str, **want: str) -> DataFrame:
    return series(samples, name, **want).groupBy(label(by).alias(by)).agg(F.sum("value").alias("total"))


def observe(values: DataFrame, value: str, bounds, *by: str) -> DataFrame:
    """Cumulative buckets of value: by, le, count. Values are counted once per bucket, then summed up over few rows."""
    le = F.lit(INF)
    for b in reversed(bounds):
        le = F.when(F.col(value) <= b, F.lit(float(b))).otherwise(le)
    counted = values.groupBy(*by, le.alias("le")).agg(F.count("*").alias("n"))
    every = counted.select(*by).distinct().withColumn("le", F.explode(F.array(*[F.lit(float(b)) for b in (*bounds, INF)])))
    filled = every.join(counted, [*by, "le"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(*by).orderBy("le").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return filled.select(*by, "le", F.sum("n").over(w).cast("double").alias("count"))


def histogram_sums(values: DataFrame, value: str, *by: str) -> DataFrame:
    return values.groupBy(*by).agg(F.sum(value).alias("sum"), F.count("*").alias("count"))


def buckets(samples: DataFrame, name: str, *by: str, **want: str) -> DataFrame:
    """Bucket series summed by bound; series with a bound that is no number are left out."""
    rows = series(samples, f"{name}_bucket", **want).select(*[label(b).alias(b) for b in by], parse_number(label("le")).alias("le"), "value")
    return rows.where("le IS NOT NULL").groupBy(*by, "le").agg(F.sum("value").alias("count"))


def clamp(histogram: DataFrame, *by: str) -> DataFrame:
    """Counts made to rise with the bound."""
    w = Window.partitionBy(*by).orderBy("le").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return histogram.withColumn("count", F.max("count").over(w))


def quantiles(histogram: DataFrame, qs, *by: str) -> DataFrame:
    """by, q, value for each q: linear interpolation within the bucket in which the rank falls. The histogram is read once."""
    w, group = Window.partitionBy(*by).orderBy("le"), Window.partitionBy(*by)
    rows = clamp(histogram, *by).withColumns({"start": F.lag("le").over(w), "before": F.coalesce(F.lag("count").over(w), F.lit(0.0)), "total": F.max("count").over(group)})
    rows = rows.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("hit", F.col("count") >= F.col("q") * F.col("total"))
    last_finite = F.max(F.when(F.col("le") < INF, F.col("le")))
    first = F.min_by(F.struct("le", "count", "start", "before"), F.when(F.col("hit") & (F.col("le") < INF), F.col("le")))
    got = rows.groupBy(*by, "q").agg(F.count("*").alias("n"), F.max("le").alias("top"), F.max("total").alias("total"), last_finite.alias("last"), first.alias("b"))
    b = F.col("b")
    rank = F.col("q") * F.col("total") - b["before"]
    inside = F.coalesce(b["start"], F.lit(0.0)) + (b["le"] - F.coalesce(b["start"], F.lit(0.0))) * F.try_divide(rank, b["count"] - b["before"])
    value = (
        F.when(F.col("q") < 0, -INF)
        .when(F.col("q") > 1, INF)
        .when((F.col("n") < 2) | (F.col("top") != INF) | (F.col("total") == 0), float("nan"))
        .when(b["le"].isNull(), F.col("last"))
        .when(b["start"].isNull() & (b["le"] <= 0), b["le"])
        .otherwise(F.coalesce(inside, F.lit(float("nan"))))
    )
    return got.select(*by, "q", value.alias("value"))


def quantile(histogram: DataFrame, q: float, *by: str) -> DataFrame:
    return quantiles(histogram, [q], *by)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < INF), c)


SUMMARY = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def summary(samples: DataFrame, name: str, *by: str) -> DataFrame:
    """by, count, mean, p50, p95, p99 of a histogram; what is not finite is null. Sums and quantiles meet in one aggregate."""
    both = samples.where(F.col("name").isin(f"{name}_count", f"{name}_sum"))
    of = lambda part: F.sum(F.when(F.col("name") == f"{name}_{part}", F.col("value")))
    none = F.lit(None).cast("double")
    totals = both.groupBy(*[label(b).alias(b) for b in by]).agg(F.coalesce(of("count"), F.lit(0.0)).alias("count"), of("sum").alias("sum"))
    shares = quantiles(buckets(samples, name, *by), SUMMARY.values(), *by)
    rows = totals.select(*by, "count", "sum", none.alias("q"), none.alias("value")).unionByName(shares.select(*by, none.alias("count"), none.alias("sum"), "q", "value"))
    out = rows.groupBy(*by).agg(F.max("count").alias("count"), F.max("sum").alias("sum"), *[F.max(F.when(F.col("q") == q, finite(F.col("value")))).alias(p) for p, q in SUMMARY.items()])
    mean = F.when(F.col("count") > 0, F.col("sum") / F.col("count"))
    return out.where(F.col("count").isNotNull()).select(*by, "count", mean.alias("mean"), *SUMMARY)


#: What a report calls each series, and the label that splits it.
SUMS = {
    "files": ("sync_files_total", "outcome"),
    "events": ("sync_events_total", "source"),
    "retries": ("sync_retries_total", "reason"),
    "bytes_copied": ("sync_bytes_copied_total", None),
    "bytes_uploaded": ("sync_bytes_uploaded_total", None),
    "queue_depth": ("sync_queue_depth", None),
    "oldest_pending_seconds": ("sync_oldest_pending_seconds", None),
}
HISTOGRAMS = {"lag_seconds": "sync_lag_seconds", "copy_seconds": "sync_copy_duration_seconds"}
STARTED = "process_start_time_seconds"


def report(samples: DataFrame, at: Column, sums=SUMS, histograms=HISTOGRAMS, started: str = STARTED) -> DataFrame:
    """pipeline, figure, part, value: everything that a scrape says of each pipeline.

    Sums by the label that splits them, one pass for all; count, mean and quantiles of the histograms; and from the
    process's start the uptime at a time and the average of bytes copied per second, for every pipeline with bytes.
    """
    name, figure, part = F.col("name"), F.lit(None).cast("string"), F.lit("")
    for said, (series_name, by) in sums.items():
        figure = F.when(name == series_name, said).otherwise(figure)
        part = F.when(name == series_name, label(by)).otherwise(part) if by else part
    rows = samples.where(name.isin(*[s for s, _ in sums.values()])).groupBy(label("pipeline").alias("pipeline"), figure.alias("figure"), part.alias("part")).agg(F.sum("value").alias("value"))
    for said, series_name in histograms.items():
        got = summary(samples, series_name, "pipeline")
        unpivoted = got.unpivot(["pipeline"], ["count", "mean", *SUMMARY], "part", "value").where("value IS NOT NULL")
        rows = rows.unionByName(unpivoted.select("pipeline", F.lit(said).alias("figure"), "part", "value"))
    uptime = F.unix_micros(at.cast("timestamp")) / 1e6 - F.col("start")
    alive = samples.where(name == started).agg(F.sum("value").alias("start")).where("start > 0").select(uptime.alias("uptime"), F.lit(1).alias("one"))  # one row at most
    copied = sums["bytes_copied"][0]
    per_second = series(samples, copied).groupBy(label("pipeline").alias("pipeline")).agg(F.sum("value").alias("bytes"), F.lit(1).alias("one")).join(alive.where("uptime > 0"), "one")
    return rows.unionByName(alive.select(F.lit("").alias("pipeline"), F.lit("uptime_seconds").alias("figure"), F.lit("").alias("part"), F.col("uptime").alias("value"))).unionByName(
        per_second.select("pipeline", F.lit("bytes_per_second").alias("figure"), F.lit("").alias("part"), (F.col("bytes") / F.col("uptime")).alias("value"))
    )


def two_scrape_rate(samples: DataFrame, name: str, first, second) -> DataFrame:
    """Change of a counter per second between two scrapes, per pipeline; resets are not handled."""
    at = lambda t: F.coalesce(F.sum(F.when(F.col("scraped_at") == t, F.col("value"))), F.lit(0.0))
    rows = series(samples, name).groupBy(label("pipeline").alias("pipeline")).agg(at(first).alias("a"), at(second).alias("b"))
    return rows.select("pipeline", ((F.col("b") - F.col("a")) / seconds_between(second, first)).alias("per_second"))


def increases(samples: DataFrame, series_key: str = "series") -> DataFrame:
    """samples(series, at, value) with the increase since the scrape before; a counter that fell has started anew."""
    w = Window.partitionBy(series_key).orderBy("at")
    before = F.lag("value").over(w)
    return samples.withColumn("increase", F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def rate(samples: DataFrame, seconds: int, series_key: str = "series") -> DataFrame:
    """series, window start, increase and rate per second in tumbling windows."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")
    return increases(samples, series_key).groupBy(series_key, start.alias("start")).agg(F.sum("increase").alias("increase")).withColumn("rate", F.col("increase") / seconds)


def outcome_counters(attempts: DataFrame) -> DataFrame:
    """attempts(pipeline_id, outcome, bytes): files by outcome, bytes of synced ones."""
    return attempts.groupBy("pipeline_id", "outcome").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.when(F.col("outcome") == "synced", F.col("bytes"))), F.lit(0)).alias("bytes_copied"))


def retry_counters(retries: DataFrame) -> DataFrame:
    """retries(pipeline_id, op, reason): how often each operation was tried again, and why."""
    return retries.groupBy("pipeline_id", "op", "reason").agg(F.count("*").alias("retries"))


def event_counters(changes: DataFrame) -> DataFrame:
    """changes(pipeline_id, origin, kind): events by where they come from and what they say."""
    return changes.groupBy("pipeline_id", F.col("origin").alias("source"), "kind").agg(F.count("*").alias("events"))


def reconcile_counters(runs: DataFrame) -> DataFrame:
    """runs(pipeline_id, result, listed, emitted, deletes, seconds) by result."""
    return runs.groupBy("pipeline_id", "result").agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in ("listed", "emitted", "deletes")], (F.sum("seconds") / F.count("*")).alias("avg_seconds"))


def rate_windows(attempts: DataFrame, seconds: int) -> DataFrame:
    """attempts(pipeline_id, outcome, bytes, at) in tumbling windows, as a batch or a stream."""
    w = F.window("at", f"{seconds} seconds")
    return attempts.groupBy("pipeline_id", "outcome", w).agg((F.count("*") / seconds).alias("files_per_second"),
        (F.sum("bytes") / seconds).alias("bytes_per_second")).select("pipeline_id", "outcome", F.col("window.start").cast("timestamp_ntz").alias("start"), "files_per_second", "bytes_per_second")


def phase_attribution(files: DataFrame, phases: DataFrame, seconds: int = 3600) -> DataFrame:
    """files(.., synced_at) with the phase(name, start, stop) in which they were synced.

    Phases are cut at multiples of seconds, so that the join has a key and holds any number of phases; Spark broadcasts
    them where they are small.
    """
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    cuts = phases.where("start < stop").select(F.col("name").alias("phase"), "start", "stop", F.explode(F.sequence(slot("start"), slot("stop"))).alias("__slot"))
    inside = (F.col("synced_at") >= F.col("start")) & (F.col("synced_at") < F.col("stop"))
    return files.withColumn("__slot", slot("synced_at")).join(cuts, "__slot").where(inside).drop("start", "stop", "__slot")
