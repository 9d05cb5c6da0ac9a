"""Queries of joins, aggregations, windows, sorts, sets and state transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.versions import moment
from tidemark.operators import events, metrics, ordering, reconcile, record, specs, status, verify, work
from tidemark.plans.catalog import now, query
from tidemark.plans.scalar_queries import duck_newer, duck_versions
from tidemark.shared import fresh_path
from tidemark.sources import snapshots

T0 = "TIMESTAMP '2024-02-01'"
DIFF = """SELECT coalesce(l.pipeline_id, r.pipeline_id) AS pipeline_id, coalesce(l.key, r.key) AS key, l.key IS NOT NULL AS listed, r.key IS NOT NULL AS known, r.status,
    CASE WHEN r.key IS NULL THEN 'upsert' WHEN l.key IS NULL AND r.status <> 'deleted' THEN 'delete_candidate' WHEN l.key IS NULL THEN 'none'
         WHEN r.status <> 'deleted' AND r.synced_version <> '' AND r.synced_version = l.version THEN 'already_synced' ELSE 'upsert' END AS action,
    CASE WHEN l.key IS NOT NULL AND r.key IS NOT NULL AND NOT (r.status <> 'deleted' AND r.synced_version <> '' AND r.synced_version = l.version)
         THEN coalesce(r.status = 'copying' AND r.claimed_until > TIMESTAMP '2024-02-01', false) ELSE false END AS in_flight
    FROM (SELECT * FROM listing WHERE key NOT LIKE '%/tmp/%') l FULL OUTER JOIN (SELECT * FROM record WHERE key NOT LIKE '%/tmp/%') r ON l.pipeline_id = r.pipeline_id AND l.key = r.key"""
LAST = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY written_at DESC, ord DESC, sha256 DESC, size DESC) AS rn
    FROM manifest) WHERE rn = 1"""
TIES = ("ord", "sha256", "size")
VERIFIED = f"""SELECT m.key, m.size, coalesce(d.sha256, '') AS d_sha, CASE WHEN d.key IS NULL THEN 'missing' WHEN m.size <> d.size THEN 'size_mismatch' WHEN lower(d.sha256) <> m.sha256 THEN 'sha256_mismatch' ELSE 'ok' END AS outcome,
    CASE WHEN m.size = d.size AND lower(d.sha256) = m.sha256 THEN epoch(d.mod_time) - epoch(m.written_at) END AS lag_seconds FROM ({LAST}) m LEFT JOIN destination d USING (key)"""


def diffed(t):
    return reconcile.diff(t.listing, t.record, now(), exclude=["**/tmp/**"])


def last(t):
    return verify.last_writes(t.manifest, *TIES).drop("writes")


def verified(t):
    return verify.verify(last(t).select("key", "size", "sha256", "written_at"), t.destination)


@query("listing record", f"SELECT pipeline_id, key, action, in_flight FROM ({DIFF})")
def jn1_reconcile_diff(t):
    return diffed(t).select("pipeline_id", "key", "action", "in_flight")


@query("listing record", f"SELECT pipeline_id, key, action, in_flight FROM ({DIFF})")
def jn1_bucketed_diff(t):
    """Listing and record in the same buckets: the join moves no row."""
    left, right = fresh_path(t.spark, "listed"), fresh_path(t.spark, "recorded")
    snapshots.write_buckets(t.listing.select("pipeline_id", "key", "version", "mod_time"), left, 16)
    snapshots.write_buckets(t.record.select("pipeline_id", "key", "synced_version", "status", "claimed_until"), right, 16)
    rows = reconcile.diff(snapshots.read_buckets(t.spark, left), snapshots.read_buckets(t.spark, right), now(), exclude=["**/tmp/**"])
    return rows.select("pipeline_id", "key", "action", "in_flight")


@query("listing record", f"SELECT pipeline_id, key FROM ({DIFF}) WHERE action = 'delete_candidate' AND key NOT LIKE '%00.txt'")
def jn2_confirm_deletes(t):
    gone = diffed(t).where("action = 'delete_candidate'")
    return reconcile.confirm(gone, t.record.where("key LIKE '%00.txt'")).select("pipeline_id", "key")


@query("listing record", f"SELECT action, count(*) AS n FROM ({DIFF}) GROUP BY action")
def jn3_misordered_lookup(t):
    """The join does not depend on the order in which a side arrives: here the listing comes backwards."""
    backwards = t.listing.orderBy(F.desc("key"))
    return reconcile.diff(backwards, t.record, now(), exclude=["**/tmp/**"]).groupBy("action").agg(F.count("*").alias("n"))


@query(
    "manifest destination",
    f"SELECT key, size, outcome, CASE WHEN outcome IN ('ok', 'sha256_mismatch') AND d_sha <> '' THEN size ELSE 0 END AS bytes_hashed, lag_seconds FROM ({VERIFIED})",
)
def jn4_manifest_verify(t):
    return verified(t).select("key", "size", "outcome", "bytes_hashed", "lag_seconds")


@query(
    "manifest destination",
    f"SELECT m.key, CASE WHEN d.key IS NULL THEN 'missing' WHEN m.size <> d.size THEN 'size_mismatch' WHEN d.sha256 <> '' AND lower(d.sha256) <> m.sha256 THEN 'sha256_mismatch' ELSE 'ok' END AS outcome FROM ({LAST}) m LEFT JOIN destination d USING (key)",
)
def jn5_manifest_verify_size_only(t):
    return verify.verify(last(t).select("key", "size", "sha256", "written_at"), t.destination, size_only=True).select("key", "outcome")


@query(
    "messages targets",
    """SELECT e.event_id AS message_id, t.pipeline_id, substr(concat('data/u', e.user_id, '/a b+c.json'), length(t.prefix) + 1) AS key
       FROM events e JOIN targets t ON t.container = concat('c', e.user_id % 3) AND starts_with(concat('data/u', e.user_id, '/a b+c.json'), t.prefix)
       WHERE e.event_type <> 'view' AND e.event_id % 41 <> 0 AND e.event_id % 53 <> 0 AND t.account % 5 <> 0
         AND NOT (t.account % 7 = 0 AND substr(concat('data/u', e.user_id, '/a b+c.json'), length(t.prefix) + 1) NOT LIKE '%/%')
         AND (t.account <> 4 OR regexp_full_match(concat('u', e.user_id), 'u1[0-9]*|u2[0-9]'))""",
)
def jn6_event_routing(t):
    exclude = F.when(F.col("account") % 5 == 0, F.array(F.lit("**/a b+*"), F.lit("u7*/**"))).when(F.col("account") % 7 == 0, F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))
    include = F.when(F.col("account") == 4, F.array(F.lit("u1*/*"), F.lit("u2?/**"))).otherwise(F.array().cast("array<string>"))
    targets = events.with_globs(t.targets.withColumns({"include": include, "exclude": exclude}))
    spread = t.messages.repartition(t.spark.sparkContext.defaultParallelism)  # the table is one file, and parsing is the work
    return events.route(events.parse_messages(spread), targets).select("message_id", "pipeline_id", "key")


CLAIM = f"""SELECT arrival, CASE WHEN d = 'copy' AND row_number() OVER (PARTITION BY pipeline_id, key, d ORDER BY arrival) > 1 THEN 'busy' ELSE d END AS decision,
    CASE WHEN d = 'copy' AND row_number() OVER (PARTITION BY pipeline_id, key, d ORDER BY arrival) = 1 THEN CASE WHEN coalesce(source_version, '') = version THEN coalesce(attempts, 0) + 1 ELSE 1 END END AS attempts
    FROM (SELECT c.*, r.source_version, r.attempts, CASE WHEN r.key IS NULL THEN 'copy' WHEN status <> 'deleted' AND synced_version <> '' AND synced_version = version THEN 'already_synced'
    WHEN synced_version <> '' AND synced_version <> version AND ({duck_versions("c.sequencer", "c.mtime", "synced_sequencer", "synced_mtime")}) < 0 THEN 'stale'
    WHEN status = 'copying' AND claimed_until > {T0} AND source_version <> version AND ({duck_versions("c.sequencer", "c.mtime", "source_sequencer", "source_mtime")}) < 0 THEN 'stale'
    WHEN status = 'copying' AND claimed_until > {T0} THEN 'busy' ELSE 'copy' END AS d FROM candidates c LEFT JOIN full_record r USING (pipeline_id, key))"""


@query("candidates full_record", CLAIM)
def jn7_claim_join(t):
    return record.claim(t.candidates, t.full_record, now()).select("arrival", "decision", "attempts")


RUNNING = """SELECT concat(CASE WHEN account % 7 = 0 THEN 'x' ELSE '' END, name) AS name, CASE WHEN account % 5 = 0 THEN revision + 1
    ELSE revision END AS revision FROM specs WHERE account % 4 <> 1"""


@query(
    "specs",
    f"""SELECT coalesce(s.name, r.name) AS name, CASE WHEN r.name IS NULL AND enabled THEN 'start' WHEN r.name IS NULL THEN 'none' WHEN s.name IS NULL THEN 'stop (deleted)' WHEN NOT enabled THEN 'stop (disabled)'
        WHEN s.revision <> r.revision THEN 'restart' ELSE 'keep' END AS action FROM specs s FULL OUTER JOIN ({RUNNING}) r ON s.name = r.name""",
)
def jn8_spec_diff(t):
    t.specs  # noqa: B018
    return specs.diff(t.specs, t.spark.sql(RUNNING))


@query("record", "SELECT pipeline_id, key FROM record WHERE length(key) % 3 = 0 AND status = 'synced'")
def jn9_snapshot_compare(t):
    moved = F.expr("length(key) % 3 = 0 AND status = 'synced'")
    after = t.record.withColumn("synced_at", F.when(moved, F.expr("synced_at + INTERVAL '1' HOUR")).otherwise(F.col("synced_at")))
    return reconcile.snapshot_compare(t.record, after).select("pipeline_id", "key")


@query(
    "manifest destination",
    f"""SELECT m.key, CASE WHEN d.key IS NULL THEN 'no_record' WHEN m.size <> d.size THEN 'size' WHEN m.sha256 <> lower(d.sha256) THEN 'sha256'
       ELSE 'ok' END AS agreement FROM ({LAST}) m LEFT JOIN destination d USING (key)""",
)
def jn10_manifest_record_agreement(t):
    return verify.record_agreement(last(t), t.destination.withColumnRenamed("size", "source_size"))


def objects(t):
    from tidemark.functions.text import MIB, part_layout

    n = F.expr("CAST(floor(o_totalprice) AS BIGINT) * 2003")
    return t.orders.select(F.col("o_orderkey").cast("string").alias("key"), n.alias("size"), part_layout(n, F.lit(8 * MIB)).alias("layout"))


PARTS = 'SELECT CAST(o_orderkey AS VARCHAR) AS key, number, (number - 1) * 8388608 AS "at", least(8388608, n - (number - 1) * 8388608) AS length FROM (SELECT o_orderkey, n, unnest(range(1, (n + 8388607) // 8388608 + 1)) AS number FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 2003 AS n FROM orders))'


@query(
    "",
    f"""SELECT key, bool_and(NOT (number % 5 = 0 AND CAST(key AS BIGINT) % 3 = 0)) AS usable, count(*) AS parts, count(*) FILTER (number % 2 = 1 OR number % 5 = 0) AS uploaded,
        CASE WHEN bool_and(NOT (number % 5 = 0 AND CAST(key AS BIGINT) % 3 = 0)) THEN count(*) - count(*) FILTER (number % 2 = 1 OR number % 5 = 0) ELSE count(*) END AS missing FROM ({PARTS}) GROUP BY key""",
)
def jn11_resume_part_match(t):
    plan = work.part_plan(objects(t))
    bad = F.expr("number % 5 = 0 AND CAST(key AS BIGINT) % 3 = 0")
    up = plan.where("number % 2 = 1 OR number % 5 = 0").withColumn("length", F.when(bad, F.col("length") + 1).otherwise(F.col("length")))
    return work.resume_layout(objects(t), up)


PHASES = """SELECT concat('phase-', event_id % 1500) AS name, {0} '2024-01-01' + (event_id % 1500) * INTERVAL '20' MINUTE AS start,
    {0} '2024-01-01' + (event_id % 1500 + 1) * INTERVAL '20' MINUTE - (event_id % 1500 % 4) * INTERVAL '5' MINUTE AS stop FROM events
    GROUP BY event_id % 1500"""


@query("record", f"SELECT r.key, p.name AS phase FROM record r JOIN ({PHASES.format('TIMESTAMP')}) p ON synced_at >= start AND synced_at < stop")
def jn13_phase_attribution(t):
    t.events  # noqa: B018
    return metrics.phase_attribution(t.record.select("key", "synced_at"), t.spark.sql(PHASES.format("TIMESTAMP_NTZ"))).select("key", "phase")


@query("jobs", "SELECT job_id, CASE pipeline_id WHEN 'users-0' THEN 'run' WHEN 'users-1' THEN 'snooze' ELSE 'cancel' END AS runtime FROM jobs")
def jn14_job_runtime_state(t):
    names = t.jobs.select("pipeline_id").distinct()
    return work.runtime_state(t.jobs, names.where("pipeline_id = 'users-0'"), names.where("pipeline_id <> 'users-2'")).select("job_id", "runtime")


STATS = """SELECT pipeline_id, count(*) FILTER (status = 'synced') AS synced, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'copying') AS copying, count(*) FILTER (status = 'failed') AS failed,
    CAST(coalesce(sum(source_size) FILTER (status = 'synced'), 0) AS BIGINT) AS bytes_synced, max(synced_at) AS last_synced_at, min(event_time) FILTER (status IN ('pending', 'copying')) AS oldest_event FROM record GROUP BY 1"""


@query("record", STATS)
def ag1_pipeline_stats(t):
    return status.pipeline_stats(t.record)


@query(
    "record",
    f"""WITH s AS ({STATS}), e AS (SELECT pipeline_id, string_agg(key || ': ' || last_error, '; ' ORDER BY nth) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY updated_at DESC, key) AS nth
        FROM record WHERE status = 'failed' OR last_error <> '') WHERE nth <= 5 GROUP BY 1), p AS (SELECT DISTINCT concat('docs-', lang) AS pipeline_id FROM documents UNION ALL SELECT 'docs-none')
        SELECT p.pipeline_id, true AS enabled, 3 AS revision, coalesce(synced, 0) AS synced, coalesce(pending, 0) AS pending, coalesce(copying, 0) AS copying, coalesce(failed, 0) AS failed, coalesce(bytes_synced, 0) AS bytes_synced,
               last_synced_at, greatest(coalesce(epoch({T0}) - epoch(oldest_event), 0), 0) AS current_lag_seconds, coalesce(errors, '') AS errors FROM p LEFT JOIN s USING (pipeline_id) LEFT JOIN e USING (pipeline_id)""",
)
def ag2_status_report(t):
    p = t.documents.select(F.concat(F.lit("docs-"), "lang").alias("pipeline_id")).distinct().union(t.spark.sql("SELECT 'docs-none'"))
    return status.status_report(p.select("pipeline_id", F.lit(True).alias("enabled"), F.lit(3).alias("revision")), t.record, now())


@query(
    "record",
    f"""SELECT p.pipeline_id, coalesce(max(epoch({T0}) - epoch(event_time)) FILTER (status IN ('pending', 'copying')), 0) AS oldest_pending_seconds
       FROM (SELECT DISTINCT pipeline_id FROM record UNION ALL SELECT 'docs-none') p LEFT JOIN record r USING (pipeline_id) GROUP BY 1""",
)
def ag3_oldest_pending(t):
    return status.oldest_pending(t.record, t.record.select("pipeline_id").distinct().union(t.spark.sql("SELECT 'docs-none'")), now())


@query(
    "jobs",
    """SELECT p.pipeline_id, count(*) FILTER (state IN ('available', 'scheduled', 'retryable', 'running')) AS depth
       FROM (SELECT DISTINCT pipeline_id FROM jobs UNION ALL SELECT 'none') p LEFT JOIN jobs USING (pipeline_id) GROUP BY 1""",
)
def ag4_queue_depth(t):
    return status.queue_depth(t.jobs, t.jobs.select("pipeline_id").distinct().union(t.spark.sql("SELECT 'none'")))


@query(
    "listing record",
    f"""SELECT pipeline_id, count(*) FILTER (listed) AS listed, count(*) FILTER (action = 'upsert') AS emitted,
       count(*) FILTER (action = 'delete_candidate') AS deleted, count(*) FILTER (action = 'already_synced') AS already_synced,
       count(*) FILTER (in_flight) AS in_flight, CAST(0 AS BIGINT) AS ignored FROM ({DIFF}) GROUP BY 1""",
)
def ag5_reconcile_stats(t):
    return reconcile.stats(diffed(t), "pipeline_id")


@query(
    "listing record",
    f"""SELECT pipeline_id, count(*) FILTER (listed AND pipeline_id <> 'docs-de') AS listed, count(*) FILTER (known
       AND status <> 'deleted') AS live, CASE WHEN pipeline_id = 'docs-de' AND count(*) FILTER (known AND status <> 'deleted') > 0 THEN 'refuse'
       ELSE 'ok' END AS verdict FROM ({DIFF}) WHERE known OR pipeline_id <> 'docs-de' GROUP BY 1""",
)
def ag6_empty_source_guard(t):
    return reconcile.empty_source_guard(reconcile.diff(t.listing.where("pipeline_id <> 'docs-de'"), t.record, now(), exclude=["**/tmp/**"]))


GONE = """SELECT pipeline_id, count(*) FILTER (status <> 'deleted' AND (NOT listed
    OR length(key) % 2 = 0)) AS gone, count(*) FILTER (status <> 'deleted') AS live
    FROM (SELECT r.pipeline_id, r.key, r.status, l.key IS NOT NULL AS listed FROM record r LEFT JOIN listing l USING (pipeline_id, key))
    GROUP BY 1"""


@query("listing record", f"SELECT *, CASE WHEN gone > 100 AND gone * 4 > live THEN 'refuse' ELSE 'ok' END AS verdict FROM ({GONE})")
def ag7_mass_delete_guard(t):
    d = reconcile.diff(t.listing.where("length(key) % 2 = 1"), t.record, now())
    return reconcile.mass_delete_guard(d.where("action = 'delete_candidate'"), d)


@query(
    "manifest",
    """SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(written_at) AS first_write, max(written_at) AS last_write,
       max(size) AS max_size, sum(size) / (epoch(max(written_at)) - epoch(min(written_at))) AS bytes_per_second FROM manifest""",
)
def ag8_load_summary(t):
    return verify.load_summary(t.manifest)


@query(
    "manifest destination",
    f"""SELECT count(*) AS files, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'missing') AS missing,
       count(*) FILTER (outcome = 'size_mismatch') AS size_mismatch, count(*) FILTER (outcome = 'sha256_mismatch') AS sha256_mismatch,
       CAST(sum(size) FILTER (outcome = 'ok') AS BIGINT) AS bytes, count(*) FILTER (outcome = 'error') AS errors, CAST(sum(CASE
       WHEN outcome IN ('ok', 'sha256_mismatch') AND d_sha <> '' THEN size ELSE 0 END) AS BIGINT) AS bytes_hashed, false AS passed,
       100.0 * count(*) FILTER (outcome = 'ok') / count(*) AS ok_pct FROM ({VERIFIED})""",
)
def ag9_verify_summary(t):
    return verify.summary(verified(t))


@query(
    "manifest destination",
    f"""SELECT quantile_disc(lag_seconds, 0.5) AS p50, quantile_disc(lag_seconds, 0.95) AS p95, quantile_disc(lag_seconds, 0.99) AS p99,
       max(lag_seconds) AS max FROM ({VERIFIED})""",
)
def ag10_exact_quantiles(t):
    return verify.quantiles(verified(t), "lag_seconds")


def samples(t):
    from tidemark.sources.readers import metric_samples

    return metric_samples(t.metrics_text.select("line_no", "scraped_at", "line"))


LINES = """SELECT line_no, regexp_extract(line,
    '^([^{ ]+)', 1) AS name, regexp_extract(line, 'outcome="(\\w+)', 1) AS outcome, regexp_extract(line, 'pipeline="([^"]*)"', 1) AS pipeline, regexp_extract(line, 'le="([^"]*)"', 1) AS le, regexp_extract(line, 'source="([^"]*)"', 1) AS source, regexp_extract(line, 'reason="([^"]*)"', 1) AS reason, TRY_CAST(regexp_extract(replace(line, ' 1700000000', ''), '([^ ]+)$', 1) AS DOUBLE) AS value FROM metrics_text WHERE line <> '' AND line NOT LIKE '#%'"""


@query("metrics_text", f"SELECT sum(value) AS total FROM ({LINES}) WHERE name = 'sync_files_total' AND pipeline = 'p1'")
def ag11_sum_series(t):
    return metrics.sum_series(samples(t), "sync_files_total", pipeline="p1", absent="")


@query("metrics_text", f"SELECT pipeline, sum(value) AS total FROM ({LINES}) WHERE name = 'sync_files_total' GROUP BY 1")
def ag12_sum_by_label(t):
    return metrics.sum_by(samples(t), "sync_files_total", "pipeline")


def bounds_sql(bounds) -> str:
    return ", ".join(f"({b}::DOUBLE)" for b in bounds) + ", ('Infinity'::DOUBLE)"


@query(
    "attempts",
    f"""SELECT pipeline_id, le, CAST(count(*) FILTER (lag_seconds <= le) AS DOUBLE) AS count FROM (SELECT * FROM attempts WHERE outcome = 'synced'
       AND lag_seconds > 0), (VALUES {bounds_sql(metrics.LAG_BOUNDS)}) b(le) GROUP BY 1, 2""",
)
def ag13_histogram_build(t):
    return metrics.observe(t.attempts.where("outcome = 'synced' AND lag_seconds > 0"), "lag_seconds", metrics.LAG_BOUNDS, "pipeline_id")


def ag13(bounds) -> str:
    return f"SELECT pipeline_id, le, CAST(count(*) FILTER (lag_seconds <= le) AS DOUBLE) AS count FROM (SELECT * FROM attempts WHERE outcome = 'synced'), (VALUES {bounds_sql(bounds)}) b(le) GROUP BY 1, 2"


@query("attempts", ag13(metrics.DURATION_BOUNDS))
def ag13_duration_buckets(t):
    return metrics.observe(t.attempts.where("outcome = 'synced'"), "lag_seconds", metrics.DURATION_BOUNDS, "pipeline_id")


@query("attempts", ag13(metrics.RECONCILE_BOUNDS))
def ag13_reconcile_buckets(t):
    return metrics.observe(t.attempts.where("outcome = 'synced'"), "lag_seconds", metrics.RECONCILE_BOUNDS, "pipeline_id")


@query(
    "attempts",
    """SELECT pipeline_id, sum(lag_seconds) AS sum, count(*) AS count FROM attempts WHERE outcome = 'synced' AND lag_seconds > 0 GROUP BY 1""",
)
def ag13_histogram_sums(t):
    return metrics.histogram_sums(t.attempts.where("outcome = 'synced' AND lag_seconds > 0"), "lag_seconds", "pipeline_id")


HIST = f"""SELECT pipeline, CASE le WHEN '+Inf' THEN CAST('Infinity' AS DOUBLE) ELSE TRY_CAST(le AS DOUBLE) END AS le, sum(value) AS count
    FROM ({LINES}) WHERE name = 'sync_lag_seconds_bucket' AND le <> 'x' GROUP BY 1, 2"""


@query("metrics_text", HIST)
def ag14_histogram_merge(t):
    return metrics.buckets(samples(t), "sync_lag_seconds", "pipeline")


def quantile_sql(hist: str, by: str, q: float) -> str:
    return f"""SELECT {by}, CAST({q} AS DOUBLE) AS q, CASE WHEN any_value(n) < 2 OR any_value(top) <> CAST('Infinity' AS DOUBLE) OR any_value(total) = 0 THEN CAST('NaN' AS DOUBLE)
        WHEN min(le) FILTER (hit) IS NULL THEN max(le) FILTER (le < CAST('Infinity' AS DOUBLE)) WHEN arg_min(nth, le) FILTER (hit) = 1 AND min(le) FILTER (hit) <= 0 THEN min(le) FILTER (hit)
        ELSE arg_min(start, le) FILTER (hit) + (min(le) FILTER (hit) - arg_min(start, le) FILTER (hit)) * (({q} * any_value(total) - arg_min(before, le) FILTER (hit)) / (arg_min(c, le) FILTER (hit) - arg_min(before, le) FILTER (hit))) END AS value
        FROM (SELECT *, le < CAST('Infinity' AS DOUBLE) AND c >= {q} * total AS hit FROM (SELECT *, max(c) OVER (PARTITION BY {by}) AS total, max(le) OVER (PARTITION BY {by}) AS top, count(*) OVER (PARTITION BY {by}) AS n, row_number() OVER (PARTITION BY {by} ORDER BY le) AS nth, coalesce(lag(le) OVER (PARTITION BY {by} ORDER BY le), 0) AS start, coalesce(lag(c) OVER (PARTITION BY {by} ORDER BY le), 0) AS before
        FROM (SELECT {by}, le, max(count) OVER (PARTITION BY {by} ORDER BY le) AS c FROM ({hist})))) GROUP BY {by}"""


LAG_HIST = f"""SELECT pipeline_id, le, CAST(count(*) FILTER (lag_seconds <= le) AS DOUBLE) AS count
    FROM attempts, (VALUES {bounds_sql(metrics.LAG_BOUNDS)}) b(le) GROUP BY 1, 2"""


@query("attempts", " UNION ALL ".join(quantile_sql(LAG_HIST, "pipeline_id", q) for q in (0.5, 0.95, 0.99)))
def ag15_histogram_quantile(t):
    h = metrics.observe(t.attempts, "lag_seconds", metrics.LAG_BOUNDS, "pipeline_id")
    return metrics.quantiles(h, (0.5, 0.95, 0.99), "pipeline_id")


@query(
    "metrics_text",
    f"""SELECT pipeline, count, mean, p50, p95, p99 FROM (SELECT pipeline, coalesce(sum(value) FILTER (name = 'sync_lag_seconds_count'), 0) AS count, CASE WHEN sum(value) FILTER (name = 'sync_lag_seconds_count') > 0 THEN sum(value) FILTER (name = 'sync_lag_seconds_sum') / sum(value) FILTER (name = 'sync_lag_seconds_count') END AS mean
        FROM ({LINES}) WHERE name IN ('sync_lag_seconds_count', 'sync_lag_seconds_sum') GROUP BY 1) LEFT JOIN (SELECT pipeline, CASE WHEN isfinite(value) THEN value END AS p50 FROM ({quantile_sql(HIST, "pipeline", 0.5)})) USING (pipeline)
        LEFT JOIN (SELECT pipeline, CASE WHEN isfinite(value) THEN value END AS p95 FROM ({quantile_sql(HIST, "pipeline", 0.95)})) USING (pipeline)
        LEFT JOIN (SELECT pipeline, CASE WHEN isfinite(value) THEN value END AS p99 FROM ({quantile_sql(HIST, "pipeline", 0.99)})) USING (pipeline)""",
)
def ag16_histogram_summary(t):
    return metrics.summary(samples(t), "sync_lag_seconds", "pipeline")


@query(
    "metrics_text",
    f"""SELECT sum(value) FILTER (name = 'sync_lag_seconds_count') AS count, p50 FROM ({LINES}), (SELECT CASE WHEN isfinite(value)
       THEN value END AS p50 FROM ({quantile_sql('SELECT 0 AS one, le, sum(count) AS count FROM (' + HIST + ') GROUP BY 1, 2', 'one', 0.5)}))
       GROUP BY p50""",
)
def ag16_histogram_summary_of_all(t):
    return metrics.summary(samples(t), "sync_lag_seconds").select("count", "p50")


FIGURES = {"sync_files_total": "outcome", "sync_events_total": "source", "sync_retries_total": "reason"}
SUMS_SQL = f"""SELECT pipeline, CASE name {' '.join(f"WHEN '{s}' THEN '{said}'" for said, (s, _) in metrics.SUMS.items())} END AS figure,
    CASE name WHEN 'sync_files_total' THEN outcome || chr(10) || '"x' WHEN 'sync_events_total' THEN source WHEN 'sync_retries_total' THEN reason ELSE '' END AS part, sum(value) AS value
    FROM ({LINES}) WHERE name IN ({', '.join(f"'{s}'" for s, _ in metrics.SUMS.values())}) GROUP BY 1, 2, 3"""
LAGS_SQL = f"""SELECT pipeline, 'lag_seconds' AS figure, part, value FROM (SELECT pipeline, 'count' AS part, sum(value) AS value FROM ({LINES}) WHERE name = 'sync_lag_seconds_count' GROUP BY 1
    UNION ALL SELECT pipeline, 'mean', sum(value) FILTER (name = 'sync_lag_seconds_sum') / sum(value) FILTER (name = 'sync_lag_seconds_count') FROM ({LINES}) WHERE name LIKE 'sync_lag_seconds_%' GROUP BY 1
    UNION ALL SELECT pipeline, CASE q WHEN 0.5 THEN 'p50' WHEN 0.95 THEN 'p95' ELSE 'p99' END, value FROM ({' UNION ALL '.join(quantile_sql(HIST, "pipeline", q) for q in (0.5, 0.95, 0.99))}) WHERE isfinite(value)) WHERE value IS NOT NULL"""
COPIES_SQL = f"""SELECT pipeline, 'copy_seconds' AS figure, part, value FROM (SELECT pipeline, 'count' AS part, coalesce(sum(value) FILTER (name LIKE '%_count'), 0) AS value FROM ({LINES}) WHERE name LIKE 'sync_copy_duration%' GROUP BY 1
    UNION ALL SELECT pipeline, 'mean', sum(value) FILTER (name LIKE '%_sum') / sum(value) FILTER (name LIKE '%_count') FROM ({LINES}) WHERE name LIKE 'sync_copy_duration%' GROUP BY 1) WHERE value IS NOT NULL"""
UPTIME = "(epoch(TIMESTAMP '2024-02-01') - 1700000000)"


@query(
    "metrics_text",
    f"""{SUMS_SQL} UNION ALL {LAGS_SQL} UNION ALL {COPIES_SQL} UNION ALL SELECT '', 'uptime_seconds', '', CAST({UPTIME} AS DOUBLE)
        UNION ALL SELECT pipeline, 'bytes_per_second', '', sum(value) / {UPTIME} FROM ({LINES}) WHERE name = 'sync_bytes_copied_total' GROUP BY 1""",
)
def ag17_metrics_report(t):
    started = t.metrics_text.limit(0).select("line_no", "scraped_at",
        "line").unionByName(t.spark.range(1).select(F.lit(-1).cast("bigint").alias("line_no"), now().alias("scraped_at"), F.lit("process_start_time_seconds 1700000000").alias("line")))
    from tidemark.sources.readers import metric_samples

    return metrics.report(samples(t).unionByName(metric_samples(started)), now())


@query(
    "attempts",
    """SELECT pipeline_id, outcome, count(*) AS files, CAST(coalesce(sum(bytes) FILTER (outcome = 'synced'), 0) AS BIGINT) AS bytes_copied
       FROM attempts GROUP BY 1, 2""",
)
def ag18_outcome_counters(t):
    return metrics.outcome_counters(t.attempts)


@query(
    "attempts",
    """SELECT pipeline_id, 'copy' AS op, CASE WHEN code = '' THEN 'other' ELSE code END AS reason, count(*) AS retries FROM attempts
       WHERE outcome = 'retry' GROUP BY 1, 2, 3""",
)
def ag18_retry_counters(t):
    reason = F.when(F.col("code") == "", "other").otherwise(F.col("code"))
    return metrics.retry_counters(t.attempts.where("outcome = 'retry'").select("pipeline_id", F.lit("copy").alias("op"), reason.alias("reason")))


@query(
    "changes listing",
    """SELECT pipeline_id, origin AS source, kind, count(*) AS events FROM (SELECT pipeline_id, origin, kind FROM changes
       UNION ALL SELECT pipeline_id, 'reconcile', 'upsert' FROM listing) GROUP BY 1, 2, 3""",
)
def ag18_event_counters(t):
    found = t.listing.select("pipeline_id", F.lit("reconcile").alias("origin"), F.lit("upsert").alias("kind"))
    return metrics.event_counters(t.changes.select("pipeline_id", "origin", "kind").unionByName(found))


RUNS = """SELECT concat('p', o_custkey % 5) AS pipeline_id, CASE WHEN o_orderkey % 9 = 0 THEN 'error'
    ELSE 'ok' END AS result, o_orderkey % 1000 AS listed, o_orderkey % 100 AS emitted, o_orderkey % 10 AS deletes,
    CAST(o_orderkey % 300 AS DOUBLE) AS seconds FROM orders"""


@query(
    "",
    f"""SELECT pipeline_id, result, count(*) AS runs, CAST(sum(listed) AS BIGINT) AS listed, CAST(sum(emitted) AS BIGINT) AS emitted,
       CAST(sum(deletes) AS BIGINT) AS deletes, sum(seconds) / count(*) AS avg_seconds FROM ({RUNS}) GROUP BY 1, 2""",
)
def ag19_reconcile_run_counters(t):
    t.orders  # noqa: B018
    return metrics.reconcile_counters(t.spark.sql(RUNS))


@query(
    "jobs",
    """SELECT pipeline_id, count(*) AS jobs, count(*) FILTER (state = 'available') AS available, count(*) FILTER (state = 'running') AS running,
       count(*) FILTER (state = 'retryable') AS retryable, count(*) FILTER (state = 'scheduled') AS scheduled,
       count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'discarded') AS discarded,
       count(*) FILTER (state = 'cancelled') AS cancelled FROM jobs GROUP BY 1""",
)
def ag20_job_state_counts(t):
    return status.job_states(t.jobs)


@query("", "SELECT round((max(event_id) - min(event_id)) / ((epoch(max(ts)) - epoch(min(ts))) / 3600), 4) AS event_id_per_hour FROM events")
def ag20_growth(t):
    return status.growth(t.events, "ts", "event_id").select(F.round("event_id_per_hour", 4).alias("event_id_per_hour"))


@query(
    "messages",
    """SELECT count(*) AS sampled, count(*) FILTER (message_id % 41 = 0 OR message_id % 53 = 0
       OR message_id % 43 = 0) AS unparsable, 'warn' AS verdict FROM messages""",
)
def ag21_message_health(t):
    return events.message_health(events.parse_messages(t.messages))


@query("", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def ag22_duplicate_check(t):
    return specs.duplicates(t.customer, "c_nationkey")


@query("manifest", LAST)
def wn1_last_write_wins(t):
    return last(t)


@query("manifest", f"SELECT key, sha256 FROM ({LAST})")
def wn1_last_write_ranked(t):
    return verify.last_writes_ranked(t.manifest, *TIES).select("key", "sha256")


@query(
    "record",
    """SELECT * FROM (SELECT pipeline_id, row_number() OVER (PARTITION BY pipeline_id
       ORDER BY updated_at DESC, key) AS nth, key, status, last_error, updated_at FROM record WHERE status = 'failed' OR last_error <> '')
       WHERE nth <= 5""",
)
def wn2_recent_errors(t):
    return status.recent_errors(t.record)


@query(
    "listing",
    """SELECT pipeline_id, arg_min(key, arrival) AS key, arg_min(previous, arrival) AS previous, count(*) AS misordered
       FROM (SELECT *, lag(key) OVER (PARTITION BY pipeline_id ORDER BY arrival) AS previous FROM listing) WHERE key <= previous GROUP BY 1""",
)
def wn3_listing_order_check(t):
    return reconcile.order_check(t.listing)


@query(
    "",
    """SELECT concat('p', user_id % 3) AS pipeline, (coalesce(sum(event_id) FILTER (event_id % 2 = 1),
       0) - coalesce(sum(event_id) FILTER (event_id % 2 = 0), 0)) / 60 AS per_second FROM events GROUP BY 1""",
)
def wn4_two_scrape_rate(t):
    first, second = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:01:00'")
    s = t.events.select(F.lit("bytes").alias("name"), F.create_map(F.lit("pipeline"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"))).alias("labels"), F.col("event_id").cast("double").alias("value"),
            F.when(F.col("event_id") % 2 == 0, first).otherwise(second).alias("scraped_at"))
    return metrics.two_scrape_rate(s, "bytes", first, second)


@query(
    "",
    """SELECT series, start, sum(inc) AS increase, sum(inc) / 3600 AS rate FROM (SELECT concat('s', user_id) AS series, date_trunc('hour', ts) AS start, CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END AS inc
       FROM (SELECT user_id, ts, v, lag(v) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM (SELECT user_id, ts, CAST(max(event_id % 500) AS DOUBLE) AS v FROM events GROUP BY 1, 2))) GROUP BY 1, 2""",
)
def wn5_counter_rate(t):
    s = t.events.groupBy(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("series"), F.col("ts").alias("at")).agg(F.max(F.expr("event_id % 500")).cast("double").alias("value"))
    return metrics.rate(s, 3600)


@query("metrics_text", f"SELECT pipeline, le, max(count) OVER (PARTITION BY pipeline ORDER BY le) AS count FROM ({HIST})")
def wn6_monotone_clamp(t):
    return metrics.clamp(metrics.buckets(samples(t), "sync_lag_seconds", "pipeline"), "pipeline")


@query(
    "changes",
    """SELECT pipeline_id, key, version FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id, key ORDER BY lpad(lower(sequencer), w::INT, '0') DESC, CASE WHEN sequencer = '' THEN event_time END DESC NULLS LAST, arrival DESC) AS nth FROM
       (SELECT *, max(length(sequencer)) OVER k AS w, min(CAST(sequencer <> '' AS INT)) OVER k = max(CAST(sequencer <> '' AS INT)) OVER k AS pure FROM (SELECT * REPLACE (concat(key, CASE WHEN sequencer = '' THEN '/m' ELSE '/s' END) AS key) FROM changes) WINDOW k AS (PARTITION BY pipeline_id, key)) WHERE pure) WHERE nth = 1""",
)
def wn7_newest_version_per_key(t):
    split = t.changes.withColumn("key", F.concat("key", F.expr("CASE WHEN sequencer = '' THEN '/m' ELSE '/s' END")))
    return record.newest(split).select("pipeline_id", "key", "version")


@query("", f'SELECT key, number, "at" FROM ({PARTS})')
def wn8_part_offsets(t):
    return work.part_offsets(work.part_plan(objects(t)).select("key", "number", "length")).select("key", "number", "at")


@query("listing", "SELECT key, row_number() OVER (ORDER BY key) AS place FROM listing")
def st1_byte_order_sort(t):
    return ordering.places(t.listing.select("key"), "key")


@query("manifest destination", f"SELECT key, outcome FROM ({VERIFIED}) WHERE outcome <> 'ok' ORDER BY key LIMIT 20")
def st3_top_failures(t):
    return verify.top_failures(verified(t), 20).select("key", "outcome")


@query(
    "attempts",
    """SELECT pipeline_id, string_agg(outcome || '=' || n, ' ' ORDER BY outcome) AS line FROM (SELECT pipeline_id, outcome, count(*) AS n
       FROM attempts GROUP BY 1, 2) GROUP BY 1""",
)
def st4_fixed_report_order(t):
    return status.counters_line(t.attempts.groupBy("pipeline_id", "outcome").agg(F.count("*").alias("n")), "pipeline_id", "outcome", "n")


@query(
    "changes listing",
    """SELECT pipeline_id, key, version, 'event' AS origin FROM changes UNION ALL SELECT pipeline_id, key, version, 'reconcile' FROM listing""",
)
def so1_union_changes(t):
    cols = ["pipeline_id", "key", "version"]
    return status.union_changes(t.changes.select(*cols), t.listing.select(*cols))


@query("manifest", "SELECT key, ord, CASE WHEN ord < 3 THEN 0 ELSE 1 END AS file_index FROM manifest")
def so2_union_manifests(t):
    m = t.manifest.select("key", "ord")
    return m.where("ord < 3").withColumn("file_index", F.lit(0)).unionByName(m.where("ord >= 3").withColumn("file_index", F.lit(1)))


@query(
    "specs",
    f"""SELECT name, 'start' AS side FROM specs WHERE enabled AND name NOT IN (SELECT name FROM ({RUNNING})) UNION ALL SELECT name, 'stop'
       FROM ({RUNNING}) WHERE name NOT IN (SELECT name FROM specs WHERE enabled)""",
)
def so3_wanted_minus_running(t):
    wanted, running = t.specs.where("enabled").select("name"), t.spark.sql(RUNNING).select("name")
    return status.set_difference(wanted, running, "name").withColumn("side", F.lit("start")).union(status.set_difference(running, wanted, "name").withColumn("side", F.lit("stop")))


JOBS = """SELECT pipeline_id, key, CASE WHEN kind = 'upsert' THEN 'copy' ELSE 'delete' END AS job, version, CASE WHEN kind = 'upsert'
    THEN CAST(floor(epoch(event_time)) AS BIGINT) // 300 ELSE 0 END AS w, arrival FROM changes"""


@query(
    "changes jobs",
    f"""SELECT pipeline_id, key, version, w AS "window", min(arrival) AS arrival FROM ({JOBS}) j WHERE NOT EXISTS (SELECT 1 FROM ({JOBS}) o
       WHERE o.arrival % 3 = 0 AND o.arrival < 1000000000 AND o.pipeline_id = j.pipeline_id AND o.key = j.key AND o.version = j.version
       AND o.w = j.w) GROUP BY 1, 2, 3, 4""",
)
def so4_work_dedupe(t):
    none = t.changes.select("pipeline_id", "key").distinct().withColumn("attempts", F.lit(0))
    jobs = work.emit(t.changes, none)
    held = jobs.where("arrival % 3 = 0 AND arrival < 1000000000").withColumn("state", F.lit("running"))
    return work.dedupe(jobs, held).select("pipeline_id", "key", "version", "window", "arrival")


@query(
    "",
    """SELECT DISTINCT concat('p', user_id % 3) AS pipeline_id, 1 AS revision, CAST(floor(epoch(ts)) AS BIGINT) // 1800 AS "window" FROM events""",
)
def so5_reconcile_dedupe(t):
    ticks = t.events.select(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("pipeline_id"), F.lit(1).alias("revision"), F.col("ts").alias("at"))
    return work.reconcile_jobs(ticks, 900)


STATE = list(record.FIELDS)


def duck_fold(kinds: str) -> str:
    """The ordered fold of ops of these kinds, as a reduction over structs that hold state and operation."""
    a, x = (lambda n: f"a.{n}"), (lambda n: f"x.o_{n}")
    held = "(a.status = 'copying' AND coalesce(a.claimed_until, TIMESTAMP '0001-01-01') > x.o_at)"
    mine = f"({held} AND a.source_version = x.o_version)"
    newer = duck_newer("x.o_sequencer", "x.o_mtime", "x.o_version", "a.source_sequencer", "a.source_mtime", "a.source_version")
    observed = f"(x.o_op = 'observe' AND a.status <> 'copying' AND ({newer}))"
    decision = f"""CASE WHEN a.status <> 'deleted' AND a.synced_version <> '' AND a.synced_version = x.o_version THEN 'n' WHEN a.synced_version <> '' AND a.synced_version <> x.o_version AND
        ({duck_versions("x.o_sequencer", "x.o_mtime", "a.synced_sequencer", "a.synced_mtime")}) < 0 THEN 'n' WHEN {held} THEN 'n' ELSE 'copy' END"""
    claimed = f"(x.o_op = 'claim' AND ({decision}) = 'copy')"
    done, failed, ext, up = (f"(x.o_op = '{o}' AND {mine})" for o in ("complete", "fail", "extend", "set_upload"))
    deleted = "(x.o_op = 'delete' AND (x.o_event_time IS NULL OR x.o_event_time >= coalesce(a.source_mtime, TIMESTAMP '0001-01-01')))"
    moved = f"({observed} OR {claimed})"
    case = lambda *arms: "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in arms) + " ELSE {} END"
    new = {
        "source_version": case((moved, x("version"))), "source_size": case((moved, x("size"))), "source_mtime": case((moved, x("mtime"))), "source_sequencer": case((moved, x("sequencer"))),
        "synced_version": case((done, a("source_version"))), "synced_mtime": case((done, a("source_mtime"))), "synced_sequencer": case((done, a("source_sequencer"))),
        "sha256": case((done, x("detail"))), "dest_version": case((done, x("version"))),
        "status": case((observed, "CASE WHEN a.status = 'synced' AND x.o_version = a.synced_version THEN 'synced' ELSE 'pending' END"),
            (claimed, "'copying'"), (done, "'synced'"), (failed, "CASE WHEN x.o_retryable THEN 'pending' ELSE 'failed' END"), (deleted, "'deleted'")),
        "attempts": case((claimed, "CASE WHEN a.source_version = x.o_version THEN a.attempts + 1 ELSE 1 END")), "last_error": case((done, "''"), (failed, x("detail"))),
        "upload_id": case((done, "''"), (up, x("detail"))), "upload_version": case((done, "''"), (up, x("version"))),
        "claimed_until": case((f"({claimed} OR {ext})", "x.o_at + INTERVAL 2 MINUTE"), (f"({done} OR {failed} OR {deleted})", "NULL")),
        "event_time": case((observed, "CASE WHEN a.status IN ('pending', 'failed') AND a.event_time IS NOT NULL THEN a.event_time ELSE x.o_event_time END"), (claimed, "CASE WHEN a.status NOT IN ('synced', 'deleted') AND a.event_time IS NOT NULL AND (x.o_event_time IS NULL OR a.event_time < x.o_event_time) THEN a.event_time ELSE x.o_event_time END"), (deleted, x("event_time"))),
        "synced_at": case((done, x("at"))),
    }
    types = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}
    ops = {"arrival": "BIGINT", "op": "VARCHAR", "version": "VARCHAR", "size": "BIGINT", "mtime": "TIMESTAMP", "sequencer": "VARCHAR",
        "event_time": "TIMESTAMP", "at": "TIMESTAMP", "retryable": "BOOLEAN", "detail": "VARCHAR"}
    blank = {n: f"CAST({'NULL' if 'NULL' in v else v.replace(' AS BIGINT', '').replace('CAST(', '').replace(')', '') if 'CAST' in v else v} AS {types[ty]})" for n, (ty, v) in record.FIELDS.items()}
    row = lambda state, o: "struct_pack(" + ", ".join([f"{n} := {state(n)}" for n in STATE] + [f"o_{n} := {o(n)}" for n in ops]) + ")"
    start = row(lambda n: blank[n], lambda n: f"CAST(NULL AS {ops[n]})")
    item = row(lambda n: blank[n], lambda n: f'CAST("{n}" AS {ops[n]})')
    step = row(lambda n: f"CAST({new[n].format(a(n))} AS {types[record.FIELDS[n][0]]})", lambda n: x(n))
    return f"SELECT pipeline_id, key, {', '.join(f'r.{n} AS {n}' for n in STATE)} FROM (SELECT pipeline_id, key, list_reduce(list_prepend({start}, list({item} ORDER BY arrival)), lambda a, x: {step}) AS r FROM ops WHERE op IN ({kinds}) GROUP BY 1, 2)"


def folded(t, kinds: str):
    return record.fold(t.ops.where(f"op IN ({kinds})"))


OBSERVE, CLAIMS = "'observe'", "'observe', 'claim'"
LEASES = f"{CLAIMS}, 'extend', 'set_upload'"
COMPLETES = f"{LEASES}, 'complete'"
FAILS = f"{COMPLETES}, 'fail'"
EVERY = f"{FAILS}, 'delete', 'none'"


@query("ops", duck_fold(OBSERVE))
def tr1_observe(t):
    return folded(t, OBSERVE)


@query("ops", duck_fold(CLAIMS))
def tr2_claim(t):
    return folded(t, CLAIMS)


@query("ops", duck_fold(LEASES))
def tr3_extend_lease_set_upload(t):
    return folded(t, LEASES)


@query("ops", duck_fold(COMPLETES))
def tr4_complete(t):
    return folded(t, COMPLETES)


@query("ops", duck_fold(FAILS))
def tr5_fail(t):
    return folded(t, FAILS)


@query("ops", duck_fold(EVERY))
def tr6_mark_deleted(t):
    return folded(t, EVERY)


@query(
    "ops changes",
    f"""SELECT c.pipeline_id, c.key, c.arrival, CASE WHEN kind = 'upsert' THEN 'copy' ELSE 'delete' END AS job, CASE WHEN kind = 'upsert'
       THEN coalesce(r.attempts, 0) ELSE 0 END AS generation, CASE WHEN kind = 'upsert' THEN CAST(floor(epoch(event_time)) AS BIGINT) // 300 ELSE 0 END AS "window"
       FROM changes c LEFT JOIN (SELECT pipeline_id, key, attempts FROM ({duck_fold(CLAIMS)})) r USING (pipeline_id, key)""",
)
def tr7_emit(t):
    """Jobs of changes against a record in which keys have been claimed none, one or several times."""
    return work.emit(t.changes, folded(t, CLAIMS)).select("pipeline_id", "key", "arrival", "job", "generation", "window")


@query(
    "candidates listing",
    """SELECT c.arrival, CASE WHEN l.key IS NULL THEN 'stale' ELSE '' END AS outcome, l.version, CASE WHEN c.version = l.version THEN c.sequencer
       ELSE '' END AS sequencer FROM candidates c LEFT JOIN (SELECT * FROM listing WHERE arrival % 6 <> 0) l USING (pipeline_id, key)""",
)
def tr8_candidate_from_stat(t):
    return work.candidates(t.candidates, t.listing.where("arrival % 6 <> 0")).select("arrival", "outcome", "version", "sequencer")


FAILURES = """CASE event_id % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'lease_lost' WHEN 2 THEN 'interrupted' WHEN 3 THEN 'version_changed' WHEN 4
    THEN 'permission' WHEN 5 THEN 'throttled' WHEN 6 THEN 'auth' ELSE 'other' END"""


@query(
    "",
    """SELECT event_id, ['synced', '', '', '', 'failed', 'retry', 'failed', 'retry'][event_id % 8 + 1] AS outcome, ['done', 'abandon', 'release',
       'retry_now', 'cancel', 'retry_backoff', 'cancel', 'retry_backoff'][event_id % 8 + 1] AS next_step FROM events""",
)
def tr9_copy_outcome(t):
    return t.events.select("event_id", work.copy_outcome(F.expr(FAILURES)).alias("o")).select("event_id", "o.*")


@query(
    "changes",
    """SELECT pipeline_id, key, arrival, pipeline_id = 'users-1' AS remove FROM changes WHERE kind = 'delete' AND key NOT LIKE '%/2.json'""",
)
def tr10_delete_apply(t):
    gone = t.changes.where("kind = 'delete'").select("pipeline_id", "key", "arrival")
    names = t.changes.select("pipeline_id").distinct().withColumn("deletes", F.col("pipeline_id") == "users-1").where("pipeline_id <> 'users-2'")
    return work.apply_deletes(gone, t.changes.where("key LIKE '%/2.json'").select("pipeline_id", "key").distinct(), names)


#: The operations that claimed, and after them the observations of all changes.
THEN_OBSERVED = duck_fold(CLAIMS).replace(
    "FROM ops", f"FROM (SELECT * FROM ops WHERE op IN ({CLAIMS}) UNION ALL SELECT * REPLACE (arrival + 1000000000000 AS arrival) FROM ops WHERE op = 'observe')"
)


@query(
    "ops changes",
    f"""SELECT c.pipeline_id, c.key, c.arrival, r.status, r.source_version, CASE WHEN kind = 'upsert' THEN r.attempts ELSE 0 END AS generation
       FROM changes c JOIN ({THEN_OBSERVED}) r USING (pipeline_id, key)""",
)
def tr7_observe(t):
    """Each change's job with the record as it is when the jobs are made: all observed, on top of what claims have left."""
    changes = t.changes.withColumns({"size": F.col("arrival") % 1000, "mtime": F.col("event_time")})
    observed, jobs = work.observe_and_emit(changes, folded(t, CLAIMS))
    return jobs.join(observed.select("pipeline_id", "key", "status", "source_version"), ["pipeline_id", "key"]).select("pipeline_id", "key", "arrival", "status", "source_version", "generation")


NEW_SPECS = """SELECT CASE WHEN account % 8 = 0 THEN concat(name, '_new') ELSE name END AS name, CASE WHEN account % 3 = 0
    THEN replace(spec, '64MiB', '32MiB') ELSE spec END AS spec FROM specs WHERE account % 2 = 0"""


@query(
    "specs",
    f"""SELECT coalesce(o.name, n.name) AS name, coalesce(o.enabled, true) AS enabled, CASE WHEN o.name IS NULL THEN 1 WHEN n.spec <> o.spec
       THEN o.revision + 1 ELSE o.revision END AS revision, o.name IS NULL OR coalesce(n.spec <> o.spec, false) AS changed FROM specs o FULL OUTER
       JOIN ({NEW_SPECS}) n ON o.name = n.name""",
)
def tr11_spec_upsert(t):
    t.specs  # noqa: B018
    return specs.upsert(t.specs, t.spark.sql(NEW_SPECS)).select("name", "enabled", "revision", "changed")


@query(
    "specs",
    """SELECT name, CASE WHEN account % 2 = 0 THEN account % 4 = 0 ELSE enabled END AS enabled, revision + CASE WHEN account % 2 = 0
       AND (account % 4 = 0) <> enabled THEN 1 ELSE 0 END AS revision FROM specs WHERE account <> 3""",
)
def tr11_spec_enable_delete(t):
    want = t.specs.where("account % 2 = 0").select("name", F.expr("account % 4 = 0").alias("want"))
    return specs.delete(specs.set_enabled(t.specs, want), t.specs.where("account = 3")).select("name", "enabled", "revision")


@query(
    "specs",
    """SELECT name, concat_ws('; ', CASE WHEN NOT regexp_full_match(name, '[a-z0-9]+(-[a-z0-9]+)*') THEN 'name: not a pipeline name' END, 'source.azure.account_url: missing', 'destination: not one store',
              'events.queue_name: the queue is not fully named', CASE WHEN account % 5 = 0 THEN 'part_size: too small' END) AS problems FROM specs""",
)
def tr12_spec_validate(t):
    return specs.validate(t.specs).select("name", F.array_join("problems", "; ").alias("problems"))


@query(
    "",
    """SELECT concat('p', o_custkey) AS pipeline_id, CASE WHEN o_custkey % 3 = 0 THEN TIMESTAMP '1990-01-01'
       ELSE min(o_orderdate) END AS started_at FROM orders GROUP BY o_custkey""",
)
def tr13_first_seen(t):
    starts = t.orders.select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("pipeline_id"), F.col("o_orderdate").alias("started_at"), "o_custkey")
    known = starts.where("o_custkey % 3 = 0").select("pipeline_id", F.expr("TIMESTAMP_NTZ '1990-01-01'").alias("started_at")).distinct()
    return record.first_seen(starts, known)


@query(
    "messages",
    """SELECT message_id, count(*) AS events, count(*) FILTER (message_id % 43 <> 0 AND message_id % 53 <> 0
       AND message_id % 41 <> 0) AS kept_by_message, count(*) FILTER (NOT (message_id % 41 = 0 OR message_id % 53 = 0 AND n = 0
       OR n = 1)) AS kept_by_event FROM (SELECT message_id, unnest(range(CASE WHEN message_id % 43 = 0 AND message_id % 41 <> 0 THEN 2
       ELSE 1 END)) AS n FROM messages) GROUP BY 1""",
)
def str3_malformed_policy(t):
    parsed = events.parse_messages(t.messages)
    by_message = events.apply_policy(parsed, True).groupBy("message_id").agg(F.count("*").alias("events"), F.count_if("keep").alias("kept_by_message"))
    by_event = events.apply_policy(parsed, False).groupBy("message_id").agg(F.count_if("keep").alias("kept_by_event"))
    return by_message.join(by_event, "message_id")


@query("messages", "SELECT message_id FROM messages WHERE delivery_count > 5")
def str4_max_delivery(t):
    from tidemark.sources.sinks import MAX_DELIVERIES

    return t.messages.where(F.col("delivery_count") > MAX_DELIVERIES).select("message_id")


@query("ops", f"SELECT pipeline_id, key, status, source_version FROM ({duck_fold(EVERY)})")
def str8_late_data_fold(t):
    """Two parts of the operations, one after the other into the first part's snapshot, give the fold of all."""
    cut = F.expr("arrival < 20000")
    every = t.ops.where(f"op IN ({EVERY})")
    return record.fold(every.where(~cut), record.fold(every.where(cut))).select("pipeline_id", "key", "status", "source_version")


@query(
    "attempts",
    """SELECT pipeline_id, outcome, date_trunc('minute', finished_at) AS start, count(*) / 60 AS files_per_second,
       sum(bytes) / 60 AS bytes_per_second FROM attempts GROUP BY 1, 2, 3""",
)
def str10_rate_windows(t):
    return metrics.rate_windows(t.attempts.withColumnRenamed("finished_at", "at"), 60)


@query(
    "manifest destination",
    f"""SELECT key, CASE WHEN outcome = 'missing' AND CAST(regexp_extract(key, '(\\d+)', 1) AS BIGINT) % 40 = 0 THEN 'ok'
       ELSE outcome END AS outcome FROM ({VERIFIED})""",
)
def str14_retry_missing(t):
    m = last(t).select("key", "size", "sha256", "written_at", "l_orderkey")
    late = t.destination.select("key", "size", "sha256", "mod_time").unionByName(m.where("l_orderkey % 40 = 0").select("key", "size", "sha256", F.col("written_at").alias("mod_time")))
    return verify.retry_missing(verified(t), m.drop("l_orderkey"), late).select("key", "outcome")


@query("manifest", "SELECT key, count(*) AS writes FROM manifest GROUP BY 1")
def wn1_superseded(t):
    return verify.last_writes(t.manifest, *TIES).select("key", "writes")


@query("record", "SELECT key FROM record WHERE synced_at > TIMESTAMP '0001-01-01' AND claimed_until IS NULL")
def prj3_zero_times(t):
    zero = F.expr("TIMESTAMP_NTZ '0001-01-01 00:00:00'")
    return t.record.where((moment("synced_at") > zero) & (moment("claimed_until") == zero)).select("key")
