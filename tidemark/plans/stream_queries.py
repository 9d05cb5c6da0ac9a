"""Queries of streams, each run to its end over files; where the outcome does not depend on timing, SQL must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import window_at
from tidemark.operators import events, metrics, work
from tidemark.plans.catalog import now, query
from tidemark.plans.table_queries import CLAIMS, DIFF, EVERY, VERIFIED, bounds_sql, duck_fold, last
from tidemark.shared import cut, fresh_path
from tidemark.sources import queue
from tidemark.streaming import keyed, streams


PARTS = 3


def as_stream(t, df, what: str, part: str = "0", parts: int = PARTS):
    """df as a stream of so many micro-batches: rows whose part (an SQL expression modulo parts) is k are batch k."""
    path = fresh_path(t.spark, what)
    for k in range(parts):
        df.where(F.expr(f"pmod({part}, {parts}) = {k}")).coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def in_parts(t, run, *sources, parts: int = PARTS):
    """run(*streams) to its end for each part of the sources (df, what, part as above), when it has been added to what the streams
    read: part k is batch k, in as many files as there are tasks to write it."""
    paths = [fresh_path(t.spark, what) for _, what, _ in sources]
    for k in range(parts):
        for (df, _, part), path in zip(sources, paths, strict=True):
            df.where(F.expr(f"pmod({part}, {parts}) = {k}")).write.mode("append").parquet(path)
        run(*[t.spark.readStream.schema(df.schema).parquet(path) for (df, _, _), path in zip(sources, paths, strict=True)]).awaitTermination()


ROUTED = "event_id % 41 <> 0 AND event_id % 53 <> 0 AND event_type <> 'view' AND user_id % 3 = 1 AND event_id % 8 <= 5"


@query(
    "messages",
    f"""SELECT event_id AS message_id, CASE WHEN event_type = 'error' THEN 'delete'
       ELSE 'upsert' END AS kind, concat('u', user_id, '/a b+c.json') AS key FROM events WHERE {ROUTED}""",
)
def str1_event_ingest(t):
    path = fresh_path(t.spark, "ingest")
    stream = streams.ingest(as_stream(t, t.messages, "messages", "message_id"), "p", "c1", "data/")
    streams.run(stream, path, streams.ingest_sink(path)).awaitTermination()
    return t.spark.read.parquet(f"{path}/changes").where("key IS NOT NULL").select("message_id", "kind", "key")


#: Messages of batch k go to the pipelines whose account is at most k modulo 3; those delivered too often go nowhere.
TO_MANY = """FROM events e JOIN targets t ON t.container = concat('c', e.user_id % 3) AND starts_with(concat('data/u', e.user_id, '/a b+c.json'), t.prefix) AND t.account % 3 <= e.event_id % 3
    WHERE e.event_type <> 'view' AND e.event_id % 41 <> 0 AND e.event_id % 43 <> 0 AND e.event_id % 53 <> 0 AND e.event_id % 8 <= 5 AND t.account % 5 <> 0"""


@query(
    "messages targets",
    f"""SELECT e.event_id AS message_id, t.pipeline_id, CASE WHEN e.event_type = 'error' THEN 'delete' ELSE 'upsert' END AS kind,
       substr(concat('data/u', e.user_id, '/a b+c.json'), length(t.prefix) + 1) AS key, e.event_id % 3 AS batch {TO_MANY}""",
)
def str1_event_routing(t):
    """A queue in three segments, read as they come, to many pipelines; the targets are other ones in each batch."""
    root, path = fresh_path(t.spark, "queue"), fresh_path(t.spark, "routed")
    queue.register(t.spark)
    exclude = F.when(F.col("account") % 5 == 0, F.array(F.lit("**/a b+*"))).otherwise(F.array().cast("array<string>"))
    targets = events.with_globs(t.targets.withColumns({"include": F.array().cast("array<string>"), "exclude": exclude})).persist()
    sink = streams.routed_sink(path, lambda batch_id: targets.where(f"account % 3 <= {batch_id}"))
    for k in range(PARTS):
        queue.append(t.messages.where(f"message_id % {PARTS} = {k}"), root, k)
        streams.run(t.spark.readStream.format(queue.NAME).load(root), path, sink).awaitTermination()
    targets.unpersist()
    return t.spark.read.parquet(f"{path}/changes").select("message_id", "pipeline_id", "kind", "key", "batch")


@query(
    "messages",
    """SELECT message_id, CASE WHEN message_id % 41 = 0 THEN 'neither JSON nor base64' WHEN message_id % 53 = 0 THEN 'event time'
                               WHEN message_id % 43 = 0 THEN 'no event type' ELSE 'delivered too often' END AS reason, message AS text
       FROM messages WHERE message_id % 41 = 0 OR message_id % 43 = 0 OR message_id % 53 = 0 OR delivery_count > 5""",
)
def str4_dead_letters(t):
    """What the ingest puts aside, over all micro-batches."""
    path = fresh_path(t.spark, "ingest")
    stream = streams.ingest(as_stream(t, t.messages, "messages", "message_id"), "p", "c1", "data/")
    streams.run(stream, path, streams.ingest_sink(path)).awaitTermination()
    return t.spark.read.parquet(f"{path}/dead").select("message_id", "reason", "text")


@query("messages", f"SELECT event_id AS message_id FROM events WHERE {ROUTED}")
def str2_at_least_once(t):
    """Every batch is delivered twice; its rows are there once."""
    path = fresh_path(t.spark, "replayed")
    sink = streams.ingest_sink(path)
    in_parts(t, lambda messages: streams.run(streams.ingest(messages, "p", "c1", "data/"), path, streams.in_turn(sink, sink)), (t.messages, "messages", "message_id"))
    return t.spark.read.parquet(f"{path}/changes").select("message_id")


@query(
    "changes",
    """SELECT DISTINCT pipeline_id, key, version, CAST(floor(epoch(event_time)) AS BIGINT) // 300 AS "window" FROM changes WHERE kind = 'upsert'""",
)
def str5_stream_dedupe(t):
    path = fresh_path(t.spark, "deduped")
    streams.run(streams.dedupe(as_stream(t, t.changes.where("kind = 'upsert'"), "changes")), path).awaitTermination()
    return t.spark.read.parquet(path).select("pipeline_id", "key", "version", "window")


#: Jobs come three times; those of the first round end before the second if their arrival is even, and none ends after it.
@query(
    "changes",
    """SELECT DISTINCT pipeline_id, key, version, 0 AS generation, CAST(floor(epoch(event_time)) AS BIGINT) // 300 AS "window", round
       FROM (SELECT *, min(arrival) OVER (PARTITION BY pipeline_id, key, version, CAST(floor(epoch(event_time)) AS BIGINT) // 300) AS first FROM changes WHERE kind = 'upsert'), (VALUES (0), (1)) r(round) WHERE round = 0 OR first % 2 = 0""",
)
def str5_jobs_until_they_end(t):
    """Open jobs block their key in the stream, ended ones do not."""
    path, more = fresh_path(t.spark, "jobs"), 1 << 40
    jobs = t.changes.where("kind = 'upsert'").select("pipeline_id", "key", "version", F.lit(0).alias("generation"), window_at("event_time", 300).alias("window"), "arrival")
    first = jobs.groupBy(*work.UNIQUE).agg(F.min("arrival").alias("arrival"))
    ended = first.select(*work.UNIQUE, (F.col("arrival") + more).alias("arrival"), F.when(F.col("arrival") % 2 == 0, "completed").otherwise("running").alias("state"))
    rounds = F.explode(F.array(F.lit(0), F.lit(2), F.lit(4))).alias("k")
    wanted = jobs.select(*work.UNIQUE, "arrival", rounds).select(*work.UNIQUE, (F.col("arrival") + F.col("k") * more).alias("arrival"))
    spread = f"floor((arrival + {more >> 1}) / {2 * more})"
    in_parts(t, lambda *both: streams.run(keyed.open_jobs(*both), path, changed_rows(path)), (wanted, "wanted", spread), (ended, "ended", "1"))
    return t.spark.read.parquet(path).select(*work.UNIQUE, F.floor(F.col("arrival") / (2 * more)).cast("int").alias("round"))


#: Thirds of the operations by arrival, the later ones later.
THIRDS = "CASE WHEN arrival < 30000 THEN 0 WHEN arrival < 90000 THEN 1 ELSE 2 END"


def changed_rows(path: str):
    """A sink for the rows that a batch has changed, under its number."""

    def each(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each


@query("ops", duck_fold(EVERY))
def str6_stateful_record(t):
    """The state store's record after three micro-batches."""
    path = fresh_path(t.spark, "states")
    in_parts(t, lambda ops: streams.run(keyed.keyed_record(ops, timers=False), path, changed_rows(path), mode="update"), (t.ops, "ops", THIRDS))
    return keyed.keyed_states(t.spark, f"{path}-checkpoint")


@query("ops", duck_fold(EVERY))
def str6_record_snapshots(t):
    """The same as tables: rows of the keys that a batch touches, and snapshots."""
    path = fresh_path(t.spark, "states")
    streams.run(as_stream(t, t.ops, "ops", THIRDS), path, streams.record_sink(path)).awaitTermination()
    return streams.states(t.spark, path)


LAPSED = f"""SELECT pipeline_id, key, status, claimed_until FROM (SELECT pipeline_id, key, CASE WHEN status = 'copying'
    AND claimed_until <= TIMESTAMP '2024-02-01' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'copying'
    AND claimed_until > TIMESTAMP '2024-02-01' THEN claimed_until END AS claimed_until FROM ({duck_fold(CLAIMS)}))"""


@query("ops", LAPSED)
def str7_lease_expiry(t):
    """Claims come in long before their leases end; then one row of another key moves the clock, and the timers of the others fire."""
    path = fresh_path(t.spark, "leases")
    claims = t.ops.where("op IN ('observe', 'claim')").withColumn("clock", F.expr("TIMESTAMP '2000-01-01 00:00:00'"))
    last = claims.limit(1).withColumns({"pipeline_id": F.lit("none"), "arrival": F.lit(1 << 60), "clock": F.expr("TIMESTAMP '2024-02-01 00:00:01'")})
    turn = "CASE WHEN arrival < 30000 THEN 0 WHEN pipeline_id <> 'none' THEN 1 ELSE 2 END"
    in_parts(t, lambda ops: streams.run(keyed.keyed_record(ops, "clock"), path, changed_rows(path), mode="update"), (claims.unionByName(last), "ops", turn))
    return keyed.keyed_states(t.spark, f"{path}-checkpoint").where("pipeline_id <> 'none'").select("pipeline_id", "key", "status", "claimed_until")


@query("ops", LAPSED)
def str7_leases_by_batch(t):
    """Claims in two micro-batches; in a third the clock has gone on, and what has lapsed is free again."""
    path = fresh_path(t.spark, "leases")
    claims = t.ops.where("op IN ('observe', 'claim')")
    last = claims.limit(1).withColumns({"pipeline_id": F.lit("none"), "arrival": F.lit(1 << 60)})
    stream = as_stream(t, claims.unionByName(last), "ops", "CASE WHEN arrival < 30000 THEN 0 WHEN pipeline_id <> 'none' THEN 1 ELSE 2 END")
    clocks = iter([F.expr("TIMESTAMP_NTZ '1970-01-01'"), now(), now()])
    streams.run(stream, path, streams.record_sink(path, lambda: next(clocks))).awaitTermination()
    return streams.states(t.spark, path).where("pipeline_id <> 'none'").select("pipeline_id", "key", "status", "claimed_until")


def reconciled(tick: int) -> str:
    seen = f"SELECT * FROM listing WHERE arrival % 3 <= {tick}"
    text = DIFF.replace("SELECT * FROM listing WHERE", f"SELECT * FROM ({seen}) WHERE")
    gone = f"SELECT d.* FROM ({text}) d WHERE action = 'delete_candidate' AND (pipeline_id, key) NOT IN (SELECT (pipeline_id, key) FROM listing)"
    live = f"SELECT pipeline_id, count(*) FILTER (known AND status <> 'deleted') AS live FROM ({text}) GROUP BY 1"
    counted = f"SELECT pipeline_id, count(*) AS gone FROM ({gone}) GROUP BY 1"
    return f"""SELECT {tick} AS batch, pipeline_id, key, 'upsert' AS kind FROM ({text}) WHERE action = 'upsert' UNION ALL SELECT {tick}, g.pipeline_id, g.key, 'delete' FROM ({gone}) g
        JOIN ({counted}) c USING (pipeline_id) JOIN ({live}) l USING (pipeline_id) WHERE NOT (c.gone > 100 AND c.gone * 4 > l.live)"""


@query("listing record", " UNION ALL ".join(map(reconciled, range(PARTS))))
def str9_periodic_reconcile(t):
    """Three ticks; the first two listings miss objects that the second look finds."""
    path = fresh_path(t.spark, "reconciled")
    ticks = as_stream(t, t.spark.range(PARTS), "ticks", "id")
    partial = lambda tick: t.listing.where(f"arrival % 3 <= {tick}")
    streams.periodic_reconcile(ticks, path, partial, lambda tick: t.record, lambda tick: t.listing, now(), trigger={"availableNow": True}, exclude=["**/tmp/**"]).awaitTermination()
    return t.spark.read.parquet(path).select("batch", "pipeline_id", "key", "kind")


def gauges(part: int) -> str:
    seen = duck_fold(EVERY).replace("FROM ops", f"FROM (SELECT * FROM ops WHERE {THIRDS} <= {part})")
    return f"SELECT {part} AS batch, p.pipeline_id, coalesce(greatest(max((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(event_time)) / 1e6) FILTER (status IN ('pending', 'copying')), 0), 0) AS oldest_pending_seconds FROM (SELECT DISTINCT pipeline_id FROM ops) p LEFT JOIN ({seen}) USING (pipeline_id) GROUP BY 2"


@query("ops", " UNION ALL ".join(map(gauges, range(PARTS))))
def str11_backlog_gauges(t):
    """From counts of what waits, which each batch's changed keys move."""
    path, out = fresh_path(t.spark, "states"), fresh_path(t.spark, "gauges")
    sink = keyed.backlog_sink(out, cut(t.ops.select("pipeline_id").distinct(), "pipelines"), now())
    in_parts(t, lambda ops: streams.run(keyed.keyed_record(ops, timers=False), path, sink, mode="update"), (t.ops, "ops", THIRDS))
    return t.spark.read.parquet(f"{out}/gauges")


@query("ops", " UNION ALL ".join(map(gauges, range(PARTS))))
def str11_gauges_of_snapshots(t):
    path, out = fresh_path(t.spark, "states"), fresh_path(t.spark, "gauges")
    names = t.ops.select("pipeline_id").distinct()
    each = streams.in_turn(streams.record_sink(path), streams.backlog_gauges(out, path, names, now()))
    streams.run(as_stream(t, t.ops, "ops", THIRDS), path, each).awaitTermination()
    return t.spark.read.parquet(out)


@query(
    "attempts",
    f"""SELECT * FROM (SELECT pipeline_id, le, count(*) FILTER (lag_seconds <= le AND lag_seconds > below) AS n FROM (SELECT * FROM attempts
       WHERE outcome = 'synced' AND lag_seconds > 0), (SELECT le, lag(le, 1, 0) OVER (ORDER BY le) AS below
       FROM (VALUES {bounds_sql(metrics.LAG_BOUNDS)}) b(le)) GROUP BY 1, 2) WHERE n > 0""",
)
def str12_lag_histogram_stream(t):
    """Update mode: a batch writes the counts that it has changed, and no other."""
    path = fresh_path(t.spark, "histogram")
    streams.run(streams.lag_histogram(as_stream(t, t.attempts, "attempts", "event_id")), path, streams.lag_counts_sink(path), mode="update").awaitTermination()
    return streams.lag_counts(t.spark, path)


RETRIED = """SELECT key, outcome, CASE WHEN outcome IN ('missing', 'size_mismatch') THEN CAST(regexp_extract(key, '([0-9]+)', 1) AS BIGINT) END AS n"""


@query(
    "manifest destination",
    f"""SELECT key, CASE WHEN n % 40 = 0 OR n % 60 = 0 THEN 'ok' ELSE outcome END AS outcome, CASE WHEN n IS NULL THEN 1 WHEN n % 40 = 0 THEN 2 ELSE 3 END AS looks,
       CASE WHEN n IS NULL THEN 0 WHEN n % 40 = 0 THEN 1 ELSE 3 END AS batch FROM ({RETRIED} FROM ({VERIFIED}))""",
)
def str14_retry_until_deadline(t):
    """Looks at 0 s, 60 s and 240 s (that at 120 s comes before the entries are due), with arrivals before the second and the third."""
    path = fresh_path(t.spark, "retried")
    m = cut(last(t).select("key", "size", "sha256", "written_at"), "entries", compression="zstd")
    number = F.regexp_extract("key", "([0-9]+)", 1).cast("bigint")
    there = cut(t.destination.select("key", "size", "sha256", "mod_time"), "there", compression="zstd")  # each made once, not by every look

    def destination(tick):
        arrived = (number % 40 == 0) & F.lit(tick >= 1) | (number % 60 == 0) & F.lit(tick >= 2)
        late = m.where(arrived).select("key", "size", "sha256", F.col("written_at").alias("mod_time"))
        return there.join(late, "key", "left_anti").unionByName(late)

    at = lambda seconds: F.expr(f"TIMESTAMP_NTZ '2024-02-01' + INTERVAL '{seconds}' SECOND")
    ticks = as_stream(t, t.spark.range(4), "ticks", "id", 4)
    streams.retry_until(ticks, path, m, destination, lambda k: at([0, 60, 120, 240][k]), at(200), lambda looks: F.lit(60.0) * F.pow(F.lit(2.0), looks - 1)).awaitTermination()
    return t.spark.read.parquet(f"{path}/settled").select("key", "outcome", "looks", "batch")


@query(
    "accounts",
    """SELECT o_orderkey AS arrival, CASE WHEN a.account IS NULL OR a.account % 6 = 0 THEN NULL ELSE CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN account % 5 <> 0 THEN 1 END
              WHEN 1 THEN CASE WHEN account % 5 = 0 THEN 2 ELSE CASE WHEN account % 7 = 0 THEN 1 ELSE 2 END END ELSE 3 END END AS revision
       FROM orders LEFT JOIN accounts a ON a.account = o_custkey""",
)
def str13_spec_hot_reload(t):
    """Changes in three micro-batches; some specs are bad in the first, others in the second, none in the third."""
    path = fresh_path(t.spark, "reloaded")
    good = '{"source":{"s3":{"bucket":"a","region":"r"}},"destination":{"s3":{"bucket":"b","region":"r"}},"part_size":"64MiB"}'

    def read(batch):
        spoiled = F.expr(f"{batch} = 0 AND account % 5 = 0 OR {batch} = 1 AND account % 7 = 0 AND account % 5 <> 0")
        spec = F.when(spoiled, good.replace("64MiB", "1MiB")).otherwise(good)
        return t.accounts.select(F.concat(F.lit("p-"), F.col("account").cast("string")).alias("name"), F.lit(batch + 1).alias("revision"),
            (F.col("account") % 6 != 0).alias("enabled"), spec.alias("spec"))

    changes = t.orders.select(F.concat(F.lit("p-"), F.col("o_custkey").cast("string")).alias("pipeline_id"), F.col("o_orderkey").alias("arrival"))
    streams.run(as_stream(t, changes, "changes", "arrival"), path, streams.with_current_specs(path, read)).awaitTermination()
    return t.spark.read.parquet(f"{path}/changes").select("arrival", "revision")
