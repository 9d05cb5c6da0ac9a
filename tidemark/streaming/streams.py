"""The same rules over streams: ingest, dedupe, keyed record state, gauges and reloads.

Sinks are idempotent by batch id, so that a batch run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import window_at
from tidemark.operators import events, metrics, record, reconcile, specs, status, verify
from tidemark.sources import sinks


def run(stream: DataFrame, path: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Start a stream into Parquet below path, or into each(batch, batch_id); its checkpoint lies beside the data."""
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(**(trigger or {"availableNow": True}))
    return out.foreachBatch(each).start() if each else out.format("parquet").option("path", path).start()


def ingest(messages: DataFrame, pipeline: str, container: str, prefix: str, include=(), exclude=()) -> DataFrame:
    """Raw messages, batch or stream, to changes and dead rows of one pipeline."""
    return events.map_events(events.parse_messages(messages), pipeline, container, prefix, include, exclude)


CHANGED = ["pipeline_id", "kind", "key", "version", "sequencer", "event_time", "message_id"]


def ingest_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch's changes and dead letters under its number: a batch that is run again replaces itself.

    A message that is bad in part, or was delivered too often, is one dead letter with the first reason found in it; of
    a message that was delivered too often no change goes on.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        spent = F.col("delivery_count") > sinks.MAX_DELIVERIES
        sinks.write_changes(batch.where((F.col("disposition") == "ok") & ~spent).select(*CHANGED), f"{path}/changes", batch_id)
        bad = batch.where(spent | (F.col("malformed") != ""))
        reason = F.min_by("malformed", F.struct(F.col("malformed") == "", F.coalesce("nth", F.lit(0))))
        messages = bad.groupBy("message_id").agg(F.max("delivery_count").alias("delivery_count"), F.first("message").alias("message"), reason.alias("malformed"))
        sinks.dead_letters(messages).write.mode("overwrite").parquet(f"{path}/dead/batch={batch_id}")
        batch.unpersist()

    return each


def routed_sink(path: str, targets: Callable[[int], DataFrame], whole_message: bool = True) -> Callable[[DataFrame, int], None]:
    """Each batch of messages as changes of every pipeline that wants them, and dead letters, under its number.

    targets(batch_id) are read anew for each batch: pipeline_id, container, prefix and, from with_globs, include and exclude.
    A message with a bad event is a dead letter as a whole, or loses that event only; one that was delivered too often is
    always a dead letter, and no change comes of it.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        relevant = F.col("event_type").isin(events.CREATED, events.DELETED)
        unusable = F.when(relevant & ~F.col("has_data"), "no data").when(relevant & events.blob_from_url("url").isNull(), "url").otherwise("")
        parsed = events.parse_messages(batch).withColumn("malformed", F.when(F.col("malformed") == "", unusable).otherwise(F.col("malformed"))).persist()
        spent = F.col("delivery_count") > sinks.MAX_DELIVERIES
        good = events.apply_policy(parsed, whole_message).where(F.col("keep") & ~spent).drop("keep")
        sinks.write_changes(events.change_columns(events.route(good, targets(batch_id))).select(*CHANGED), f"{path}/changes", batch_id)
        dead = parsed.where(spent | (F.col("malformed") != "")) if whole_message else parsed.where(spent | F.col("nth").isNull() | (F.col("malformed") != ""))
        reason = F.min_by("malformed", F.struct(F.col("malformed") == "", F.coalesce("nth", F.lit(0))))
        letters = dead.groupBy("message_id").agg(F.max("delivery_count").alias("delivery_count"), F.first("message").alias("message"), reason.alias("malformed"))
        sinks.dead_letters(letters).write.mode("overwrite").parquet(f"{path}/dead/batch={batch_id}")
        parsed.unpersist()

    return each


def dedupe(changes: DataFrame, late: str = "10 minutes", seconds: int = 300) -> DataFrame:
    """One change per pipeline, key, version and window of its time, while the watermark keeps it in mind."""
    return changes.withColumn("window", window_at("event_time", seconds)).withColumn("__t",
        F.col("event_time").cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark(["pipeline_id", "key", "version", "window"]).drop("__t")


#: Batches after which the states of all keys are written as one snapshot.
COMPACT = 16
KEYS = ["pipeline_id", "key"]


def states(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """The record after batch last of record_sink(path), or after all there are: a snapshot and the batches since."""
    if last is None:
        last = spark.read.parquet(f"{path}/states").agg(F.max("batch")).first()[0]
    base = last // COMPACT * COMPACT
    schema = ", ".join(["pipeline_id string", "key string", *[f"{n} {t}" for n, (t, _) in record.FIELDS.items()]])
    rows = spark.read.schema(f"{schema}, batch int").parquet(f"{path}/states").where(F.col("batch").between(base, last))
    if base:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{path}/snapshots/before-{base}").withColumn("batch", F.lit(-1)))
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*record.FIELDS), "batch").alias("r")).select(*KEYS, "r.*")


def record_sink(path: str, clock: Callable[[], Column] | None = None) -> Callable[[DataFrame, int], None]:
    """Folds each batch of operations, in order of arrival, into the record as the batches before have left it.

    A batch writes the rows of the keys that it touches under its number, so that one that is run again replaces
    itself; every COMPACT batches a snapshot of all keys spares readers the older ones. With a clock a key whose lease
    has lapsed goes back to pending in the next batch, and another may claim it there.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, None
        batch = batch.persist()
        if batch_id:
            before = states(spark, path, batch_id - 1)
            if batch_id % COMPACT == 0:
                before.write.mode("overwrite").parquet(f"{path}/snapshots/before-{batch_id}")
                before = spark.read.schema(before.schema).parquet(f"{path}/snapshots/before-{batch_id}")
            if clock:
                freed = record.free_lapsed(before, clock())
                before = before.join(freed.select(*KEYS), KEYS, "left_anti").withColumn("freed", F.lit(False)).unionByName(freed.withColumn("freed", F.lit(True)))
        touched = batch.select(*KEYS).distinct()
        new = record.fold(batch, before.join(touched, KEYS, "left_semi") if batch_id else None)
        if batch_id and clock:
            new = new.unionByName(before.where("freed").drop("freed").join(touched, KEYS, "left_anti"))
        new.write.mode("overwrite").parquet(f"{path}/states/batch={batch_id}")
        batch.unpersist()

    return each


def in_turn(*steps: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    def each(batch: DataFrame, batch_id: int) -> None:
        for step in steps:
            step(batch, batch_id)

    return each


def with_hooks(each: Callable[[DataFrame, int], None], started: Callable[[int], None] = lambda n: None,
    finished: Callable[[int, dict], None] = lambda n, seen: None, **figures: Column) -> Callable[[DataFrame, int], None]:
    """each with callbacks on the driver: started(batch_id), and finished(batch_id, figures) with aggregates of the batch's rows.

    The figures are taken while the rows pass by, so they cost no reading of their own; figures that take a row more
    than once because each reads the batch more than once are those of the first reading.
    """

    def hooked(batch: DataFrame, batch_id: int) -> None:
        started(batch_id)
        seen = Observation(f"batch-{batch_id}")
        each(batch.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in figures.items()]), batch_id)
        finished(batch_id, seen.get)

    return hooked


def periodic_reconcile(
    ticks: DataFrame,
    path: str,
    listing: Callable[[int], DataFrame],
    records: Callable[[int], DataFrame],
    recheck: Callable[[int], DataFrame],
    now: Column,
    trigger: dict | None = None,
    **filters,
) -> StreamingQuery:
    """The batch diff at every tick, the first at once, each side read anew as a function of the tick's number.

    What seems to be gone is looked for again (recheck) before the guards count it and before it is deleted. ticks is any
    stream; once_every() makes one.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        diffed = reconcile.diff(listing(batch_id), records(batch_id), now, **filters).persist()
        gone = reconcile.confirm(diffed.where("action = 'delete_candidate'"), recheck(batch_id)).persist()
        deletes = reconcile.allowed_deletes(gone, reconcile.empty_source_guard(diffed), reconcile.mass_delete_guard(gone, diffed))
        changes = diffed.where("action = 'upsert'").select("pipeline_id", "key", F.lit("upsert").alias("kind")).unionByName(deletes.select("pipeline_id", "key", F.lit("delete").alias("kind")))
        sinks.write_changes(changes, path, batch_id)
        gone.unpersist()
        diffed.unpersist()

    return run(ticks, path, each, trigger=trigger or {"processingTime": "15 minutes"})


def once_every(spark: SparkSession) -> DataFrame:
    """A row per micro-batch, for streams that only need a trigger."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()


def backlog_gauges(path: str, states_path: str, pipelines: DataFrame, now: Column) -> Callable[[DataFrame, int], None]:
    """After each batch the oldest waiting change of each pipeline over the record of all keys, in the batch or not."""

    def each(batch: DataFrame, batch_id: int) -> None:
        status.oldest_pending(states(batch.sparkSession, states_path, batch_id), pipelines, now).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each


def lag_histogram(attempts: DataFrame, bounds=metrics.LAG_BOUNDS) -> DataFrame:
    """Counts per bucket, not cumulated, of a stream of finished copies; cumulate with lag_buckets on read."""
    le = F.lit(float("inf"))
    for b in reversed(bounds):
        le = F.when(F.col("lag_seconds") <= b, F.lit(float(b))).otherwise(le)
    return attempts.where("outcome = 'synced' AND lag_seconds > 0").groupBy("pipeline_id", le.alias("le")).agg(F.count("*").alias("n"))


def retry_until(
    ticks: DataFrame,
    path: str,
    manifest: DataFrame,
    destination: Callable[[int], DataFrame],
    clock: Callable[[int], Column],
    deadline: Column,
    backoff: Callable[[Column], Column],
    trigger: dict | None = None,
) -> StreamingQuery:
    """Verify a manifest tick by tick until its entries are settled: path/settled has each with its outcome, looks and batch.

    An entry that is missing or of the wrong size is looked at again after backoff(looks) seconds, at the next tick from
    then on, until it is settled or a look fails at or after the deadline. What is pending lies under path/pending by batch
    and shrinks; a tick reads the last of these and looks only for the entries that are due.
    """
    columns = ["key", "size", "sha256", "written_at"]

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, time = batch.sparkSession, clock(batch_id)
        if batch_id:
            pending = spark.read.schema(pending_schema).parquet(f"{path}/pending/batch={batch_id - 1}")
        else:
            pending = manifest.select(*columns, F.lit(0).alias("looks"), time.alias("next_look"))
        due = pending.where(F.col("next_look") <= time).withColumn("looks", F.col("looks") + 1).persist()
        seen = verify.verify(due.select(*columns), destination(batch_id)).select("key", "outcome")
        looked = due.join(seen, "key").persist()
        again = F.col("outcome").isin("missing", "size_mismatch") & (time < deadline)
        looked.where(~again).select("key", "outcome", "looks").write.mode("overwrite").parquet(f"{path}/settled/batch={batch_id}")
        waiting = looked.where(again).withColumn("next_look", time + F.make_interval(secs=backoff(F.col("looks")))).select(*pending.columns)
        pending.where(F.col("next_look") > time).unionByName(waiting).write.mode("overwrite").parquet(f"{path}/pending/batch={batch_id}")
        looked.unpersist()
        due.unpersist()

    pending_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in manifest.select(*columns).schema) + ", looks int, next_look timestamp_ntz"
    return run(ticks, path, each, trigger=trigger)


def lag_counts_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for lag_histogram in update mode: each batch's changed counts under its number."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each


def lag_counts(spark: SparkSession, path: str) -> DataFrame:
    """The histogram as the last batches have left it: the newest count of each pipeline and bucket."""
    return spark.read.parquet(path).groupBy("pipeline_id", "le").agg(F.max_by("n", "batch").alias("n"))


def with_current_specs(path: str, read_specs: Callable[[int], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Each batch of changes with the revision of its pipeline's spec in force, specs being read anew for every batch.

    A spec with problems leaves the revision in force that was before it. Changes of pipelines without a spec in force, or
    with a disabled one, are held: revision is null. In force after batch n is what lies under path/specs/batch=n.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, target = batch.sparkSession, f"{path}/specs/batch={batch_id}"
        wanted = read_specs(batch_id)
        bad = specs.validate(wanted).where(F.size("problems") > 0).select("name")
        good = wanted.join(bad, "name", "left_anti").select("name", "revision", "enabled")
        if batch_id:
            before = spark.read.parquet(f"{path}/specs/batch={batch_id - 1}")
            good = good.unionByName(before.join(bad, "name", "left_semi"))
        good.write.mode("overwrite").parquet(target)
        inforce = spark.read.schema(good.schema).parquet(target).where("enabled").select(F.col("name").alias("pipeline_id"), "revision")
        batch.drop("revision").join(inforce, "pipeline_id", "left").write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")

    return each
