"""The record as a stream's keyed state: rows of keys in Spark's state store, and timers for their leases.

A state holds the keys of a bucket, as every state that is read or written costs some calls between Python and the JVM, which
outweigh a row's work by far. A batch reads and writes the buckets of its keys; with more buckets that is less of the record,
with fewer it is fewer calls. A lease that nobody renews lapses by its bucket's timer, without another operation of its key.
The rules are those of record.step, compiled for plain values.
"""

from __future__ import annotations

import datetime
import pickle
from collections.abc import Callable, Iterator
from functools import cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import compiled
from tidemark.functions.plain import PLAIN
from tidemark.operators import record, work

KEYS = ["pipeline_id", "key"]
STATE = ", ".join(f"{n} {t}" for n, (t, _) in record.FIELDS.items())
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime.datetime(1970, 1, 1)
MICRO = datetime.timedelta(microseconds=1)
#: Fields that are times: microseconds since EPOCH in states and where rules run.
TIMES = [n for n, (t, _) in record.FIELDS.items() if t == "timestamp_ntz"]
STORED = ", ".join(f"{n} array<{'bigint' if n in TIMES else t}>" for n, t in [*((n, "string") for n in KEYS), *((n, t) for n, (t, _) in record.FIELDS.items())])
AT = {n: list(record.FIELDS).index(n) for n in ("claimed_until", "status", "event_time", *TIMES)}
COUNTED = {"TIMESTAMP_NTZ '0001-01-01 00:00:00'": (datetime.datetime.min - EPOCH) // MICRO, "INTERVAL '2' MINUTE": datetime.timedelta(minutes=2) // MICRO}
CHANGED = Row(*KEYS, *record.FIELDS, "was_status", "was_event_time")
ARRIVAL, OP = itemgetter(len(KEYS) + record.OPS.index("arrival")), record.OPS.index("op")
OPERATIONS = "observe claim extend set_upload complete fail delete".split()
#: Buckets of keys, and rows that a task packs at once.
BUCKETS, CHUNK = 1024, 100_000


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int").alias("bucket")


def micros(name: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01'"), F.col(name).cast("timestamp_ntz")).alias(name)


def time(number: int | None) -> datetime.datetime | None:
    return None if number is None else EPOCH + number * MICRO


def packed(rows: DataFrame, names: list[str], buckets: int, clock: str | None = None) -> DataFrame:
    """A stream's rows as few: bucket, packed (the values of names of a bucket's rows, as far as they lie in one chunk) and the latest clock.

    What a row of a keyed stream costs in Python is mostly that its cells are made one by one; here they are made by column.
    """

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("bucket")
        of = table["bucket"].to_pylist()
        values = list(zip(*[table[n].to_pylist() for n in names], strict=True))
        starts = [k for k in range(len(of)) if not k or of[k] != of[k - 1]]
        ends = [*starts[1:], len(of)]
        out = [pa.array([of[k] for k in starts], pa.int32()), pa.array([pickle.dumps(values[a:b], 5) for a, b in zip(starts, ends, strict=True)], pa.binary())]
        if clock:
            times = table[clock].to_pylist()
            latest = [max((x for x in times[a:b] if x is not None), default=None) for a, b in zip(starts, ends, strict=True)]
            out.append(pa.array(latest, table[clock].type))
        return pa.RecordBatch.from_arrays(out, ["bucket", "packed", *([clock] if clock else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield pack(held)
                held = []
        if any(b.num_rows for b in held):
            yield pack(held)

    chosen = rows.select(bucket(buckets), *names, *([clock] if clock else []))
    kind = f", {clock} {chosen.schema[clock].dataType.simpleString()}" if clock else ""
    return chosen.repartition("bucket").mapInArrow(run, f"bucket int, packed binary{kind}")


def unpacked(rows: Iterator[Row], order: Callable) -> list[tuple]:
    return sorted((x for row in rows for x in pickle.loads(row["packed"])), key=order)  # noqa: S301  as packed above


def columns(rows) -> tuple[list, ...]:
    return tuple(map(list, zip(*rows, strict=True)))


@cache
def steps() -> tuple[tuple, dict[str, Callable[[tuple, tuple], tuple]]]:
    """A new row, and record.step for each operation; others change nothing."""
    new = tuple(record.new_row(PLAIN).v.values())
    return new, {op: compiled.function(record.step, list(record.FIELDS), record.OPS, {"op": op}, COUNTED) for op in OPERATIONS}


def milliseconds(number: int) -> int:
    return -(-number // 1000)  # rounded up: a timer never fires before its lease has ended


class KeyedRecord(StatefulProcessor):
    """Folds the operations of a bucket's keys into their records, in order of arrival within a batch."""

    def __init__(self, timers: str) -> None:
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("record", STORED)
        self.new, self.steps = steps()

    def known(self) -> dict[tuple, tuple]:
        """The bucket's records by key, as tuples of fields."""
        state = self.state.get()
        return {} if state is None else {row[: len(KEYS)]: row[len(KEYS) :] for row in zip(*state, strict=True)}

    def keep(self, held: dict[tuple, tuple], before: dict[tuple, tuple | None]) -> Iterator[Row]:
        """held as the bucket's state, if a record of before, what the touched keys had, has changed."""
        changed = [(key, held[key], old) for key, old in before.items() if held[key] != old]
        if not changed:
            return
        self.state.update(columns((*key, *r) for key, r in held.items()))
        if self.timers:
            leases = [r[AT["claimed_until"]] for r in held.values() if r[AT["claimed_until"]] is not None]
            if leases:
                self.handle.registerTimer(milliseconds(min(leases)))
        for key, r, old in changed:
            state = list(r)
            for n in TIMES:
                state[AT[n]] = time(r[AT[n]])
            yield CHANGED(*key, *state, *((old[AT["status"]], time(old[AT["event_time"]])) if old else (None, None)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, before = self.known(), {}
        for x in unpacked(rows, ARRIVAL):
            name, o = x[: len(KEYS)], x[len(KEYS) :]
            r = held.get(name)
            if name not in before:
                before[name] = r
            step = self.steps.get(o[OP])
            held[name] = step(r or self.new, o) if step else r or self.new
        yield from self.keep(held, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Frees the bucket's keys whose leases have ended by now; the next one to end has the next timer."""
        held = self.known()
        clocks = (timerValues.getCurrentWatermarkInMs(), timerValues.getCurrentProcessingTimeInMs())
        now = max(expiredTimerInfo.getExpiryTimeInMs(), *(t for t in clocks[: 1 if self.timers == "EventTime" else 2] if t is not None))
        before = {k: r for k, r in held.items() if r[AT["claimed_until"]] is not None and milliseconds(r[AT["claimed_until"]]) <= now}
        for k, r in before.items():
            held[k] = tuple((dict(zip(record.FIELDS, r, strict=True)) | record.FREED).values())
        yield from self.keep(held, before)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        names = [*KEYS, *record.FIELDS]
        held = {row[: len(KEYS)]: row[len(KEYS) :] for row in (tuple(r[n] for n in names) for r in initialState["rows"])}
        for _ in self.keep(held, dict.fromkeys(held)):
            pass

    def close(self) -> None:
        pass


def keyed_record(ops: DataFrame, clock: str | None = None, timers: bool = True, initial: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A stream of operations to a stream of the records that they, or the end of a lease, have changed (update mode), each with
    the status and event time that it had before, null for a new one.

    A lease ends by the machine's clock, or by the column clock, which must be the time at which operations come in and so
    never fall behind; without timers it is only seen by the next operation. initial is a record to begin with. A stream
    that goes on from a checkpoint must have the buckets that it began with.
    """
    ops.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ops.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    ops = packed(ops.withColumns({n: micros(n) for n in ("mtime", "event_time", "at")}), [*KEYS, *record.OPS], buckets, clock if timers else None)
    if clock and timers:
        ops = ops.withWatermark(clock, "1 second")
    mode = "None" if not timers else "EventTime" if clock else "ProcessingTime"
    start = None
    if initial is not None:
        rows = F.struct(*KEYS, *[micros(n) if n in TIMES else F.col(n) for n in record.FIELDS])
        start = initial.groupBy(bucket(buckets)).agg(F.collect_list(rows).alias("rows")).groupBy("bucket")
    kinds = f"pipeline_id string, key string, {STATE}, was_status string, was_event_time timestamp_ntz"
    return ops.groupBy("bucket").transformWithState(KeyedRecord(mode if timers else ""), kinds, "Update", mode, initialState=start)


def keyed_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The record of all keys as the last committed batch has left it, from the state store below a stream's checkpoint."""
    names = [*KEYS, *record.FIELDS]
    stored = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "record").load()
    rows = stored.select(F.inline(F.arrays_zip(*[F.col("value")[n].alias(n) for n in names])))
    return rows.select(*[F.expr(f"timestampadd(MICROSECOND, {n}, TIMESTAMP_NTZ '1970-01-01')").alias(n) if n in TIMES else F.col(n) for n in names])


def backlog_sink(path: str, pipelines: DataFrame, now: Column) -> Callable[[DataFrame, int], None]:
    """After each batch of keyed_record's rows the oldest waiting change of each pipeline: path/gauges, by batch.

    What waits is kept as counts by pipeline and event time (path/waiting), to which a batch adds what it has changed; the
    work follows the batch and the backlog, not the record.
    """
    schema = "pipeline_id string, event_time timestamp_ntz, n bigint"

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, waits = batch.sparkSession, lambda status: F.col(status).isin("pending", "copying")
        moves = F.array(*[F.struct(F.when(waits(s), F.col(t)).alias("event_time"), F.lit(n).cast("bigint").alias("n")) for s, t, n in (("status", "event_time", 1), ("was_status", "was_event_time", -1))])
        counts = batch.select("pipeline_id", F.inline(moves)).where("event_time IS NOT NULL")  # the batch is read once: reading it makes it
        if batch_id:
            counts = counts.unionByName(spark.read.schema(schema).parquet(f"{path}/waiting/batch={batch_id - 1}"))
        counts.groupBy("pipeline_id", "event_time").agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{path}/waiting/batch={batch_id}")
        waiting = spark.read.schema(schema).parquet(f"{path}/waiting/batch={batch_id}")
        oldest = waiting.groupBy("pipeline_id").agg(F.min("event_time").alias("oldest"))
        seconds = F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("oldest").cast("timestamp"))) / 1e6, F.lit(0.0))
        gauges = pipelines.join(oldest, "pipeline_id", "left").select("pipeline_id", F.coalesce(seconds, F.lit(0.0)).alias("oldest_pending_seconds"))
        gauges.write.mode("overwrite").parquet(f"{path}/gauges/batch={batch_id}")

    return each


class OpenJobs(StatefulProcessor):
    """Lets a job through unless one of its unique key is open. A key is open until its job has ended, and only while it is
    open does the state hold it: with the other open ones of its bucket, as columns."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "pipeline_id array<string>, key array<string>, version array<string>, generation array<int>, window array<bigint>, since array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.open.get()
        before = {} if state is None else {job[:-1]: job[-1] for job in zip(*state, strict=True)}
        still = dict(before)
        for x in unpacked(rows, itemgetter(len(work.UNIQUE))):
            job, (arrival, state) = x[: len(work.UNIQUE)], x[len(work.UNIQUE) :]
            if state is None:
                if job not in still:
                    still[job] = arrival
                    yield STARTED(*job, arrival)
            elif state in work.OPEN_STATES:
                still[job] = arrival
            else:
                still.pop(job, None)
        if still and still != before:
            self.open.update(columns((*job, since) for job, since in still.items()))
        elif before and not still:
            self.open.clear()

    def close(self) -> None:
        pass


STARTED = Row(*work.UNIQUE, "arrival")


def open_jobs(wanted: DataFrame, states: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Streams of wanted jobs (work's unique columns, arrival) and of job states (the same, state) to the jobs to be started.

    As work.dedupe has it: a job of an available, scheduled, retryable or running one's unique key is dropped, and once that one has
    ended the next is let through. arrival orders both streams; rows are taken in this order within a batch. Objects are
    held in so many buckets.
    """
    wanted.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = [*work.UNIQUE, "arrival"]
    both = wanted.select(*names, F.lit(None).cast("string").alias("state")).unionByName(states.select(*names, "state"))
    kinds = ", ".join(f"{n} {both.schema[n].dataType.simpleString()}" for n in names)
    return packed(both, [*names, "state"], buckets).groupBy("bucket").transformWithState(OpenJobs(), kinds, "Append", "None")
