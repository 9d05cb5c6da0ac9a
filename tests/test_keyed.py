"""The record in the state store: the same as the batch fold however operations are split, leases that lapse by time, restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from test_rules import ops_frame, random_ops, states
from tidemark.functions import compiled
from tidemark.functions.plain import PLAIN, Plain
from tidemark.operators import record
from tidemark.plans import stream_queries
from tidemark.plans.fixtures import Inputs
from tidemark.streaming import keyed, streams


def clocked(like):
    return StructType([*like.schema.fields, StructField("clock", TimestampType())])


def write(df, folder, number):
    df.coalesce(1).write.mode("append").parquet(str(folder / f"part={number:03}"))


def stream(spark, folder, like, clock=None):
    schema = clocked(like) if clock else like.schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "part=*"))


def sink(batch, batch_id):
    batch.write.format("noop").mode("overwrite").save()


def test_plain_values_follow_the_columns(spark):
    rows = random_ops(3, 400)
    df = ops_frame(spark, rows)
    ops = sorted((r.asDict() for r in df.collect()), key=lambda o: o["arrival"])
    held = {}
    for o in ops:
        k = o["pipeline_id"], o["key"]
        held[k] = record.step(held.get(k, record.new_row(PLAIN)), Plain(o), PLAIN)
    assert sorted((*k, *r.v.values()) for k, r in held.items()) == sorted(map(tuple, record.fold(df).select("pipeline_id", "key", *record.FIELDS).collect()))


def test_compiled_rules_follow_the_columns(spark):
    """The same with the rule as Python functions, one for each operation, with times as they are or as numbers."""
    df = ops_frame(spark, random_ops(4, 400))
    step_of = {op: compiled.function(record.step, list(record.FIELDS), record.OPS, {"op": op}, {}) for op in (*keyed.OPERATIONS, "none")}
    held = {}
    for o in sorted(df.collect(), key=lambda o: o["arrival"]):
        k = o["pipeline_id"], o["key"]
        held[k] = step_of[o["op"]](held.get(k, tuple(record.new_row(PLAIN).v.values())), tuple(o[n] for n in record.OPS))
    assert sorted((*k, *r) for k, r in held.items()) == sorted(map(tuple, record.fold(df).select("pipeline_id", "key", *record.FIELDS).collect()))


def test_keys_share_states_and_rows_reach_them_packed(spark, tmp_path):
    """Keys over few buckets, in chunks of few rows: as many states as buckets, and the record of the fold."""
    rows = random_ops(8, 300)
    like = ops_frame(spark, rows)
    write(like, tmp_path / "ops", 0)
    out = str(tmp_path / "out")
    streams.run(keyed.keyed_record(stream(spark, tmp_path / "ops", like), timers=False, buckets=2), out, sink, mode="update").awaitTermination()
    assert states(keyed.keyed_states(spark, f"{out}-checkpoint")) == states(record.fold(like))
    held = spark.read.format("statestore").option("path", f"{out}-checkpoint").option("stateVarName", "record").load()
    assert held.count() <= 2 < keyed.keyed_states(spark, f"{out}-checkpoint").count()


def test_backlog_reads_a_batch_once(spark, tmp_path):
    """Reading a batch twice would fold it twice."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kinds = "pipeline_id string, status string, event_time timestamp_ntz, was_status string, was_event_time timestamp_ntz"
    at = datetime.datetime(2024, 1, 1)
    batch = spark.createDataFrame([("p", "pending", at, None, None), ("p", "synced", at, "copying", at), ("q", "copying", at, None, None)], kinds).mapInArrow(count, kinds)
    pipelines = spark.createDataFrame([("p",), ("q",)], "pipeline_id string")
    keyed.backlog_sink(str(tmp_path), pipelines, F.expr("TIMESTAMP_NTZ '2024-01-01 00:01:00'"))(batch, 0)
    assert seen.value == 3
    assert sorted((r[0], r[1]) for r in spark.read.parquet(f"{tmp_path}/gauges/batch=0").collect()) == [("p", 0.0), ("q", 60.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_state_store_equals_fold(spark, tmp_path, seed):
    """Batches of random sizes, with a restart from the checkpoint between them."""
    rng, rows = random.Random(seed), random_ops(seed, 160)
    cuts = sorted(rng.sample(range(1, len(rows)), 4))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    like, out = ops_frame(spark, rows[:1]), str(tmp_path / "out")
    for k, part in enumerate(parts):
        write(ops_frame(spark, part), tmp_path / "ops", k)
        if k in (1, 4):
            streams.run(keyed.keyed_record(stream(spark, tmp_path / "ops", like), timers=False), out, sink, mode="update").awaitTermination()
            assert states(keyed.keyed_states(spark, f"{out}-checkpoint")) == states(record.fold(ops_frame(spark, rows[: [*cuts, len(rows)][k]])))


def test_lease_lapses_without_an_operation_of_its_key(spark, tmp_path):
    """Two keys are claimed; the clock of a third one's operations frees them, the renewed one later; then another takes over."""
    day = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    like = ops_frame(spark, random_ops(1, 1))

    def op(key, arrival, what, minute, clock):
        return ("p", key, arrival, what, "v", 1, day(0), "", day(0), day(minute), True, "d", day(clock))

    def send(number, *ops):
        write(spark.createDataFrame(ops, clocked(like)), tmp_path / "ops", number)
        streams.run(keyed.keyed_record(stream(spark, tmp_path / "ops", like, "clock"), "clock"), out, sink, mode="update").awaitTermination()
        return {r["key"]: (r["status"], r["attempts"]) for r in keyed.keyed_states(spark, f"{out}-checkpoint").collect()}

    out = str(tmp_path / "out")
    like = like.select("pipeline_id", "key", *record.OPS)
    assert send(0, op("a", 1, "claim", 0, 0), op("b", 2, "claim", 0, 0), op("b", 3, "extend", 1, 0)) == {"a": ("copying", 1), "b": ("copying", 1)}
    assert send(1, op("c", 4, "observe", 0, 2.5)) == {"a": ("pending", 1), "b": ("copying", 1), "c": ("pending", 0)}
    assert send(2, op("a", 5, "claim", 2.6, 2.6), op("b", 6, "claim", 2.6, 2.6)) == {"a": ("copying", 2), "b": ("copying", 1), "c": ("pending", 0)}
    assert send(3, op("c", 7, "observe", 0, 3.5)) == {"a": ("copying", 2), "b": ("pending", 1), "c": ("pending", 0)}
    assert send(4, op("c", 8, "observe", 0, 60)) == {"a": ("pending", 2), "b": ("pending", 1), "c": ("pending", 0)}


def test_state_begins_with_a_record(spark, tmp_path):
    rows = random_ops(5, 90)
    before = record.fold(ops_frame(spark, rows[:60]))
    write(ops_frame(spark, rows[60:]), tmp_path / "ops", 0)
    out = str(tmp_path / "out")
    ops = stream(spark, tmp_path / "ops", ops_frame(spark, rows[:1]))
    streams.run(keyed.keyed_record(ops, timers=False, initial=before), out, sink, mode="update").awaitTermination()
    assert states(keyed.keyed_states(spark, f"{out}-checkpoint")) == states(record.fold(ops_frame(spark, rows)))


def test_looks_do_not_make_their_inputs_again(spark, sf, monkeypatch):
    """The retries of a manifest get its last writes and the destination as they lie written, not as sorts of all writes."""
    given = {}

    def caught(ticks, path, manifest, destination, *rest):
        given.update(manifest=manifest, destination=destination(1))
        raise StopIteration

    monkeypatch.setattr(streams, "retry_until", caught)
    with pytest.raises(StopIteration):
        stream_queries.str14_retry_until_deadline(Inputs(spark, sf))
    assert [f for df in given.values() for f in df.inputFiles() if "lineitem" in f] == []


def test_open_jobs_block_until_they_end(spark, tmp_path):
    """Against a plain loop: jobs and job states in random order, over several batches and restarts."""
    rng, kinds = random.Random(11), "pipeline_id string, key string, version string, generation int, window bigint, arrival bigint"
    events = [("p", f"k{rng.randrange(3)}", "v", rng.randrange(2), 0, n, rng.choice([None, None, "running", "available", "completed", "discarded"])) for n in range(150)]
    want, still_open = [], set()
    for *key, arrival, state in events:
        if state is None and tuple(key) not in still_open:
            want.append(arrival)
            still_open.add(tuple(key))
        elif state is not None:
            (still_open.discard if state in ("completed", "discarded") else still_open.add)(tuple(key))
    out = str(tmp_path / "out")
    for k, part in enumerate((events[:40], events[40:41], events[41:])):
        for what, schema, rows in (("wanted", kinds, [e[:6] for e in part if e[6] is None]), ("states", f"{kinds}, state string", [e for e in part if e[6] is not None])):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / what / f"part={k}"))
        streams_of = [spark.readStream.schema(s).parquet(str(tmp_path / w / "part=*")) for w, s in (("wanted", kinds), ("states", f"{kinds}, state string"))]
        streams.run(keyed.open_jobs(*streams_of), out).awaitTermination()
    assert sorted(r["arrival"] for r in spark.read.parquet(out).collect()) == want and len(want) > 10
