"""The file record: what each operation on a key makes of it, folded over operations in order of arrival.

Version order is not transitive where only some versions carry a sequencer, so mixed histories need the ordered fold;
keys whose versions all carry one, or none, need only the newest version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.versions import compare_versions, is_newer, lease_held, moment
from tidemark.operators.ordering import ranged
from tidemark.shared import cut

LEASE = "INTERVAL '2' MINUTE"
NONE = "CAST(NULL AS TIMESTAMP_NTZ)"
#: State fields, their types and what a new row holds.
FIELDS = {
    "source_version": ("string", "''"),
    "source_size": ("bigint", "CAST(0 AS BIGINT)"),
    "source_mtime": ("timestamp_ntz", NONE),
    "source_sequencer": ("string", "''"),
    "synced_version": ("string", "''"),
    "synced_mtime": ("timestamp_ntz", NONE),
    "synced_sequencer": ("string", "''"),
    "sha256": ("string", "''"),
    "dest_version": ("string", "''"),
    "status": ("string", "'pending'"),
    "attempts": ("int", "0"),
    "last_error": ("string", "''"),
    "upload_id": ("string", "''"),
    "upload_version": ("string", "''"),
    "claimed_until": ("timestamp_ntz", NONE),
    "event_time": ("timestamp_ntz", NONE),
    "synced_at": ("timestamp_ntz", NONE),
}
#: What the end of a lease makes of a row: another may claim it.
FREED = {"status": "pending", "claimed_until": None}
#: Columns of an operation besides pipeline_id and key.
OPS = "arrival op version size mtime sequencer event_time at retryable detail".split()


def new_row(f=F) -> Column:
    return f.struct(*[f.expr(v).cast(t).alias(n) for n, (t, v) in FIELDS.items()])


def decision(r: Column, c: Column, f=F) -> Column:
    """decide() for a row that exists, on structs."""
    synced = r["synced_version"]
    held = lease_held(r["status"], r["claimed_until"], c["at"], f)
    return (
        f.when((r["status"] != "deleted") & (synced != "") & (synced == c["version"]), "already_synced")
        .when((synced != "") & (synced != c["version"]) & (compare_versions(c["sequencer"], c["mtime"], r["synced_sequencer"], r["synced_mtime"], f) < 0), "stale")
        .when(held & (r["source_version"] != c["version"]) & (compare_versions(c["sequencer"], c["mtime"], r["source_sequencer"], r["source_mtime"], f) < 0), "stale")
        .when(held, "busy")
        .otherwise("copy")
    )


def step(r: Column, o: Column, f=F) -> Column:
    """The row after an operation, as columns or, with f = functions.plain.PLAIN, as plain values."""
    is_ = lambda *names: o["op"].isin(*names)
    newer = is_newer(o["sequencer"], o["mtime"], o["version"], r["source_sequencer"], r["source_mtime"], r["source_version"], f)
    observed = is_("observe") & (r["status"] != "copying") & newer
    claimed = is_("claim") & (decision(r, o, f) == "copy")
    held = lease_held(r["status"], r["claimed_until"], o["at"], f) & (r["source_version"] == o["version"])
    extended, uploading, completed, failed = (is_(x) & held for x in ("extend", "set_upload", "complete", "fail"))
    deleted = is_("delete") & (o["event_time"].isNull() | (moment(o["event_time"], f) >= moment(r["source_mtime"], f)))
    moved = observed | claimed
    lease = o["at"] + f.expr(LEASE)
    kept = r["status"].isin("pending", "failed") & r["event_time"].isNotNull()
    older = ~r["status"].isin("synced", "deleted") & r["event_time"].isNotNull() & (o["event_time"].isNull() | (r["event_time"] < o["event_time"]))
    new = {
        "source_version": f.when(moved, o["version"]),
        "source_size": f.when(moved, o["size"]),
        "source_mtime": f.when(moved, o["mtime"]),
        "source_sequencer": f.when(moved, o["sequencer"]),
        "synced_version": f.when(completed, r["source_version"]),
        "synced_mtime": f.when(completed, r["source_mtime"]),
        "synced_sequencer": f.when(completed, r["source_sequencer"]),
        "sha256": f.when(completed, o["detail"]),
        "dest_version": f.when(completed, o["version"]),
        "status": f.when(observed, f.when((r["status"] == "synced") & (o["version"] == r["synced_version"]), "synced").otherwise("pending"))
        .when(claimed, "copying")
        .when(completed, "synced")
        .when(failed, f.when(o["retryable"], "pending").otherwise("failed"))
        .when(deleted, "deleted"),
        "attempts": f.when(claimed, f.when(r["source_version"] == o["version"], r["attempts"] + 1).otherwise(1)),
        "last_error": f.when(completed, "").when(failed, o["detail"]),
        "upload_id": f.when(completed, "").when(uploading, o["detail"]),
        "upload_version": f.when(completed, "").when(uploading, o["version"]),
        "claimed_until": f.when(claimed | extended, lease).when(completed | failed | deleted, f.expr(NONE)),
        "event_time": f.when(observed, f.when(kept, r["event_time"]).otherwise(o["event_time"])).when(claimed,
            f.when(older, r["event_time"]).otherwise(o["event_time"])).when(deleted, o["event_time"]),
        "synced_at": f.when(completed, o["at"]),
    }
    touched = {"claimed_until": claimed | extended | completed | failed | deleted, "event_time": moved | deleted, "source_mtime": moved, "synced_mtime": completed}
    value = lambda n: f.when(touched[n], new[n]).otherwise(r[n]) if n in touched else f.coalesce(new[n], r[n])
    return f.struct(*[value(n).cast(t).alias(n) for n, (t, _) in FIELDS.items()])


#: Operations of a key that are folded at once.
SLICE = 20_000


def fold_lists(listed: DataFrame, resume: DataFrame | None) -> DataFrame:
    """listed(pipeline_id, key, ops) folded, from a new row or from resume."""
    keys = ["pipeline_id", "key"]
    start = new_row()
    if resume is not None:
        listed = listed.join(resume.select(*keys, F.struct(*FIELDS).alias("old")), keys, "full_outer").withColumn("ops", F.coalesce("ops", F.array().cast(listed.schema["ops"].dataType)))
        start = F.coalesce("old", start)
    folded = listed.withColumn("r", F.aggregate("ops", start, lambda r, o: step(r, o)))
    return folded.select(*keys, *[F.col("r")[n].alias(n) for n in FIELDS])


def fold(ops: DataFrame, resume: DataFrame | None = None, size: int = SLICE) -> DataFrame:
    """The record of each (pipeline_id, key) after all its ops in order of arrival, from the rows of resume if given.

    A key's operations are listed size at a time; keys with more are cut into slices, see fold_slices.
    """
    keys = ["pipeline_id", "key"]
    gathered = F.array_sort(F.collect_list(F.struct(*OPS))).alias("ops")
    counts = ops.groupBy(*keys).agg(F.count("*").alias("n"))
    longest, long_ones = counts.agg(F.max("n"), F.coalesce(F.sum(F.when(F.col("n") > size, F.col("n"))), F.lit(0))).first()
    if (longest or 0) <= size:
        return fold_lists(ops.groupBy(*keys).agg(gathered), resume)
    heavy = cut(counts.where(F.col("n") > size).select(*keys), "heavy")
    of = lambda df, how: None if df is None else df.join(heavy, keys, how)
    light = fold_lists(of(ops, "left_anti").groupBy(*keys).agg(gathered), of(resume, "left_anti"))
    parts = ranged(of(ops, "left_semi").select(*keys, *OPS), keys, ["arrival"], -(-long_ones // size))
    return light.unionByName(fold_slices(cut(parts.groupBy(*keys, "__part").agg(gathered), "slices"), of(resume, "left_semi")))


def fold_slices(slices: DataFrame, resume: DataFrame | None, rounds: list[int] | None = None) -> DataFrame:
    """slices(pipeline_id, key, __part, ops), in order of __part, folded all at once and then where they were wrong.

    In the first round every slice goes on from a new row, as if nothing had been before it. As versions become newer with
    time, a slice in which a newer version was copied leaves the same record whatever it began with. Each further round folds
    those slices anew that did not begin with what the slice before has left by now, all at the same time; when there is none
    the fold is that of one operation after another. That takes a few rounds for histories that move on, more where an early
    version outlives whole slices, and never more rounds than there are slices. rounds, if given, gets the
    number of slices of each round.
    """
    keys = ["pipeline_id", "key"]
    nothing = new_row()
    order = slices.select(*keys, "__part", F.lag("__part").over(Window.partitionBy(*keys).orderBy("__part")).alias("before"))
    if resume is not None:
        order = order.join(resume.select(*keys, F.struct(*FIELDS).alias("old")), keys, "left")
    first = F.coalesce(F.col("old"), nothing) if resume is not None else nothing
    order = cut(order.select(*keys, "__part", "before", F.when(F.col("before").isNull(), first).otherwise(nothing).alias("began")), "order")

    def folded(begun: DataFrame) -> DataFrame:
        """begun(keys, __part, began) with left, what the slice makes of it."""
        return begun.join(slices, [*keys, "__part"]).select(*keys, "__part", "began", F.aggregate("ops", F.col("began"), lambda r, o: step(r, o)).alias("left"))

    before = order.select(*keys, "__part", "before")
    now = cut(folded(order.select(*keys, "__part", "began")), "folded")
    while True:
        left = now.select(*keys, F.col("__part").alias("before"), F.col("left").alias("begins"))
        wrong = now.join(before, [*keys, "__part"]).join(left, [*keys, "before"]).where(~F.col("began").eqNullSafe(F.col("begins")))
        wrong = cut(wrong.select(*keys, "__part", F.col("begins").alias("began")), "wrong")
        n = wrong.count()
        if rounds is not None:
            rounds.append(n)
        if not n:
            break
        now = cut(now.join(wrong.select(*keys, "__part"), [*keys, "__part"], "left_anti").unionByName(folded(wrong)), "folded")
    last = now.groupBy(*keys).agg(F.max_by("left", "__part").alias("r"))
    return last.select(*keys, *[F.col("r")[n].alias(n) for n in FIELDS])


def newest(changes: DataFrame) -> DataFrame:
    """The newest version of each key, where all of its versions carry a sequencer or none does; ties to the later arrival."""
    w = Window.partitionBy("pipeline_id", "key")
    padded = F.lpad(F.lower("sequencer"), F.max(F.length("sequencer")).over(w), F.lit("0"))
    pure = F.when(F.min(F.col("sequencer") != "").over(w) == F.max(F.col("sequencer") != "").over(w), True).otherwise(False)
    rows = changes.withColumn("__pure", pure).withColumn("__seq", padded).where("__pure")
    rows = rows.withColumn("nth", F.row_number().over(w.orderBy(F.desc("__seq"), F.desc(F.when(F.col("sequencer") == "", moment("event_time"))), F.desc("arrival"))))
    return rows.where("nth = 1").drop("nth", "__seq", "__pure")


def claim(candidates: DataFrame, record: DataFrame, now: Column) -> DataFrame:
    """candidates(pipeline_id, key, version, mtime, sequencer, event_time) with the decision and, on copy, lease and attempts.

    A key's candidates are in line: at most one of them gets the copy, the first by arrival; the others are busy.
    """
    keys = ["pipeline_id", "key"]
    r = record.select(*keys, F.struct(*FIELDS).alias("r"))
    joined = candidates.join(r, keys, "left").withColumn("r", F.coalesce("r", new_row())).withColumn("c", F.struct("version", "mtime", "sequencer", now.alias("at")))
    decided = joined.withColumn("decision", decision(F.col("r"), F.col("c")))
    first = F.row_number().over(Window.partitionBy(*keys, "decision").orderBy("arrival"))
    decided = decided.withColumn("decision", F.when((F.col("decision") == "copy") & (first > 1), "busy").otherwise(F.col("decision")))
    copy = F.col("decision") == "copy"
    return decided.select(
        *keys, "version", "arrival", "decision",
        F.when(copy, now + F.expr(LEASE)).alias("claimed_until"),
        F.when(copy, F.when(F.col("r.source_version") == F.col("version"), F.col("r.attempts") + 1).otherwise(1)).alias("attempts"),
    )


def free_lapsed(records: DataFrame, now: Column) -> DataFrame:
    """The rows of records whose lease has lapsed, pending again for another to claim."""
    lapsed = (F.col("status") == "copying") & F.col("claimed_until").isNotNull() & (F.col("claimed_until") <= now)
    return records.where(lapsed).withColumns({"status": F.lit("pending"), "claimed_until": F.expr(NONE)})


def first_seen(starts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The first start of each pipeline; one that is known stays."""
    new = starts.groupBy("pipeline_id").agg(F.min("started_at").alias("first"))
    if known is None:
        return new.withColumnRenamed("first", "started_at")
    return known.join(new, "pipeline_id", "full_outer").select("pipeline_id", F.coalesce("started_at", "first").alias("started_at"))
