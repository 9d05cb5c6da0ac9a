"""The rules' own cases: truth tables, goldens and properties, on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import globs, text, versions
from tidemark.operators import events, metrics, ordering, reconcile, record, specs, verify, work
from tidemark.sources import readers
from tidemark.streaming import streams

T = "timestamp_ntz"


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_sequencers(spark):
    """Generated hexadecimal numbers of any width and case are ordered as the numbers that they write."""
    rng = random.Random(21)
    number = lambda: "".join(rng.choices("0123456789abcdefABCDEF", k=rng.choice([0, 1, 2, 3, 18, 45])))
    cases = [(x := number(), rng.choice([number(), x.swapcase(), "00" + x])) for _ in range(400)]
    sign = lambda n: (n > 0) - (n < 0)
    got = values(spark, cases, "a string, b string", "a", "b", versions.compare_sequencers("a", "b"))
    assert [(x, y, z) for x, y, z in got if z != sign(int(x or "0", 16) - int(y or "0", 16))] == []


STATES = [None, "pending", "copying", "copying", "copying", "synced", "failed", "deleted"]
CLOCK = 1000


def precedes(a, b):
    """Whether version a = (name, sequencer, minute) is older than b: by the numbers that their sequencers write, if both have one."""
    if a[1] and b[1]:
        return int(a[1], 16) < int(b[1], 16)
    return (-1 if a[2] is None else a[2]) < (-1 if b[2] is None else b[2])


def expected_decision(state, synced, source, lease_end, candidate):
    """The rule in words: what is synced is not copied again, unless deleted since; what is older than the synced or the
    claimed version is stale; a running lease keeps others out; all else is copied."""
    if state is None:
        return "copy"
    leased = state == "copying" and lease_end is not None and lease_end > CLOCK
    if synced[0]:
        if candidate[0] == synced[0]:
            if state != "deleted":
                return "already_synced"
        elif precedes(candidate, synced):
            return "stale"
    if leased:
        return "stale" if candidate[0] != source[0] and precedes(candidate, source) else "busy"
    return "copy"


def random_version(rng):
    return (f"v{rng.randrange(3)}", rng.choice(["", "", "7", "0A", "a", "1f", "0000001F", "FFFFFFFFFFFFFFFFFFFF1"]), rng.randrange(4))


def test_decide(spark):
    """Generated records and candidates against the rule written out in Python; every decision comes up often."""
    rng = random.Random(12)
    nothing, rows = ("", "", None), []
    for k in range(3000):
        state = rng.choice(STATES)
        synced = random_version(rng) if state and rng.random() < 0.6 else nothing
        source = random_version(rng) if state else nothing
        lease = rng.choice([None, CLOCK - 1, CLOCK, CLOCK + 1]) if state else None
        candidate = random_version(rng)
        rows.append((k, state is not None, state or "", *synced, *source, lease, *candidate, expected_decision(state, synced, source, lease, candidate)))
    schema = "k int, found boolean, r_status string, " + "".join(f"{p}_version string, {p}_sequencer string, {p}_minute int, " for p in ("r_synced", "r_source")) + "lease int, c_version string, c_sequencer string, c_minute int, want string"
    at = lambda minute: F.expr(f"TIMESTAMP_NTZ '2020-01-01' + make_interval(0, 0, 0, 0, 0, {minute}, 0)")
    df = spark.createDataFrame(rows, schema).withColumns({"r_synced_mtime": at("r_synced_minute"), "r_source_mtime": at("r_source_minute"), "c_mtime": at("c_minute"), "r_claimed_until": at("lease")})
    got = df.select("k", "want", versions.decide("found", "r_", "c_", at(CLOCK)).alias("got")).collect()
    assert [(rows[r["k"]], r["got"]) for r in got if r["want"] != r["got"]] == []
    assert all(sum(r["got"] == d for r in got) > 100 for d in ("copy", "already_synced", "stale", "busy"))


def in_segment(glob, key):
    """Whether tokens of a glob without ** match a whole key, one character after the other."""
    if not glob:
        return not key
    first, rest = glob[0], glob[1:]
    if first == "*":
        return any(in_segment(rest, key[n:]) for n in range(len(key) + 1) if "/" not in key[:n])
    if not key:
        return False
    fits = key[0] != "/" if first == "?" else key[0] in first[1:-1] if first[0] == "[" and first[1] != "^" else key[0] not in first[2:-1] if first[0] == "[" else key[0] == first[-1]
    return fits and in_segment(rest, key[1:])


def glob_hits(deep, tokens, below, key):
    starts = [0, *(i + 1 for i, c in enumerate(key) if c == "/")] if deep else [0]
    ends = [i for i, c in enumerate(key) if c == "/"] if below else [len(key)]
    return any(in_segment(tokens, key[i:j]) for i in starts for j in ends if i <= j)


def test_globs(spark):
    """Generated globs and keys against a matcher that follows the words of the rules."""
    rng = random.Random(31)
    letters = ["m", "n", "/", ".", "*", "?", "[mn]", "[^m]", "\\*", "*"]
    patterns = [(rng.random() < 0.4, rng.choices(letters, k=rng.randint(1, 4)), rng.random() < 0.3) for _ in range(60)]
    patterns = [(d, t, b) for d, t, b in patterns if "**" not in "".join(t) and "".join(t)[0] != "/"]
    keys = ["".join(rng.choices("mn/.*\n", k=rng.randint(0, 6))) for _ in range(150)]
    text = lambda d, t, b: "**/" * d + "".join(t) + "/**" * b
    got = values(spark, [(k,) for k in keys], "key string", "key", *[globs.matches("key", [text(*p)]) for p in patterns])
    assert [(r[0], text(*p)) for r in got for p, hit in zip(patterns, r[1:], strict=True) if hit != glob_hits(*p, r[0])] == []
    both = values(spark, [(k,) for k in keys], "key string", "key", globs.matches("key", ["m*", "**/n*"], ["**/m?", "[mn]/**"]), globs.matches("key", [], ["?"]), globs.matches("key"))
    for key, some, not_one, every in both:
        excluded = glob_hits(True, ["m", "?"], False, key) or glob_hits(False, ["[mn]"], True, key)
        assert some == ((glob_hits(False, ["m", "*"], False, key) or glob_hits(True, ["n", "*"], False, key)) and not excluded)
        assert every and not_one == (len(key) != 1 or key == "/")
    for bad in ("[mn", "m/**/n/o", "**", "m**n", "n\\", "[]", "[m-", "**/**"):
        with pytest.raises(globs.BadPattern):
            globs.key_regex(bad)


def test_resume_of_layouts_equals_that_of_parts(spark):
    """Uploads of any kind, wrong, stray and missing ones, against the join of parts; no part of the plan is made."""
    rng = random.Random(5)
    sizes = [(f"k{k}", rng.choice([0, 1, 7, 8, 9, 16, 20, 33])) for k in range(120)]
    objects = spark.createDataFrame([(k, n, (8, -(-n // 8))) for k, n in sizes], "key string, size bigint, layout struct<part_size:bigint,n_parts:bigint>")
    up = []
    for k, n in sizes:
        parts = [(k, x + 1, min(8, n - 8 * x)) for x in range(-(-n // 8)) if rng.random() < 0.8]
        if parts and rng.random() < 0.4:
            k, x, length = parts.pop(rng.randrange(len(parts)))
            parts.append((k, rng.choice([x, x, x, 0, 6]), rng.choice([length - 1, length + 1, 8, 0, None])))
        up += parts
    up += [("stray", 1, 8), ("unknown", 1, None)]
    uploaded = spark.createDataFrame(up, "key string, number bigint, length bigint")
    rows = lambda df: sorted(map(tuple, df.select("key", "usable", "parts", "uploaded", "missing").collect()))
    got = work.resume_layout(objects, uploaded)
    assert rows(got) == rows(work.resume(work.part_plan(objects), uploaded)) and {r[1] for r in rows(got)} == {True, False}
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_text(spark):
    one = spark.range(1)
    L = F.lit

    def got(function, *given):
        return list(one.select(*[function(L(x)).alias(f"c{k}") for k, x in enumerate(given)]).first())

    assert got(text.etag_normalise, ' W/"7f" ', '"7f"', "7f", '""', '"', 'x"') == ["7f", "7f", "7f", "", '"', 'x"']
    units = {"KiB": 1 << 10, "MB": 10**6, "GiB": 1 << 30, "B": 1}
    assert got(text.parse_byte_size, *[f"{n} {u}" for n, u in enumerate(units, 3)]) == [n * v for n, v in enumerate(units.values(), 3)]
    assert got(text.parse_byte_size, "777", "MiB", "-4KB", "2.5MB") == [777, None, None, None]
    assert got(text.parse_size, "12MB", "2.25KiB", "90", "3 tb", "GB", "4.4.4B") == [12 * 10**6, 2304, 90, 3 * 10**12, None, None]
    assert got(text.parse_rate, "", "0", "172800B/day", "3KiB/s", "8", "2B/month") == [0.0, 0.0, 2.0, 3072.0, None, None]
    assert got(text.human_bytes, 5, 1000, 2560, 3 << 20, 1331) == ["5 B", "1000 B", "2.5 KiB", "3.0 MiB", "1.3 KiB"]
    assert got(text.human_decimal, 12, 2500, 7 * 10**9) == ["12 B", "2.50 KB", "7.00 GB"]
    big = 12_345 * 10**12
    assert got(text.human_decimal, big) + got(lambda n: text.human_decimal(n, "KMGT"), big) == ["12.34 PB", "12345.00 TB"]
    assert got(text.human_bytes, 3 << 50) + got(lambda n: text.human_bytes(n, "KMGT"), 3 << 50) == ["3.0 PiB", "3072.0 TiB"]
    assert got(text.short_duration, -3.0, 0.25, 7.0, 605.0, 7260.0, 187200.0, 119.8) == ["0s", "250ms", "7s", "10m05s", "2h01m", "2d4h", "2m00s"]
    assert got(text.redact, "postgres://me:pw@db/x?sslmode=off&token=abc", "host=db password='p w' user=me") == ["postgres://me:xxxxx@db/x?sslmode=off&token=xxxxx", "host=db password=xxxxx user=me"]
    layout = lambda size: one.select(text.part_layout(L(size), L(0))).first()[0]
    assert layout(64 * text.MIB * 30)["n_parts"] == 30 and layout(64 * text.MIB * 30 + 1)["n_parts"] == 31 and layout(1 << 62) is None
    assert got(text.normalise_prefix, "", "//", "/in", "in/out", "in/") == ["", "", "in/", "in/out/", "in/"]
    assert got(text.valid_name, "x7", "x", "x-7-y", "x--7", "x-", "X7", "y" * 40, "y" * 41) == [True, False, True, False, False, False, True, False]
    assert [v is not None for v in got(text.md5_from_etag, "0f" * 16, "0f" * 16 + "-9", "0x" * 16)] == [True, False, False]


def test_blob_urls(spark):
    """URLs put together from their parts come apart again; hosts without a dot and addresses have the account in the path."""
    cases = []
    for host, by_path in (("store.example.net", False), ("10.1.2.3:8080", True), ("devhost", True), ("[fe80::1]:99", True), ("devhost:77", True)):
        for name in ("top", "in/a+b", "in/sp%20ace", "x/y/z.bin?sig=1#f"):
            said = name.split("?")[0].replace("%20", " ")
            cases.append((f"https://{host}/{'acc/' * by_path}box/{name}", ("box", said)))
        cases += [(f"http://{host}/{'acc/' * by_path}box{end}", None) for end in ("", "/")]
    cases += [("http://devhost/acc", None), ("", None), ("no url", None)]
    got = values(spark, [(u,) for u, _ in cases], "u string", "u", events.blob_from_url("u"))
    assert [(u, g and tuple(g)) for u, g in got] == cases


def test_messages(spark):
    import base64

    ok = '{"eventType":"Microsoft.Storage.BlobCreated","id":"1","eventTime":"2026-01-01T00:00:00.5+01:00","data":{"url":"https://a.b/c/k","eTag":"\\"x\\"","contentLength":3}}'
    url = base64.urlsafe_b64encode(ok.encode()).decode().rstrip("=")
    rows = [(1, ok), (2, url), (3, f"[{ok},{ok}]"), (4, ""), (5, "***"), (6, "{}"), (7, ok.replace("2026-01-01T00:00:00.5+01:00", "yesterday")), (8, "[]"), (9, "[1]")]
    got = events.parse_messages(spark.createDataFrame(rows, "message_id int, message string")).orderBy("message_id", "nth").collect()
    assert [(r["message_id"], r["malformed"]) for r in got] == [(1, ""), (2, ""), (3, ""), (3, ""), (4, "empty message"), (5, "neither JSON nor base64"), (6, "no event type"), (7, "event time"), (8, "not a JSON object or array"), (9, "not a JSON object or array")]
    assert str(got[0]["event_time"]) == "2025-12-31 23:00:00.500000"


def interpolated(rows, q):
    """The quantile of cumulative (bound, count) rows by walking along them."""
    rank, low, below = q * rows[-1][1], 0.0, 0.0
    for bound, count in rows[:-1]:
        if count >= rank:
            return low + (bound - low) * (rank - below) / (count - below) if count > below else low
        low, below = bound, count
    return low


def test_quantiles_of_generated_histograms(spark):
    rng, inf = random.Random(7), float("inf")
    rows = []
    for g in range(12):
        bounds, counts = sorted(rng.sample(range(1, 400), 5)), sorted(rng.sample(range(1, 900), 6))
        rows += [(g, float(b), float(c)) for b, c in zip([*bounds, inf], counts, strict=True)]
    h = spark.createDataFrame(rows, "g int, le double, count double")
    qs = [0.0, 0.03, 0.25, 0.6, 0.77, 0.97, 1.0]
    got = {(r["g"], r["q"]): r["value"] for r in metrics.quantiles(h, qs, "g").collect()}
    assert len(got) == 12 * len(qs)
    for (g, q), value in got.items():
        assert value == pytest.approx(interpolated([(b, c) for i, b, c in rows if i == g], q))


def test_quantile_edges(spark):
    inf = float("inf")
    one = lambda h, q: metrics.quantile(h, q).first()["value"]
    h = spark.createDataFrame([(3.0, 4.0), (8.0, 4.0), (inf, 16.0)], "le double, count double")
    assert one(h, -0.5) == -inf and one(h, 1.5) == inf and one(h, 0.25) == 3.0 and one(h, 0.9) == 8.0
    nan = lambda v: v != v
    assert nan(one(h.where("le < 9"), 0.5)) and nan(one(h.withColumn("count", F.lit(0.0)), 0.5)) and nan(one(h.where(F.col("le") == inf), 0.5))
    falling = spark.createDataFrame([(-2.0, 6.0), (4.0, 1.0), (inf, 6.0)], "le double, count double")
    assert one(falling, 0.3) == -2.0


def test_metrics_text(spark):
    lines = [("# TYPE jobs counter", 0), ("   ", 1), ('jobs{who="say \\"hi\\", {you}",path="C:\\\\tmp\\nx"} -Inf 99', 2), ("load 25e-1", 3), ("idle{} NaN", 4)]
    got = {r["n"]: r for r in readers.metric_samples(spark.createDataFrame(lines, "line string, n int")).collect()}
    assert sorted(got) == [2, 3, 4]
    assert got[2]["labels"] == {"who": 'say "hi", {you}', "path": "C:\\tmp\nx"} and got[2]["value"] == float("-inf") and got[3]["value"] == 2.5


def test_manifest_last_write(spark):
    rows = [("k", 1, "a", "2026-01-01", 0), ("k", 2, "b", "2026-01-02", 1), ("k", 3, "c", "2026-01-02", 2), ("j", 4, "d", "2026-01-01", 3)]
    m = spark.createDataFrame(rows, "key string, size long, sha256 string, d string, ord int").withColumn("written_at", F.col("d").cast(T)).drop("d")
    assert sorted((r["key"], r["size"], r["writes"]) for r in verify.last_writes(m, "ord").collect()) == [("j", 4, 1), ("k", 3, 3)]
    assert sorted((r["key"], r["size"]) for r in verify.last_writes_ranked(m, "ord").collect()) == [("j", 4), ("k", 3)]


@pytest.mark.parametrize(("live", "gone"), [(900, 101), (404, 101), (403, 101), (300, 100), (50, 50), (402, 0)])
def test_mass_delete(spark, live, gone):
    """Refused are more than a hundred deletes that are more than a quarter of what is live, and nothing else."""
    base = spark.range(live).select(F.lit("p").alias("pipeline_id"), F.col("id").cast("string").alias("key"), F.lit("v").alias("version"), F.expr("TIMESTAMP_NTZ '2020-01-01'").alias("mod_time"))
    rec = base.select("pipeline_id", "key", F.lit("v").alias("synced_version"), F.lit("synced").alias("status"), F.lit(None).cast(T).alias("claimed_until"))
    d = reconcile.diff(base.where(F.col("key").cast("int") >= gone), rec, F.expr("TIMESTAMP_NTZ '2020-01-02'"))
    found = d.where("action = 'delete_candidate'")
    guard = reconcile.mass_delete_guard(found, d)
    refused = gone > 100 and 4 * gone > live
    assert guard.first()["verdict"] == ("refuse" if refused else "ok")
    assert reconcile.allowed_deletes(found, guard).count() == (0 if refused else gone)


def ops_frame(spark, rows):
    schema = f"pipeline_id string, key string, arrival long, op string, version string, size long, minute int, sequencer string, retryable boolean, detail string"
    df = spark.createDataFrame(rows, schema)
    at = F.expr("TIMESTAMP_NTZ '2026-01-01' + make_interval(0, 0, 0, 0, 0, minute, 0)")
    return df.select("pipeline_id", "key", "arrival", "op", "version", "size", at.alias("mtime"), "sequencer", at.alias("event_time"), at.alias("at"), "retryable", "detail")


def test_versions_in_any_order(spark):
    """However versions arrive, and however often, the record has the newest of those seen so far."""
    rng = random.Random(17)
    for _ in range(3):
        order = [rng.randrange(1, 8) for _ in range(10)]
        rows = [("p", "k", i, "observe", f"v{v}", v, v, f"{v:x}", False, "") for i, v in enumerate(order)]
        for n in (1, 4, 10):
            assert record.fold(ops_frame(spark, rows[:n])).first()["source_version"] == f"v{max(order[:n])}"


def random_ops(seed, n=120):
    rng = random.Random(seed)
    kinds = ["observe", "claim", "extend", "set_upload", "complete", "fail", "delete"]
    return [("p", f"k{rng.randrange(4)}", i, rng.choice(kinds), f"v{rng.randrange(4)}", i, rng.randrange(30), rng.choice(["", "", "a", "1f", "02"]), rng.random() < 0.5, f"d{i}") for i in range(n)]


def states(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_stream_equals_fold(spark, tmp_path):
    """The stream over several batches ends in the state of the batch fold of the same order of arrival."""
    rows = random_ops(3)
    folder = tmp_path / "ops"
    for k in range(3):
        ops_frame(spark, rows[40 * k : 40 * k + 40]).coalesce(1).write.mode("append").parquet(str(folder / f"part={k}"))
    stream = spark.readStream.schema(ops_frame(spark, rows[:1]).schema).parquet(*[str(folder / "part=*")])
    out = str(tmp_path / "out")
    streams.run(stream, out, streams.record_sink(out)).awaitTermination()
    assert states(streams.states(spark, out)) == states(record.fold(ops_frame(spark, rows)))


def test_stream_of_many_batches(spark, tmp_path, monkeypatch):
    """More batches than one snapshot spans, one of them run twice; hooks see every batch's rows."""
    monkeypatch.setattr(streams, "COMPACT", 2)
    rows, out, seen = random_ops(4), str(tmp_path / "out"), []
    started = []
    each = streams.with_hooks(streams.record_sink(out), started.append, lambda n, figures: seen.append((n, figures["rows"], figures["last"])), last=F.max("arrival"))
    for k in range(6):
        batch = ops_frame(spark, rows[20 * k : 20 * k + 20])
        each(batch, k)
        if k == 3:
            each(batch, k)
        assert states(streams.states(spark, out)) == states(record.fold(ops_frame(spark, rows[: 20 * k + 20])))
    assert started == [0, 1, 2, 3, 3, 4, 5] and seen == [(k, 20, 20 * k + 19) for k in (0, 1, 2, 3, 3, 4, 5)]


def test_fold_in_slices(spark):
    """Histories longer than a slice, with and without a record to go on from."""
    rows = random_ops(6, 200)
    want = states(record.fold(ops_frame(spark, rows)))
    assert states(record.fold(ops_frame(spark, rows), size=7)) == want
    assert states(record.fold(ops_frame(spark, rows[90:]), record.fold(ops_frame(spark, rows[:90]), size=11), size=13)) == want


def test_fold_of_a_hot_key(spark):
    """One key's long history in hundreds of slices takes a few rounds; a difference that lives on takes more, and is found."""
    gathered = F.array_sort(F.collect_list(F.struct(*record.OPS))).alias("ops")
    for size, step, most in ((100, 10, 7), (400, 10**9, 6)):  # operations per minute of the versions' times: with the last one times do not move on
        df = ops_frame(spark, [("p", "k", *r[2:6], r[6] + r[2] // step, *r[7:]) for r in random_ops(8, 2_000)])
        want = states(record.fold(df))
        slices = df.withColumn("__part", F.floor(F.col("arrival") / size).cast("int")).groupBy("pipeline_id", "key", "__part").agg(gathered)
        rounds = []
        assert states(record.fold_slices(slices.persist(), None, rounds)) == want and len(rounds) <= most and rounds[-1] == 0
    quiet = [("p", "k", 0, "observe", "v", 1, 1, "", False, ""), *[("p", "k", n, "none", "", 0, 0, "", False, "") for n in range(1, 60)]]
    slices = ops_frame(spark, quiet).withColumn("__part", F.floor(F.col("arrival") / 10).cast("int")).groupBy("pipeline_id", "key", "__part").agg(gathered)
    rounds = []
    assert states(record.fold_slices(slices.persist(), None, rounds)) == states(record.fold(ops_frame(spark, quiet))) and len(rounds) == 6


def test_fold_resumes(spark):
    rows = random_ops(5)
    first = record.fold(ops_frame(spark, rows[:70]))
    assert states(record.fold(ops_frame(spark, rows[70:]), first)) == states(record.fold(ops_frame(spark, rows)))


def test_replay_changes_nothing(spark):
    """Delivering every observation twice in a row gives the same state."""
    rows = [r for r in random_ops(9) if r[3] == "observe"]
    twice = [(*r[:2], 2 * r[2] + n, *r[3:]) for r in rows for n in (0, 1)]
    assert states(record.fold(ops_frame(spark, twice)).drop("source_size")) == states(record.fold(ops_frame(spark, [(*r[:2], 2 * r[2], *r[3:]) for r in rows])).drop("source_size"))


def test_work_dedupe(spark):
    jobs = spark.createDataFrame([("p", "k", "v", 0, 1, 5), ("p", "k", "v", 0, 1, 3), ("p", "k", "v", 1, 1, 4), ("p", "j", "v", 0, 1, 6)], "pipeline_id string, key string, version string, generation int, window long, arrival long")
    held = spark.createDataFrame([("p", "j", "v", 0, 1, "running"), ("p", "k", "v", 1, 1, "completed")], "pipeline_id string, key string, version string, generation int, window long, state string")
    assert sorted((r["key"], r["generation"], r["arrival"]) for r in work.dedupe(jobs, held).collect()) == [("k", 0, 3), ("k", 1, 4)]


def test_spec_problems(spark):
    good = '{"source":{"s3":{"bucket":"a","region":"r"}},"destination":{"azure":{"container":"c","account_url":"u"}}}'
    bad = '{"source":{"azure":{"container":"","auth":"x"},"s3":null},"destination":{"s3":{"bucket":"b","region":"r","flavor":"q","access_key_id":"k"}},"events":{"type":"webhook","webhook_secret":"short"},"part_size":"1MiB","existing_files":"no","concurrency":-1,"reconcile_seconds":5}'
    got = {r["name"]: r["problems"] for r in specs.validate(spark.createDataFrame([("good", good), ("Bad", bad), ("text", "{")], "name string, spec string")).collect()}
    assert got["good"] == []
    assert [p.split(":")[0] for p in got["Bad"]] == ["name", "source.azure.container", "source.azure.auth", "destination.s3.flavor", "destination.s3.access_key_id", "existing_files", "events.webhook_secret", "concurrency", "part_size", "reconcile_interval"]
    old = spark.createDataFrame([("aa", good, True, 3)], "name string, spec string, enabled boolean, revision long")
    same = spark.createDataFrame([("aa", good.replace(":", ": ")), ("bb", good)], "name string, spec string")
    assert sorted((r["name"], r["revision"]) for r in specs.apply_all_or_nothing(old, same).collect()) == [("aa", 3), ("bb", 1)]
    assert [(r["name"], r["revision"]) for r in specs.apply_all_or_nothing(old, same.union(spark.createDataFrame([("cc", bad)], "name string, spec string"))).collect()] == [("aa", 3)]


def test_strict_manifest_names_the_line(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"key":"a","size":1,"sha256":"' + "0" * 64 + '","written_at":"2026-01-01T00:00:00Z"}\n\n{"key":"b","size":')
    with pytest.raises(Exception, match="line 2 of file 0"):
        readers.manifest_scan(spark, [str(path)]).collect()
    path.write_text(path.read_text().split("\n")[0])
    assert [r["key"] for r in readers.manifest_scan(spark, [str(path)]).collect()] == ["a"]


def test_lines_of_files_in_many_splits(spark, tmp_path):
    """Line numbers do not depend on how files are split."""
    rng = random.Random(3)
    texts = [["x" * rng.randint(0, 90) for _ in range(n)] for n in (0, 1, 700, 1500)]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.txt").write_text("".join(f"{line}\n" for line in text))
    with_size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000b")
    try:
        got = readers.lines(spark, [str(tmp_path / f"{k}.txt") for k in range(4)])
        assert got.rdd.getNumPartitions() >= 1
        assert sorted((r["file_index"], r["line_no"], r["value"]) for r in got.collect()) == [(k, n, v) for k, text in enumerate(texts) for n, v in enumerate(text)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_size)


def test_lines_are_not_shuffled_to_be_numbered(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = readers.lines(spark, [str(tmp_path / "a.txt")])
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["line_no"], r["value"]) for r in got.collect()) == [(0, "x"), (1, "y")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ranks_and_places(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(3), None if rng.random() < 0.1 else float(rng.randrange(40))) for _ in range(500)] + [(5, None), (6, 2.0)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(7)
    for by in ([], ["g"]):
        got = {r["g"] if by else 0: (r["p50"], r["p99"], r["max"]) for r in ordering.nearest_ranks(df, "v", {"p50": 0.5, "p99": 0.99}, *by).collect()}
        groups = {}
        for g, v in rows:
            if v is not None:
                groups.setdefault(g if by else 0, []).append(v)
        rank = lambda x, q: sorted(x)[max(0, -int(-len(x) * q // 1) - 1)]
        assert got == {g: (rank(x, 0.5), rank(x, 0.99), max(x)) for g, x in groups.items()}
    placed = ordering.places(df.where("v IS NOT NULL"), "v").orderBy("place").collect()
    assert [r["place"] for r in placed] == list(range(1, len(placed) + 1)) and [r["v"] for r in placed] == sorted(r["v"] for r in placed)


def test_route_by_globs(spark):
    schema = "message_id int, malformed string, event_type string, url string"
    got = spark.createDataFrame([(k, "", events.CREATED, f"https://a.b.c/box/{p}") for k, p in enumerate(["in/a.csv", "in/tmp/b.csv", "top.txt", "in/c.txt"])], schema)
    targets = spark.createDataFrame([("all", "box", "", [], []), ("in", "box", "in/", ["**/*.csv"], ["tmp/**"]), ("partial", "box", "i", [], []), ("other", "bin", "", [], [])], "pipeline_id string, container string, prefix string, include array<string>, exclude array<string>")
    found = sorted((r["pipeline_id"], r["key"]) for r in events.route(got, events.with_globs(targets)).collect())
    assert found == [("all", "in/a.csv"), ("all", "in/c.txt"), ("all", "in/tmp/b.csv"), ("all", "top.txt"), ("in", "a.csv"), ("partial", "n/a.csv"), ("partial", "n/c.txt"), ("partial", "n/tmp/b.csv")]


def test_formats_of_changes(spark):
    raw = spark.createDataFrame([("p", "upsert", "k", 7)], "a string, b string, c string, d int")
    row = readers.changes(raw, lambda r: r.select(F.col("a").alias("pipeline_id"), F.col("b").alias("kind"), F.col("c").alias("key"), F.col("d").alias("size"), "d")).first()
    assert row.asDict() == {"pipeline_id": "p", "kind": "upsert", "key": "k", "version": "", "size": 7, "sequencer": "", "event_time": None, "detected_at": None, "origin": "event"}
    with pytest.raises(ValueError, match="key"):
        readers.changes(raw, lambda r: r.select(F.col("a").alias("pipeline_id"), F.col("b").alias("kind")))


def test_verification_errors(spark):
    manifest = spark.createDataFrame([("a", 5, "aa"), ("b", 5, "bb"), ("c", 5, "cc"), ("d", 5, "dd")], "key string, size long, sha256 string").withColumn("written_at", F.expr("TIMESTAMP_NTZ '2026-01-01'"))
    dest = spark.createDataFrame([("a", 5, "AA", ""), ("b", 5, "xx", ""), ("c", 0, "", "timeout")], "key string, size long, sha256 string, error string").withColumn("mod_time", F.expr("TIMESTAMP_NTZ '2026-01-01'"))
    row = verify.summary(verify.verify(manifest, dest)).first()
    assert (row["ok"], row["missing"], row["sha256_mismatch"], row["errors"], row["bytes"], row["bytes_hashed"], row["passed"]) == (1, 1, 1, 1, 5, 10, False)


def test_route_by_prefixes(spark):
    """Against every pair: prefixes that end at a slash, within a name, at a whole name, and empty ones; broadcast or not."""
    rng = random.Random(8)
    piece = lambda: "".join(rng.choices("abé", k=rng.randint(0, 2)))
    names = ["/".join(piece() for _ in range(rng.randint(1, 4))) for _ in range(150)]
    prefixes = sorted({n[: rng.randint(0, len(n))] for n in names} | {"", "a/", "é/a/", *names[:20]})
    schema = "message_id int, malformed string, event_type string, url string"
    got = spark.createDataFrame([(k, "", events.CREATED, f"https://x.y.z/box{k % 2}/{n}") for k, n in enumerate(names)], schema)
    targets = spark.createDataFrame([(f"{c}:{p}", f"box{c}", p) for p in prefixes for c in (0, 1)], "pipeline_id string, container string, prefix string")
    want = sorted((k, f"{k % 2}:{p}", n[len(p) :]) for k, n in enumerate(names) for p in prefixes if n.startswith(p) and len(n) > len(p))
    for known in (None, events.reach(targets)._replace(small=False)):
        assert sorted((r["message_id"], r["pipeline_id"], r["key"]) for r in events.route(got, targets, known).collect()) == want
    assert events.route(got, targets.limit(0)).count() == 0 and len(want) > 400
    ends = targets.where("prefix LIKE '%/' OR prefix = ''")
    assert events.reach(ends).lengths == [] and events.route(got, ends).count() == sum(p in ("",) or p.endswith("/") for _, q, _ in want for p in [q[2:]])
