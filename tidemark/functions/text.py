"""Text, size, time and layout expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def etag_normalise(etag) -> Column:
    """Without white space around it, weak mark and one pair of quotes."""
    bare = F.regexp_replace(trimmed(etag), "^W/", "")
    return F.regexp_replace(bare, '(?s)^"(.*)"$', "$1")


def etag_compare(etag) -> Column:
    """Without any quotes at its edges, as two etags are compared."""
    return F.regexp_replace(col(etag), '^"+|"+$', "")


def md5_from_etag(etag) -> Column:
    return F.when(col(etag).rlike(r"\A[0-9a-fA-F]{32}\z"), F.unhex(col(etag)))


def normalise_prefix(prefix) -> Column:
    bare = F.regexp_replace(col(prefix), "^/+", "")
    return F.when((bare == "") | bare.endswith("/"), bare).otherwise(F.concat(bare, F.lit("/")))


def in_prefix(key, prefix) -> Column:
    """Strictly below the prefix."""
    return col(key).startswith(col(prefix)) & (F.length(col(key)) > F.length(col(prefix)))


def strip_prefix(key, prefix) -> Column:
    return F.substr(col(key), F.length(col(prefix)) + 1)


def folder_marker(key) -> Column:
    return col(key).endswith("/")


def content_type(c) -> Column:
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit("application/octet-stream"))


def valid_name(name) -> Column:
    """2 to 40 lower-case letters, digits and single inner hyphens."""
    return col(name).rlike(r"\A[a-z0-9]+(-[a-z0-9]+)*\z") & F.length(col(name)).between(2, 40)


def micros(ts) -> Column:
    return F.date_trunc("MICROSECOND", col(ts))


def endpoint_label(azure_container, s3_bucket, prefix) -> Column:
    """provider:container/prefix where exactly one provider is set, else ''."""
    a, s = F.nullif(col(azure_container), F.lit("")), F.nullif(col(s3_bucket), F.lit(""))
    return (
        F.when(a.isNotNull() & s.isNull(), F.concat(F.lit("azure:"), a, F.lit("/"), col(prefix)))
        .when(s.isNotNull() & a.isNull(), F.concat(F.lit("s3:"), s, F.lit("/"), col(prefix)))
        .otherwise("")
    )


# Query parameters that never carry secrets.
SAFE_PARAMETERS = ("sslmode", "search_path", "application_name", "connect_timeout", "pool_max_conns", "target_session_attrs")


def redact(c) -> Column:
    """A URL without its password and its unsafe query values, parameters by name; a key=value string without its password."""
    s = col(c)
    url = F.regexp_replace(s, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#@:]*):[^/?#@]*@", "$1:xxxxx@")
    head, query = F.split(url, r"\?", 2)[0], F.split(url, r"\?", 2)
    name = lambda p: F.split(p, "=", 2)[0]
    shown = F.transform(F.split(F.get(query, F.lit(1)), "&"), lambda p: F.when(name(p).isin(*SAFE_PARAMETERS), p).otherwise(F.concat(name(p), F.lit("=xxxxx"))))
    masked = F.when(F.size(query) > 1, F.concat(head, F.lit("?"), F.array_join(F.array_sort(shown), "&"))).otherwise(url)
    return F.when(s.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), masked).otherwise(F.regexp_replace(s, r"(?i)(password\s*=\s*)('[^']*'|\S+)", "$1xxxxx"))


def parse_byte_size(c) -> Column:
    """A whole number with an optional unit; null if it is not one."""
    s = trimmed(c)
    unit = F.regexp_extract(s, r"(KiB|MiB|GiB|KB|MB|GB|B)$", 1)
    digits = trimmed(F.regexp_replace(s, r"(KiB|MiB|GiB|KB|MB|GB|B)$", ""))
    factor = F.when(unit == "KiB", KIB).when(unit == "MiB", MIB).when(unit == "GiB", GIB).when(unit == "KB", 10**3).when(unit == "MB", 10**6).when(unit == "GB", 10**9).otherwise(1)
    return F.when(digits.rlike(r"\A\+?[0-9]{1,18}\z"), digits.try_cast("long") * factor.cast("long"))


# Units of sizes and periods.
SIZE_UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "pb": 10**15, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40, "pib": 1 << 50}
PERIODS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hr": 3600, "hour": 3600, "d": 86400, "day": 86400}


def parse_size(c) -> Column:
    """A decimal number with a unit in either case, as whole bytes; null if it is not one."""
    s = trimmed(c)
    number = F.regexp_extract(s, r"^([0-9.]+)", 1)
    unit = F.lower(trimmed(F.regexp_replace(s, r"^[0-9.]+", "")))
    factors = F.create_map(*[F.lit(x) for u, f in SIZE_UNITS.items() for x in (u, float(f))])
    return F.floor(F.when(number.rlike(r"\A([0-9]+\.?[0-9]*|\.[0-9]+)\z"), number.try_cast("double")) * factors[unit]).cast("long")


def parse_rate(c) -> Column:
    """Bytes per second of a size per period; 0 for '' and '0' (no limit), null if it is not one."""
    s = trimmed(c)
    amount, per = F.regexp_extract(s, r"^([^/]*)/(.*)$", 1), F.lower(trimmed(F.regexp_extract(s, r"^([^/]*)/(.*)$", 2)))
    seconds = F.create_map(*[F.lit(x) for u, n in PERIODS.items() for x in (u, float(n))])
    size = parse_size(amount)
    return F.when(s.isin("", "0"), 0.0).when(s.contains("/") & (size > 0), size.cast("double") / seconds[per])


def even_ratio(n: Column, d: Column, places: int) -> Column:
    """n / d with so many decimal places, ties to even, as text."""
    scale = 10**places
    r = F.pmod(n * scale, d).cast("decimal(38,0)")
    q = ((n * scale - r) / d).cast("long")
    q = q + F.when((2 * r > d) | ((2 * r == d) & (F.pmod(q, F.lit(2)) == 1)), 1).otherwise(0)
    whole = F.floor(q / scale).cast("string")
    return F.concat(whole, F.lit("."), F.lpad(F.pmod(q, F.lit(scale)).cast("string"), places, "0"))


def human_bytes(c, units: str = "KMGTPE") -> Column:
    """1.5 KiB: binary units, one decimal place. What is beyond the last of units is counted in that one."""
    n = col(c).cast("long")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(units, 1):
        out = F.when(n >= 1 << 10 * k, F.concat(even_ratio(n.cast("decimal(38,0)"), F.lit(1 << 10 * k).cast("decimal(38,0)"), 1), F.lit(f" {unit}iB"))).otherwise(out)
    return out


def human_decimal(c, units: str = "KMGTP") -> Column:
    """1.50 KB: decimal units, two places. What is beyond the last of units is counted in that one."""
    n = col(c).cast("long")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(units, 1):
        out = F.when(n >= 10 ** (3 * k), F.concat(even_ratio(n.cast("decimal(38,0)"), F.lit(10 ** (3 * k)).cast("decimal(38,0)"), 2), F.lit(f" {unit}B"))).otherwise(out)
    return out


def short_duration(seconds) -> Column:
    """850ms, 42s, 3m12s, 5h04m, 3d2h; negative durations as 0s."""
    s = F.greatest(col(seconds).cast("double"), F.lit(0.0))
    r = lambda x: F.floor(x + 0.5).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    ms, sec, minute, hour = r(s * 1000), r(s), r(s / 60), r(s / 3600)
    div = lambda a, b: F.floor(a / b).cast("string")
    return (
        F.when((s < 1) & (ms == 0), "0s")
        .when((s < 1) & (ms < 1000), F.concat(ms.cast("string"), F.lit("ms")))
        .when((s < 60) & (sec < 60), F.concat(sec.cast("string"), F.lit("s")))
        .when(s < 60, "1m0s")
        .when(s < 3600, F.concat(div(sec, 60), F.lit("m"), two(F.pmod(sec, F.lit(60))), F.lit("s")))
        .when(s < 48 * 3600, F.concat(div(minute, 60), F.lit("h"), two(F.pmod(minute, F.lit(60))), F.lit("m")))
        .otherwise(F.concat(div(hour, 24), F.lit("d"), F.pmod(hour, F.lit(24)).cast("string"), F.lit("h")))
    )


def seconds_between(later, earlier) -> Column:
    """later - earlier of two timestamps without zone, in seconds."""
    return (F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))) / 1e6


def ago(now, ts) -> Column:
    return F.when(col(ts).isNull(), "never").otherwise(F.concat(short_duration(seconds_between(now, ts)), F.lit(" ago")))


def one_line(c, most: int = 160) -> Column:
    """White space collapsed, cut to most characters with an ellipsis."""
    s = trimmed(F.regexp_replace(col(c), r"\s+", " "))
    return F.when(F.char_length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def window_at(ts, seconds: int) -> Column:
    return F.floor(F.unix_seconds(col(ts).cast("timestamp")) / seconds).cast("long")


def retry_backoff(attempt, cap: float = 300.0) -> tuple[Column, Column]:
    """Least and greatest seconds before a job's next attempt: doubling from 1 s, a tenth of jitter either way, 1 s at least."""
    d = F.when(col(attempt) < 30, F.least(F.pow(F.lit(2.0), col(attempt) - 1), F.lit(cap))).otherwise(cap)
    return F.greatest(F.lit(1.0), d * 0.9), F.greatest(F.lit(1.0), d * 1.1)


def op_retry_delay(attempt, throttled, base: float = 1.0, cap: float = 30.0) -> tuple[Column, Column]:
    """Least and greatest seconds before an operation is retried: doubling, four times as long if throttled."""
    d = F.least(base * F.pow(F.lit(2.0), col(attempt) - 1) * F.when(col(throttled), 4.0).otherwise(1.0), F.lit(cap))
    return d / 2, d


def op_timeout(size, base: int = 60, rate: int = 256 * KIB) -> Column:
    """Seconds: whole ones for the bytes."""
    return base + F.when(col(size) > 0, F.floor(col(size) / rate)).otherwise(0)


def verify_timeout(size, rate: float = 1e6) -> Column:
    return 120 + col(size) / rate


# Failures that a repeat cannot mend.
PERMANENT = ("permission", "auth", "not_found", "version_changed", "canceled")


def is_retryable(failure) -> Column:
    return F.coalesce(~col(failure).isin(*PERMANENT), F.lit(False))


def is_copy_retryable(failure) -> Column:
    return is_retryable(failure) | F.coalesce(col(failure) == "version_changed", F.lit(False))


def part_layout(size, want, least: int = 5 * MIB, most: int = 5 * GIB, parts: int = 10_000) -> Column:
    """struct(part_size, n_parts); null if no permitted part size is large enough."""
    n = col(size)
    part = F.greatest(F.least(F.when(col(want) <= 0, 64 * MIB).otherwise(col(want)), F.lit(most)), F.lit(least))
    need = F.ceil(n / parts).cast("long")
    rounded = F.ceil(need / MIB).cast("long") * MIB
    part = F.when(part >= need, part).when(rounded > most, need).otherwise(rounded).cast("long")
    return F.when(part <= most, F.struct(part.alias("part_size"), F.ceil(n / part).cast("long").alias("n_parts")))


EDGE, WINDOW, WHOLE = 64 * KIB, MIB, 2 * MIB


def sample_ranges(size, key, seed: int = 0) -> Column:
    """array(struct(at, length)): head, tail and one window that key and seed choose; all of a small object."""
    n = col(size).cast("long")
    r = lambda at, length: F.struct(at.cast("long").alias("at"), length.cast("long").alias("length"))
    place = F.pmod(F.xxhash64(col(key), F.lit(seed)), n - WINDOW + 1)
    return (
        F.when(n <= 0, F.array().cast("array<struct<at:bigint,length:bigint>>"))
        .when(n <= WHOLE, F.array(r(F.lit(0), n)))
        .otherwise(F.array(r(F.lit(0), F.lit(EDGE)), r(n - EDGE, F.lit(EDGE)), r(place, F.lit(WINDOW))))
    )


def range_sha256(content, at, length) -> Column:
    return F.sha2(F.substring(col(content), col(at).cast("int") + 1, col(length).cast("int")), 256)


def check_stat(found, version, size, sha, stat_version, stat_size, stat_sha) -> Column:
    """struct(ok, method, failure) of a destination's properties against what was written."""
    hashed = F.coalesce(col(stat_sha) != "", F.lit(False))
    failure = (
        F.when(~col(found), "not_found")
        .when((col(version) != "") & (col(version) != col(stat_version)), "version_changed")
        .when(col(size) != col(stat_size), "size_mismatch")
        .when(hashed & (F.lower(col(stat_sha)) != F.lower(col(sha))), "sha256_mismatch")
    )
    method = F.when(hashed & ~F.coalesce(failure.isin("not_found", "version_changed", "size_mismatch"), F.lit(False)), "size+sha256").otherwise("size")
    return F.struct(failure.isNull().alias("ok"), method.alias("method"), F.coalesce(failure, F.lit("")).alias("failure"))


def lower_keys(m) -> Column:
    """Map keys in lower case; of keys that become the same the one last in order of the original keys stays."""
    entries = F.array_sort(F.map_entries(col(m)))
    return F.map_from_entries(
        F.filter(
            F.transform(entries, lambda e, i: F.struct(F.lower(e["key"]).alias("key"),
                F.when(F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: F.lower(x["key"]) == F.lower(e["key"])), None).otherwise(F.struct(e["value"].alias("v"))).alias("value"))),
            lambda e: e["value"].isNotNull(),
        )
    )


def has_env_ref(spec) -> Column:
    return col(spec).contains("${")


def skew_class(seconds) -> Column:
    s = F.abs(F.floor(F.abs(col(seconds)) + 0.5))
    return F.when(s >= 900, "fail").when(s > 60, "warn").otherwise("ok")


def sync_lag(synced_at, event_time) -> Column:
    return seconds_between(synced_at, event_time)


def pct(a, b) -> Column:
    return F.when(col(b) == 0, 100.0).otherwise(100.0 * col(a) / col(b))
