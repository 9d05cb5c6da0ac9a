"""Readers of the files that the operators start from: schemas are fixed and bad input is named, not skipped."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import schemas
from tidemark.functions.text import col, folder_marker, trimmed
from tidemark.shared import cut
from tidemark.sources import store


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """value, file_index (place in paths), line_no (from 0 in its file, blank lines included).

    Files are read in splits of any number. A split's rows are numbered where they are read; the lines before it are the
    sum over its file's earlier splits, of which there are few. The numbered rows are written once, since the numbers of
    a split must be those of one reading. There is a row of starts for each split, which are broadcast: else all lines
    would be shuffled to meet them.
    """
    parts = None
    for k, path in enumerate(paths):
        at = [F.lit(k).alias("file_index"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
        one = spark.read.text(path).select("value", *at, F.monotonically_increasing_id().alias("id"))
        parts = one if parts is None else parts.unionByName(one)
    split = ["file_index", "file", "block"]
    rows = cut(parts, "lines", compression="zstd")
    before = Window.partitionBy("file_index", "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*split).agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.join(F.broadcast(starts.drop("n")), split).select("value", "file_index", (F.col("ahead") + F.col("id") - F.col("first")).alias("line_no"))


def manifest_rows(text: DataFrame) -> DataFrame:
    """key, size, sha256, written_at, file_index, line_no, problem ('' if none) of JSON lines; blank lines are no rows."""
    s = F.from_json("value", schemas.MANIFEST + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    m = F.col("m")
    written = F.try_to_timestamp(m["written_at"]).cast("timestamp_ntz")  # with or without a zone, in UTC
    problem = (
        F.when(m["_bad"].isNotNull(), "not JSON")
        .when(F.coalesce(m["key"], F.lit("")) == "", "no key")
        .when(F.coalesce(m["size"], F.lit(-1)) < 0, "negative size")
        .when(F.coalesce(F.length(m["sha256"]), F.lit(0)) != 64, "sha256 not 64 characters")
        .when(m["written_at"].isNotNull() & written.isNull(), "bad time")
        .otherwise("")
    )
    return text.where(trimmed("value") != "").withColumn("m", s).select(m["key"].alias("key"), m["size"].alias("size"), m["sha256"].alias("sha256"),
        written.alias("written_at"), "file_index", "line_no", problem.alias("problem"))


def strict(rows: DataFrame) -> DataFrame:
    """rows without the problem column; a row with a problem fails the job."""
    named = F.concat_ws(" ", F.lit("line"), F.col("line_no"), F.lit("of file"), F.col("file_index"), F.lit(":"), F.col("problem"))
    return rows.where(F.when(F.col("problem") == "", True).otherwise(F.raise_error(named).cast("boolean"))).drop("problem")


def manifest_scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    return strict(manifest_rows(lines(spark, paths)))


def inventory_scan(spark: SparkSession, path: str) -> DataFrame:
    """key, size, mod_time of every object that a store's inventory (CSV files with a header) names, folder markers left out."""
    rows = spark.read.schema("key string, size bigint, mod_time timestamp_ntz").option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    return rows.where(~folder_marker("key"))


def write_inventory(listing: DataFrame, path: str) -> None:
    listing.select("key", "size", "mod_time").write.option("header", True).option("escape", '"').csv(path)


def listing_by(prefixes: DataFrame, lister: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """prefixes(prefix): key, size, version, mod_time of what a store of any kind lists below each, folder markers left out.

    lister(prefix) yields rows of these four page by page and runs in tasks; prefixes that do not overlap are listed in
    parallel, and a task holds a batch of rows at a time.
    """
    schema = "key string, size bigint, version string, mod_time timestamp_ntz"
    kinds = [pa.string(), pa.int64(), pa.string(), pa.timestamp("us")]

    def run(batches):
        for batch in batches:
            for prefix in batch["prefix"].to_pylist():
                rows = iter(lister(prefix))
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], ["key", "size", "version", "mod_time"])

    return prefixes.select("prefix").mapInArrow(run, schema).where(~folder_marker("key"))


MESSAGE = "message_id bigint, delivery_count bigint, message string"


def message_scan(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Queue messages from files of JSON lines, as a batch or, with new files as they come, a stream."""
    return (spark.readStream if stream else spark.read).schema(MESSAGE).json(path)


def webhook_scan(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Request bodies, one a line, as messages that were delivered once; a body's SHA-256 is its message_id."""
    raw = (spark.readStream if stream else spark.read).text(path).where(trimmed("value") != "")
    return raw.select(F.sha2("value", 256).alias("message_id"), F.lit(1).cast("bigint").alias("delivery_count"), F.col("value").alias("message"))


def listing_scan(spark: SparkSession, root: str) -> DataFrame:
    """key, size, mod_time of every object below root, which must be there; contents are not read.

    Tasks list key ranges through the store data source where root names a file system that pyarrow opens, too."""
    if where := store.located(root):
        if not store.Folders({"path": where}).there():
            raise FileNotFoundError(root)
        store.register(spark)
        found = spark.read.format(store.NAME).load(where).select("key", "size", "mod_time")
    else:
        found = driver_listing(spark, root)
    return found.where(~folder_marker("key"))


def driver_listing(spark: SparkSession, root: str) -> DataFrame:
    """The same over any file system that Spark reads, without names that begin with a dot or an underscore.

    Spark lists the files on the driver and reads few of them in a task: for roots of some thousands. Take inventory_scan beyond."""
    bare = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")  # noqa: E731  without scheme and authority
    key = F.substr(bare(F.col("path")), F.length(bare(F.lit(root.rstrip("/") + "/"))) + 1)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(key.alias("key"), F.col("length").alias("size"),
        F.col("modificationTime").cast("timestamp_ntz").alias("mod_time"))


LABEL = r'\s*([^=,{}\s]+)\s*=\s*"((?:[^"\\]|\\.)*)"'


def unescape(value: Column) -> Column:
    """Backslash escapes: n is a new line, any other character itself."""
    mark = F.lit("\x00")
    hidden = F.replace(value, F.lit("\\\\"), mark)
    return F.replace(F.regexp_replace(F.replace(hidden, F.lit("\\n"), F.lit("\n")), r"\\(.)", "$1"), mark, F.lit("\\"))


def parse_number(text) -> Column:
    t = col(text)
    return F.when(t.isin("+Inf", "Inf"), float("inf")).when(t == "-Inf", float("-inf")).when(t == "NaN", float("nan")).otherwise(t.try_cast("double"))


def metric_samples(text: DataFrame) -> DataFrame:
    """text(line, ...) in the text format of scrapes to name, labels, value and the other columns; comments are no rows."""
    line = trimmed("line")
    shape = r'^([^{\s]+)(?:\{((?:[^"}]|"(?:[^"\\]|\\.)*")*)\})?\s*(\S+)'
    labels = F.regexp_extract(line, shape, 2)
    names = F.regexp_extract_all(labels, F.lit(LABEL), F.lit(1))
    values = F.transform(F.regexp_extract_all(labels, F.lit(LABEL), F.lit(2)), unescape)
    rest = [c for c in text.columns if c != "line"]
    return text.where((line != "") & ~line.startswith("#")).select(*rest, F.regexp_extract(line, shape, 1).alias("name"),
        F.map_from_arrays(names, values).alias("labels"), parse_number(F.regexp_extract(line, shape, 3)).alias("value"))


def record_scan(records: DataFrame, pipeline: str, after: str = "") -> DataFrame:
    """A pipeline's records after a key, in byte order of keys; both conditions reach a Parquet scan."""
    return records.where((F.col("pipeline_id") == pipeline) & (F.col("key") > after)).orderBy("key")


def spec_scan(specs: DataFrame, shape: str) -> DataFrame:
    """Specs by name with their JSON parsed to shape."""
    return specs.withColumn("parsed", F.from_json("spec", shape)).orderBy("name")


def soak_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SOAK_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)


def changes(raw: DataFrame, parse: Callable[[DataFrame], DataFrame], origin: str = "event") -> DataFrame:
    """Changes in a format of one's own: parse makes of raw rows what it can of the columns of a change.

    Columns come out in their order and types, those that parse does not give as '' or null, those that are no column
    of a change not at all; a format that gives no pipeline, kind or key is refused.
    """
    given = parse(raw)
    lacking = [c for c in ("pipeline_id", "kind", "key") if c not in given.columns]
    if lacking:
        raise ValueError(f"the format gives no {', '.join(lacking)}")
    out = []
    for field in StructType.fromDDL(schemas.CHANGES).fields:
        default = F.lit(origin) if field.name == "origin" else F.lit("" if field.dataType.typeName() == "string" else None)
        out.append((F.col(field.name) if field.name in given.columns else default).cast(field.dataType).alias(field.name))
    return given.select(*out)
