"""Snapshots laid out for their readers: in buckets of the key for joins and merges, in ranges of the key for pages.

Buckets: a snapshot is a table bucketed and sorted by (pipeline_id, key), so that two with the same number of buckets join
without moving a row. A merge reads and rewrites the buckets that its rows fall into, as a new generation, and then publishes
which file holds each bucket; readers go by the newest list, so a merge that dies halfway changes nothing, and the files of
other buckets keep their names. Pages: files follow each other in the order of the key, and a small table says what each
begins and ends with, so that a page anywhere reads the files that it meets.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import merge_records

KEYS = ("pipeline_id", "key")
LIST = "bucket int, generation int, file string"


def bucket_of(n: int) -> Column:
    """The bucket that Spark puts a key into."""
    return F.pmod(F.hash(*KEYS), F.lit(n)).cast("int")


def table(spark: SparkSession, path: str, rows: DataFrame | None = None, n: int = 0) -> str:
    """The name by which this session knows the bucketed table below path, made known first if need be."""
    name = "tidemark_" + hashlib.md5(path.encode()).hexdigest()[:20]
    if not spark.catalog.tableExists(name):
        fields = rows.schema if rows is not None else spark.read.parquet(f"{path}/rows").drop("generation").schema
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(f"CREATE TABLE {name} ({ddl}, generation INT) USING parquet PARTITIONED BY (generation) CLUSTERED BY ({', '.join(KEYS)}) SORTED BY ({', '.join(KEYS)}) INTO {n or len(published(spark, path))} BUCKETS LOCATION '{path}/rows'")
    if rows is None:
        spark.catalog.recoverPartitions(name)
    return name


def published(spark: SparkSession, path: str) -> list[tuple[int, str | None]]:
    """Each bucket's generation and file, None if it is empty, by the newest list: a row per bucket."""
    lists = spark.read.schema(f"{LIST}, number int").parquet(f"{path}/published")
    newest = lists.agg(F.max("number")).first()[0]
    return [(r["generation"], r["file"]) for r in lists.where(F.col("number") == newest).orderBy("bucket").collect()]


def publish(spark: SparkSession, path: str, number: int, buckets: list[tuple[int, str | None]]) -> None:
    rows = spark.createDataFrame([(b, g, f) for b, (g, f) in enumerate(buckets)], LIST)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/published/number={number}")


def write_generation(spark: SparkSession, path: str, name: str, rows: DataFrame, n: int, generation: int) -> dict[int, str]:
    """Write rows, all of a bucket by one task, and say which file has which bucket."""
    spread = rows.repartition(n, *KEYS).withColumn("generation", F.lit(generation))
    spread.write.insertInto(name)
    folder = f"{path}/rows/generation={generation}"
    files = spark.read.schema(rows.schema).parquet(folder).inputFiles() if not spread.isEmpty() else []
    return {int(re.search(r"_(\d+)\.c\d+[^/]*$", f)[1]): f for f in files}


def write_buckets(rows: DataFrame, path: str, n: int) -> None:
    """A first snapshot of rows(pipeline_id, key, ..), each key once, in n buckets below path."""
    spark = rows.sparkSession
    name = table(spark, path, rows, n)
    files = write_generation(spark, path, name, rows, n, 0)
    publish(spark, path, 0, [(0, files.get(b)) for b in range(n)])


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot, as a bucketed scan."""
    now, name = published(spark, path), table(spark, path)
    latest = F.array(*[F.lit(g) for g, _ in now])[bucket_of(len(now))]
    generations = sorted({g for g, _ in now})
    rows = spark.table(name).where(F.col("generation").isin(generations))
    return (rows.where(F.col("generation") == latest) if len(generations) > 1 else rows).drop("generation")


def merge_buckets(new: DataFrame, path: str) -> set[int]:
    """Put the rows of new in place of those of the same keys, in the buckets that they fall into; says which these are."""
    spark = new.sparkSession
    now, name = published(spark, path), table(spark, path)
    n = len(now)
    touched = {r["b"] for r in new.select(bucket_of(n).alias("b")).distinct().collect()}  # n at most
    if not touched:
        return touched
    files = [f for b, (_, f) in enumerate(now) if b in touched and f]
    schema = spark.table(name).drop("generation").schema
    old = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    written = [int(r[0].split("=")[1]) for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]  # by merges that died, too
    generation = max([g for g, _ in now] + written) + 1
    merged = merge_records(old, new.select(*[f.name for f in schema]))
    fresh = write_generation(spark, path, name, merged.select(*[f.name for f in schema]), n, generation)
    publish(spark, path, generation, [(generation, fresh.get(b)) if b in touched else old for b, old in enumerate(now)])
    return touched


def remove_superseded(spark: SparkSession, path: str) -> int:
    """Delete files that the newest list does not name. Readers of older lists must have ended."""
    kept = {f for _, f in published(spark, path) if f}
    gone = [f for f in spark.read.parquet(f"{path}/rows").inputFiles() if f not in kept]
    for f in gone:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, False)
    spark.catalog.refreshTable(table(spark, path))
    return len(gone)


def write_pages(rows: DataFrame, path: str, files: int) -> None:
    """rows(key, ..) in about so many files, in order of the key, and what each of them holds."""
    rows.repartitionByRange(files, "key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/rows")
    there = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    held = there.groupBy(F.input_file_name().alias("file")).agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n"))
    held.coalesce(1).write.mode("overwrite").parquet(f"{path}/held")


def read_page(spark: SparkSession, path: str, after: str, n: int, prefix: str = "") -> DataFrame:
    """The n rows after a key, below a prefix, in order of the key, from the files that hold them."""
    meets = (F.col("last") > after) & ((F.col("last") >= prefix) & ((F.col("first") < prefix) | F.col("first").startswith(prefix)) if prefix else F.lit(True))
    held = spark.read.parquet(f"{path}/held").where(meets).orderBy("first").limit(n + 2).collect()
    schema = spark.read.parquet(f"{path}/rows").schema
    take, seen = 0, 0
    # Files but the first and those at the prefix's bounds hold rows of the page only: n rows are in the first few.
    while take < len(held) and seen < n:
        full = take > 0 and (not prefix or held[take]["first"].startswith(prefix) and held[take]["last"].startswith(prefix))
        seen += held[take]["n"] if full else 0
        take += 1
    rows = spark.read.schema(schema).parquet(*[h["file"] for h in held[:take]]) if take else spark.createDataFrame([], schema)
    return rows.where((F.col("key") > after) & F.col("key").startswith(prefix)).orderBy("key").limit(n)
