"""The folder that all executors share, and cutting lineage through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in local mode only, a temporary folder where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.scratch", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("tidemark.scratch", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
