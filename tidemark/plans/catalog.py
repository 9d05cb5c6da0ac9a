"""Queries by name: a function of the inputs, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.fixtures import NOW, Inputs, with_inputs

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(inputs: str = "", sql: str | None = None):
    """Register a function under its name; sql may use the named inputs beside the given tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_inputs(inputs, sql) if inputs else sql
        return f

    return add


def now():
    return F.expr(NOW)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Inputs(spark, sf_dir))) for name, f in QUERIES.items()}
