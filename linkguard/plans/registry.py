"""Registry of the checked queries: name -> Spark function and DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from linkguard.plans.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Plain column types for the comparison: bigint, double, boolean, text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, oracle: str | None = None):
    """Register a query. ``oracle`` is DuckDB SQL over the base tables and the shared views."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: tidy(fn(Tables(spark, folder)))
        if oracle is not None:
            from linkguard.plans.oracle_ctes import CTES
            ORACLES[name] = with_views(oracle, "duck", CTES)
        return fn
    return wrap


def fmt(ts: str) -> str:
    """DuckDB text of a timestamp in the form the Spark side reports."""
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"
