"""Registry of queries on the star-schema tables and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodia.session import prepared


@dataclass
class Query:
    name: str
    covers: list[str]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


class Tables:
    """Lazily read tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepared(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Stable output types: integers as long, fractions as rounded doubles."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # the shift decides ties; adding zero turns a negative zero into zero
            c = F.round(c.cast("double") + F.lit(float(f"1e-{digits + 3}")), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            c = c.cast("long") if not isinstance(f.dataType, T.BooleanType) else c.cast("int").cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, covers: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(fn(Tables(spark, folder)), digits)

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, covers.split(), run, sql)
        fn.query_name = name
        return fn

    return wrap
