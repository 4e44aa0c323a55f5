"""Reading and writing tables, extracts and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodia.functions.scalars import number_or_null
from episodia.operators.quality import require_columns
from episodia.session import durable, fresh_folder, prepared, written


# --- databases ------------------------------------------------------------------

def jdbc_reader(spark: SparkSession, url: str, query: str, properties: Mapping[str, str] | None = None,
                key: str | None = None, low: int | None = None, high: int | None = None,
                step: int | None = None):
    """Reader for a query over JDBC, split by key range if a key is given.

    Ranges of ``step`` keys between ``low`` and ``high`` become partitions that
    executors read in parallel.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q")
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if key is not None:
        parts = max(1, -(-(high - low) // step))
        for k, v in {"partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": parts}.items():
            reader = reader.option(k, v)
    return reader


def run_query(spark: SparkSession, sql: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """SQL text over catalog tables and the given DataFrames."""
    return spark.sql(sql, **(views or {}))


def key_ranges(low: int, high: int, step: int) -> list[tuple[int, int]]:
    return [(a, min(a + step, high)) for a in range(low, high, step)]


def write_key_ranges(df: DataFrame, key: str, step: int, folder: str) -> list[tuple[int, int]]:
    """Write ``df`` in folders of ``step`` keys each, in one pass; returns the ranges.

    A range can be read, or written again, on its own.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        df.withColumn("key_range", F.lit(0)).write.mode("overwrite").parquet(folder)
        return []
    number = F.floor((F.col(key) - F.lit(low)) / F.lit(step)).cast("long")
    df.withColumn("key_range", number).write.mode("overwrite").partitionBy("key_range").parquet(folder)
    return key_ranges(low, high + 1, step)


def shared_view(df: DataFrame, name: str) -> DataFrame:
    """Register an intermediate that several queries read, computed once.

    It is a checkpoint, which Spark removes when nothing refers to it any more;
    drop the view to let it go.
    """
    durable(df).createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def table_or(spark: SparkSession, name: str, fallback: Callable[[], DataFrame]) -> DataFrame:
    """The named table if the catalog has it, else the fallback."""
    return spark.table(name) if spark.catalog.tableExists(name) else fallback()


# --- files ------------------------------------------------------------------------

def path_exists(spark: SparkSession, path: str) -> bool:
    """Works on any file system Spark can read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def read_csv(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV with a declared schema, from the first path that exists."""
    return spark.read.schema(schema).option("header", True).csv(first_existing(spark, paths))


def read_parts(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> DataFrame:
    """All part files whose name matches the pattern, as one table."""
    return spark.read.schema(schema).option("header", True).option("pathGlobFilter", pattern).csv(folder)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the listed columns; Parquet skips the others on disk."""
    return spark.read.parquet(path).select(*columns)


def read_dated_csv(spark: SparkSession, path: str, dates: Sequence[str], needed: Sequence[str]) -> DataFrame:
    """CSV with parsed date columns and a check of the required columns."""
    raw = require_columns(spark.read.option("header", True).csv(path), needed)
    return raw.withColumns({c: F.try_to_timestamp(c) for c in dates})


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """Fixed column order; doubles in shortest form."""
    df.select(*columns).write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet, partitioned so that a split filter prunes folders."""
    if by:
        # one writer per partition value and hash slice keeps files large without
        # sending a whole split to one task
        slices = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4, 1)
        df = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(slices))).repartition(*by, "_slice").drop("_slice")
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def co_located(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` that joins on more columns where both sides are dealt by one of them.

    Tables bucketed by an episode then meet on (episode, step) and keep the layout
    for windows over the episode.  It shares tables and cluster with ``spark``.
    """
    session = prepared(spark.newSession())
    for name in ("spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
        if spark.conf.get(name, None) is not None and session.conf.isModifiable(name):
            session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return session


def bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), buckets: int | None = None, label: str = "bucketed") -> DataFrame:
    """``df`` as a table of one sorted file for each bucket of ``keys``, in the shared folder.

    A key that holds more than four buckets' fair share would sit in one task of
    every later step; such a table is written without buckets, and later steps shuffle.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat = written(df, label)
    largest, total = flat.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if largest is not None and n > 4 and largest * n > 4 * total:
        return flat
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    dealt = flat.repartition(n, *keys)
    dealt.write.bucketBy(n, *keys).sortBy(*keys, *order).option("path", fresh_folder(spark, label)).saveAsTable(name)
    return spark.table(name)


def write_json_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report table as JSON lines."""
    df.write.mode(mode).json(path)


def as_json(df: DataFrame, name: str = "report") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def read_effects(spark: SparkSession, path: str) -> DataFrame:
    """Effect table (treatment, outcome, effect) from JSON lines."""
    return spark.read.schema("treatment string, outcome string, effect double").json(path)


def effect_lookup(effects: DataFrame, most: int = 10_000) -> dict[tuple[str, str], float]:
    """Effects as a dictionary; a table of more than ``most`` rows is refused."""
    rows = effects.select("treatment", "outcome", "effect").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} effects; a table of studied pairs is expected")
    return {(r.treatment, r.outcome): r.effect for r in rows}


# --- configuration and plans --------------------------------------------------------

def read_config(path: str, spark: SparkSession | None = None) -> dict:
    """Parameters from JSON, or from YAML where a parser is installed.

    With a session the file is read by Spark, from any file system it knows.
    Values of keys ending in ``_path`` or ``_dir`` are resolved against the
    folder of the file.
    """
    if spark is None:
        where = Path(path).resolve()
        text = where.read_text()
    else:
        where = PurePosixPath(path)
        text = spark.read.text(path, wholetext=True).first()[0]
    if where.suffix in (".yml", ".yaml"):
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("reading YAML needs the yaml package; use JSON") from missing
        values = yaml.safe_load(text)
    else:
        values = json.loads(text)

    def resolved(node, key=""):
        if isinstance(node, dict):
            return {k: resolved(v, k) for k, v in node.items()}
        if isinstance(node, str) and key.endswith(("_path", "_dir")) and "://" not in node:
            return f"{path.rpartition('/')[0]}/{node}" if spark is not None else str(where.parent / node)
        return node

    return resolved(values)


def run_extracts(plan: Mapping[str, Callable[[], DataFrame]], folder: str, only: Sequence[str] | None = None,
                 skip_existing: bool = False, limit: int | None = None) -> list[str]:
    """Write the named extracts in order; returns the names written.

    ``limit`` keeps that many rows of each extract for a smoke run.
    """
    done = []
    for name, build in plan.items():
        if only is not None and name not in only:
            continue
        df = build()
        if limit is not None:
            df = df.limit(limit)
        target = f"{folder}/{name}"
        if skip_existing and path_exists(df.sparkSession, target):
            continue
        df.write.mode("ignore" if skip_existing else "overwrite").parquet(target)
        done.append(name)
    return done


def typed(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """Text columns to numbers; what does not parse becomes null."""
    return df.withColumns({c: number_or_null(c) for c in numbers})
