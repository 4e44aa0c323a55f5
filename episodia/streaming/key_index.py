"""Appends to a large output that look only where a key may already be.

An output is a folder of batches.  A batch is data by bucket of the key's hash, a Bloom
filter for each bucket, and a mark that is written last: without it a batch is not there, so
an append that was cut off leaves nothing visible and may simply run again.

An append asks the filters first.  Rows that no filter knows are new; the others are
compared exactly with the buckets of those batches that let them through, and no other
part of the output is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodia.session import written
from episodia.sources.tables import path_exists

BITS_PER_KEY, PROBES = 10, 5
INDEX = "batch string, bucket int, filter binary"


def _hash(keys: Sequence[str]):
    return F.xxhash64(*keys)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """``PROBES`` bit numbers for each hash, from its two halves."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return (low[:, None] + np.arange(PROBES, dtype=np.uint64) * high[:, None]) % np.uint64(bits)


def filter_of(hashes: np.ndarray) -> bytes:
    bits = max(64, -(-len(np.unique(hashes)) * BITS_PER_KEY // 8) * 8)
    out = np.zeros(bits, np.uint8)
    out[_places(hashes, bits).ravel().astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def may_hold(data: bytes, hashes: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    at = _places(hashes, len(raw) * 8).astype(np.int64)
    return ((raw[at >> 3] >> (7 - (at & 7))) & 1).all(1)


def visible(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished batches."""
    if not path_exists(spark, f"{path}/marks"):
        return []
    return sorted(r["batch"] for r in spark.read.schema("batch string").json(f"{path}/marks").collect())


def read_indexed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all finished batches."""
    names = visible(spark, path)
    if not names:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", f"{path}/data").schema(schema).parquet(*[f"{path}/data/batch={n}" for n in names])
    return rows.drop("batch", "bucket")


def suspected(df: DataFrame, filters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs ``bucket, batch, hash`` of rows that a batch's filter lets through, each hash once."""
    asked = df.select("_bucket", "_hash").distinct()

    def ask(rows: pa.Table, known: pa.Table) -> pa.Table:
        hashes = rows.column("_hash").to_numpy()
        out = [(name, hashes[may_hold(data, hashes)]) for name, data in zip(known.column("batch").to_pylist(), known.column("filter").to_pylist())] if len(hashes) else []
        bucket = rows.column("_bucket")[0].as_py() if len(hashes) else 0
        found = np.concatenate([h for _, h in out] or [np.zeros(0, np.int64)])
        return pa.table([pa.array([bucket] * len(found), pa.int32()), pa.array([n for n, h in out for _ in h], pa.string()), pa.array(found, pa.int64())], ["bucket", "batch", "hash"])

    return asked.groupBy("_bucket").cogroup(filters.groupBy("bucket")).applyInArrow(ask, "bucket int, batch string, hash long")


def split_known(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The rows of ``df`` (with ``_hash`` and ``_bucket``) whose key no finished batch holds."""
    spark = df.sparkSession
    names = visible(spark, path)
    if not names:
        return df
    filters = spark.read.schema(INDEX).parquet(*[f"{path}/index/{n}" for n in names])
    doubts = written(suspected(df, filters, keys), "doubts")
    parts = doubts.select("batch", "bucket").distinct().collect()  # at most batches x buckets
    if not parts:
        return df
    folders = [f"{path}/data/batch={r['batch']}/bucket={r['bucket']}" for r in parts]
    schema = df.select(*keys).schema
    held = spark.read.option("basePath", f"{path}/data").schema(schema).parquet(*folders).select(*keys).distinct()
    doubtful = doubts.select(F.col("hash").alias("_doubt")).distinct()
    marked = df.join(doubtful, F.col("_hash") == F.col("_doubt"), "left")
    sure = marked.filter(F.col("_doubt").isNull()).drop("_doubt")
    left = held.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return sure.unionByName(marked.filter(F.col("_doubt").isNotNull()).drop("_doubt").join(left, same, "left_anti"))


def append_indexed(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> str | None:
    """Append the rows of ``df`` whose key the output lacks; returns the batch's name, None if nothing was new.

    The number of buckets belongs to the output and must stay the same.  Null keys are keys.
    Several rows of one key in ``df`` are all appended.
    """
    spark = df.sparkSession
    rows = df.withColumn("_hash", _hash(keys)).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))
    fresh = written(split_known(rows, path, keys, buckets), "fresh")
    if fresh.isEmpty():
        return None
    batch = uuid.uuid4().hex
    # rows of a bucket are spread by hash, so a large key is not one writer's work
    spread = fresh.withColumn("bucket", F.col("_bucket")).repartition("bucket", F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    spread.drop("_hash", "_bucket").write.partitionBy("bucket").parquet(f"{path}/data/batch={batch}")

    def build(table: pa.Table) -> pa.Table:
        return pa.table([pa.array([batch]), pa.array([table.column("_bucket")[0].as_py()], pa.int32()), pa.array([filter_of(table.column("_hash").to_numpy())], pa.binary())],
                        ["batch", "bucket", "filter"])

    fresh.select("_bucket", "_hash").distinct().groupBy("_bucket").applyInArrow(build, INDEX).write.parquet(f"{path}/index/{batch}")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").json(f"{path}/marks")
    return batch
