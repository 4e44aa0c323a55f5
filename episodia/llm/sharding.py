"""Shards of near-equal size from sampled splitters (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodia.llm.splitters import range_of, sampled_splitters
from episodia.session import written

LOWEST = -(1 << 63)


def shard(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    ranges_per_shard: int = 16,
    whole_share: int = 32,
) -> DataFrame:
    """Deal records into ``shards`` runs of near-equal bytes along a key order.

    The key is the hash of the text, then that of the id, so equal texts lie
    side by side.  A size-weighted sample gives quantile boundaries; records are
    range-partitioned by them, each range is summed, and within a range running
    sums place every record at its exact byte offset: record or group ``x`` goes
    to shard ``floor(middle of x * shards / total)``.  A group of equal texts
    stays whole up to a ``1/whole_share`` part of a shard; a larger one is
    overfull and is subdivided between its records, so that a hot text neither
    fills a shard nor a task.

    Returns ``id_col``, ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``law``
    ("bytes"), ``shard``, ``slot`` (place in the shard, gapless from 0),
    ``grown_shard`` (null) and the columns in ``carry``.  Null text: size 8 and a
    null checksum.  Repeated rows each get a slot.  No rows in, no rows out;
    other input columns are ignored.
    """
    bytes_of = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8
    rows = written(docs.select(
        F.col(id_col),
        *[F.col(c) for c in carry],
        bytes_of.alias("_size"),
        F.crc32(F.col(text_col).cast("binary")).alias("_crc"),
        F.xxhash64(F.col(text_col)).alias("_h"),
        F.xxhash64(F.col(id_col)).alias("_d"),
        F.monotonically_increasing_id().alias("_u"),  # frozen by the write
    ), "sizes")
    total = rows.agg(F.sum("_size")).first()[0] or 0
    ranges = shards * ranges_per_shard
    # at most shards * whole_share groups can be that large
    limit = total / (shards * whole_share)
    large = [r["_h"] for r in rows.groupBy("_h").agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n")).filter((F.col("b") > limit) & (F.col("n") > 1)).select("_h").collect()]
    overfull = F.col("_h").isin(large) if large else F.lit(False)
    rows = rows.withColumns({"_big": overfull, "_kd": F.when(overfull, F.col("_d")).otherwise(F.lit(LOWEST)), "_ku": F.when(overfull, F.col("_u")).otherwise(F.lit(LOWEST))})
    keys = ["_h", "_kd", "_ku"]
    cuts = sampled_splitters(rows.select(*keys, "_size"), keys, "_size", total, ranges)
    rows = rows.withColumn("_r", range_of([F.col(k) for k in keys], cuts, ["long"] * 3))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = rows.groupBy("_r").agg(F.sum("_size").alias("_b"), F.count(F.lit(1)).alias("_n")).select(
        "_r", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("_r").orderBy("_h", "_d", "_u")
    group = Window.partitionBy("_r", "_h")
    placed = (
        rows.withColumns({"_end": F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_k": F.row_number().over(inside)})
        .withColumns({"_g0": F.min(F.col("_end") - F.col("_size")).over(group), "_g": F.sum("_size").over(group)})
        .join(F.broadcast(offsets), "_r")  # at most `ranges` rows
        .withColumns({
            "_mid": F.col("_b0") + F.when(F.col("_big"), F.col("_end") - F.col("_size") / 2).otherwise(F.col("_g0") + F.col("_g") / 2),
            "_place": F.col("_n0") + F.col("_k") - 1,
        })
        .withColumn("shard", F.least(F.floor(F.col("_mid") * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int"))
    )
    placed = written(placed.select(id_col, *carry, "_size", "_crc", "shard", "_place"), "placed")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    first = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")).select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        id_col, F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("_place") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carry,
    )


def op7_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
