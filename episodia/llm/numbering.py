"""Positions of sorted rows within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodia.session import written


def numbered(rows: DataFrame, group: str, order: list[str], label: str = "numbered") -> DataFrame:
    """``rows`` with ``place``, the 0-based position by ``order`` within ``group``, as a table.

    ``group`` is text without nulls.  Rows are range-partitioned by group and order
    with a random last key, so a group of any size and rows that are all equal
    spread over tasks.  A task counts its rows as they pass; only the groups that a
    partition starts and ends with go to the driver, one row for each partition.
    """
    spark = rows.sparkSession
    keys = [F.col(group), *[F.col(c).asc_nulls_first() for c in order], F.col("_salt")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_salt", F.rand(11)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_salt")
    dealt = dealt.withColumn("_part", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run, k = None, -1, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = batch.column(group)
            starts = np.ones(n, bool)
            starts[0] = col[0].as_py() != last
            starts[1:] = np.asarray(pc.not_equal(col.slice(1), col.slice(0, n - 1)))
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(starts, at, -1))
            place = np.where(begin < 0, at + k, at - begin)
            runs = run + np.cumsum(starts)
            last, run, k = col[n - 1].as_py(), int(runs[-1]), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs), pa.array(place)], [*batch.schema.names, "_run", "_k"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    table = written(dealt.mapInArrow(count, f"{schema}, _run long, _k long"), label)
    name = F.md5(F.col(group))
    ends = table.groupBy("_part").agg(F.max(F.struct("_run", "_k")).alias("last"), F.min_by(name, "_run").alias("first_name"),
                                      F.max_by(name, "_run").alias("last_name")).orderBy("_part").collect()
    carry, held, before = [], None, 0
    for row in ends:
        before = before if row["first_name"] == held else 0
        carry.append((row["_part"], before))
        before = row["last"]["_k"] + 1 + (before if row["last"]["_run"] == 0 else 0)
        held = row["last_name"]
    carried = F.broadcast(spark.createDataFrame(carry, "_part int, _carry long"))  # one row a partition
    place = F.col("_k") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(0)
    return table.join(carried, "_part").select(*rows.columns, place.alias("place"))
