"""Incremental loads: append only the keys an output does not hold yet."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from episodia.sources.tables import path_exists


def new_rows(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the existing output lacks."""
    return df.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows with new keys to a Parquet table.

    Running it again with the same input adds nothing, so a job that was cut
    off can simply be started again.
    """
    spark: SparkSession = df.sparkSession
    if path_exists(spark, path):
        df = new_rows(df, spark.read.schema(df.schema).parquet(path), keys)
    df.write.mode("append").parquet(path)


def resume_stream(source: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, row_key: Sequence[str],
                  checkpoint: str):
    """Run ``build`` over newly arrived files and append the rows not there yet.

    ``row_key`` must identify a row (an episode and its step, not the episode
    alone): a later file may bring more rows of an episode already there.
    ``source`` is a streaming DataFrame.  The query stops when all available
    files are read; the checkpoint remembers them for the next run, and the key
    check makes a repeated batch harmless.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        append_new(build(batch), path, row_key)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
