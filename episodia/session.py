"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # time arithmetic in this package assumes UTC
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join on an episode key followed by a grouping on (episode, bin) would
    # otherwise keep the join's layout, and a very large episode would stay in
    # one task.  Splitting it is worth the extra exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def local_session(name: str = "episodia", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepared(spark: SparkSession) -> SparkSession:
    """Apply the settings this package relies on to a session of any origin."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a session inside one process (master ``local``) may go without; it
    gets a folder of its own.  Anywhere else a missing setting is an error,
    because a folder of one machine is not visible to the others.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="episodia-shared-")
        context.setCheckpointDir(named)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_folder(spark: SparkSession, label: str = "table") -> str:
    """A name for a new folder below the shared one."""
    return f"{shared_folder(spark)}/episodia-{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Unlike a checkpoint the table is compressed and read column by column.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
