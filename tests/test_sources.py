"""Sources, sinks, configuration, incremental loads and physical plans."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodia.operators import intervals as I
from episodia.operators import sampling as P
from episodia.session import durable, prepared
from episodia.sources import tables as IO
from episodia.streaming import resume


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_config_paths_are_resolved(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"output": {"data_dir": "out", "url_path": "s3://b/x"}, "n": 3}))
    got = IO.read_config(str(tmp_path / "c.json"))
    assert got == {"output": {"data_dir": str(tmp_path / "out"), "url_path": "s3://b/x"}, "n": 3}


def test_config_is_read_by_spark(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"data_dir": "out"}))
    assert IO.read_config(f"file://{tmp_path}/c.json", spark) == {"data_dir": f"file://{tmp_path}/out"}


def test_key_ranges_are_written_in_one_pass(spark, tmp_path):
    folder = f"file://{tmp_path}/r"
    assert IO.write_key_ranges(spark.range(3, 28), "id", 10, folder) == [(3, 13), (13, 23), (23, 28)]
    back = spark.read.parquet(folder)
    assert back.count() == 25 and {r["key_range"]: r["count"] for r in back.groupBy("key_range").count().collect()} == {0: 10, 1: 10, 2: 5}


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from episodia import session

    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_jdbc_reader_is_partitioned(spark):
    assert IO.key_ranges(0, 25, 10) == [(0, 10), (10, 20), (20, 25)]
    # no database here: the reader only holds its options
    reader = IO.jdbc_reader(spark, "jdbc:postgresql://host/db", "select 1", key="stay_id", low=30_000_000, high=40_000_000, step=1_000_000)
    assert reader is not None


def test_effect_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("t", "y", 1.5)], "treatment string, outcome string, effect double")
    IO.write_json_report(df, str(tmp_path / "e"))
    assert IO.effect_lookup(IO.read_effects(spark, str(tmp_path / "e"))) == {("t", "y"): 1.5}


def test_extracts_skip_and_limit(spark, tmp_path):
    p = {"a": lambda: spark.range(10), "b": lambda: spark.range(20)}
    assert IO.run_extracts(p, str(tmp_path), only=["a"], limit=3) == ["a"]
    assert IO.run_extracts(p, str(tmp_path), skip_existing=True) == ["b"]
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3


def test_fallback_and_view(spark):
    assert IO.table_or(spark, "absent_table", lambda: spark.range(2)).count() == 2
    assert IO.shared_view(spark.range(4), "four_rows").count() == 4
    assert IO.table_or(spark, "four_rows", lambda: spark.range(2)).count() == 4


def test_missing_files_are_named(spark):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        IO.first_existing(spark, ["/nowhere/a.csv"])


def test_stream_appends_only_new_keys(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))

    def add(lo, hi):
        spark.range(lo, hi).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).write.mode("append").parquet(src)

    def run():
        q = resume.resume_stream(spark.readStream.schema(schema).parquet(src), lambda d: d.filter("k % 2 = 0"), out, ["k"], chk)
        q.awaitTermination(120)

    add(0, 10)
    run()
    add(5, 20)
    run()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == list(range(0, 20, 2))


def test_durable_reads_back(spark):
    df = durable(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.count() == 5 and "Scan" in plan(df)


def test_split_filter_prunes_folders(spark, tmp_path):
    df = P.hash_split(spark.range(100), "id")
    IO.write_parquet(df, str(tmp_path / "p"), ["split"])
    got = plan(spark.read.parquet(str(tmp_path / "p")).filter("split = 'test'"))
    assert "PartitionFilters: [isnotnull(split" in got


def test_columns_and_filters_reach_the_scan(spark, small):
    got = plan(IO.read_columns(spark, f"{small}/lineitem.parquet", ["l_orderkey", "l_quantity"]).filter("l_quantity > 45"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in got
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in got


def test_top_per_group_limits_before_the_shuffle(spark, small):
    df = spark.read.parquet(f"{small}/orders.parquet")
    got = plan(P.top_per_group(df, ["o_custkey"], [F.desc("o_totalprice")], 3))
    below = got[got.index("Exchange"):]
    assert "WindowGroupLimit" in below


def test_splits_do_not_shuffle(spark, small):
    df = spark.read.parquet(f"{small}/orders.parquet")
    assert "Exchange" not in plan(P.hash_split(P.hash_sample(df, "o_custkey", 0.5, 1), "o_custkey"))


def test_large_episode_is_split_across_tasks(spark, tmp_path):
    """A join on the episode key followed by a grouping by bin is still split."""
    prepared(spark)
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        pts = spark.range(200_000, numPartitions=8).select(
            F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 5000).alias("s"), (F.xxhash64("id") % 100_000).alias("x"), F.xxhash64("id").alias("v"))
        stays = spark.range(5000).select(F.col("id").alias("s"), F.lit(-100_000).alias("a"), F.lit(100_000).alias("b"))
        out = I.points_to_bins(pts, stays, ["s"], "x", "a", "b", 14_400).groupBy("s", "bin").agg(F.count(F.lit(1)).alias("n"))
        assert out.agg(F.sum("n")).first()[0] == 200_000
        out.collect()
        assert "isSkew" in plan(out) or "skew=true" in plan(out)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_bucketed_tables_meet_without_an_exchange(spark, small):
    from episodia.catalog.panel import bucketed_panel
    from episodia.catalog.registry import Tables

    panel = bucketed_panel(Tables(spark, small))
    session = panel.sparkSession
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Window" in plan and "Exchange" not in plan
    assert session is not spark and spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert panel.count() > 0


def test_a_large_key_is_not_bucketed(spark):
    from episodia.sources.tables import bucketed, co_located

    session = co_located(spark)
    rows = session.range(1000).withColumn("k", F.when(F.col("id") < 700, 0).otherwise(F.col("id")))
    even = bucketed(rows, ["id"], buckets=8).groupBy("id").count()
    hot = bucketed(rows, ["k"], buckets=8).groupBy("k").count()
    exchanges = ["Exchange hash" in x._jdf.queryExecution().executedPlan().toString() for x in (even, hot)]
    assert exchanges == [False, True] and hot.filter("k = 0").first()["count"] == 700
