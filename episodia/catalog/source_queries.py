"""Source, sink and report queries: tables are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodia.catalog.registry import query
from episodia.catalog.roles import n8, r6, split_sql
from episodia.operators.sampling import hash_split
from episodia.session import fresh_folder
from episodia.sources import tables as IO
from episodia.streaming import key_index, resume


def scratch(t) -> str:
    """A fresh folder for this run in the session's shared folder."""
    return fresh_folder(t.spark, "scratch")


@query("sql_extract", "IO1 IO4 F1", """
select o_custkey, cast(count(*) as bigint) as n, cast(max(epoch(o_orderdate)) as bigint) as last_sec from orders where o_orderstatus <> 'P' group by 1""")
def sql_extract(t):
    """The kept orders are a view of the session, which the query then reads."""
    IO.shared_view(t.orders.filter("o_orderstatus <> 'P'"), "kept_orders")
    return IO.run_query(t.spark, """
        SELECT o_custkey, count(*) AS n, max(unix_timestamp(o_orderdate)) AS last_sec
        FROM kept_orders GROUP BY o_custkey""")


@query("extract_plan", "IO2 IO3 IO7 IO11", """
select 'cohort' as extract, o_orderkey as id from orders where o_orderstatus = 'F' union all select 'events', event_id from events""")
def extract_plan(t):
    """Named extracts in order, the large one by key ranges, read back as one."""
    folder = scratch(t)
    plan = {"cohort": lambda: t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))}
    IO.write_key_ranges(t.events.select(F.col("event_id").alias("id")), "id", 10_000, f"{folder}/events")
    IO.run_extracts(plan, folder)
    IO.run_extracts(plan, folder, only=["cohort"], skip_existing=True)
    cohort = t.spark.read.parquet(f"{folder}/cohort").select(F.lit("cohort").alias("extract"), "id")
    events = t.spark.read.parquet(f"{folder}/events").select(F.lit("events").alias("extract"), "id")
    return cohort.unionByName(events)


@query("csv_round_trip", "IO6 IO7 IO9 IO10 Q1", f"select o_orderkey, o_orderstatus, {r6('o_totalprice', 'price', 2)}, epoch_us(o_orderdate) as at from orders", digits=2)
def csv_round_trip(t):
    folder = scratch(t)
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("at"))
    IO.write_csv(rows, folder + "/orders", ["o_orderkey", "o_orderstatus", "price", "at"])
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()),
                           T.StructField("price", T.DoubleType()), T.StructField("at", T.TimestampNTZType())])
    typed = IO.read_csv(t.spark, [folder + "/missing", folder + "/orders"], schema).select("o_orderkey", "o_orderstatus", "price")
    dated = IO.read_dated_csv(t.spark, folder + "/orders", ["at"], ["o_orderkey", "at"]).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "at")
    return typed.join(dated, "o_orderkey")


@query("part_files", "IO7", "select event_id, user_id from events")
def part_files(t):
    folder = scratch(t)
    t.events.select("event_id", "user_id").write.option("header", True).csv(folder)
    return IO.read_parts(t.spark, folder, "part-*", T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType())]))


@query("parquet_by_split", "IO11 IO8 P10 T7", f"select o_orderkey from orders where {split_sql('o_custkey')} = 'valid'")
def parquet_by_split(t):
    folder = scratch(t)
    IO.write_parquet(hash_split(t.orders, "o_custkey"), folder, ["split"], "overwrite")
    return IO.read_columns(t.spark, folder, ["o_orderkey", "split"]).filter("split = 'valid'").select("o_orderkey")


@query("resume_append", "IO12 U4", f"select user_id, {n8('count(*)', 'n')} from events group by 1")
def resume_append(t):
    """A first load of some keys, then a full load that adds only the rest."""
    folder = scratch(t)
    counts = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    resume.append_new(counts.filter("user_id % 3 = 0"), folder, ["user_id"])
    resume.append_new(counts, folder, ["user_id"])
    resume.append_new(counts, folder, ["user_id"])
    return t.spark.read.parquet(folder)


@query("json_report", "IO13 IO16", f"""
select l_returnflag as treatment, l_linestatus as outcome, {r6('avg(l_discount)', 'effect')} from lineitem group by 1, 2""")
def json_report(t):
    folder = scratch(t)
    effects = t.lineitem.groupBy(F.col("l_returnflag").alias("treatment"), F.col("l_linestatus").alias("outcome")).agg(F.avg("l_discount").alias("effect"))
    IO.write_json_report(effects, folder)
    return IO.read_effects(t.spark, folder)


@query("table_or_fallback", "IO5 IO4", "select n_nationkey::bigint as n_nationkey, n_name from nation")
def table_or_fallback(t):
    return IO.table_or(t.spark, "no_such_table_here", lambda: t.nation.select("n_nationkey", "n_name"))


@query("column_pruned_read", "IO8", "select l_orderkey, l_quantity from lineitem where l_quantity > 45")
def column_pruned_read(t):
    return IO.read_columns(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_quantity"]).filter("l_quantity > 45")


@query("json_rows", "IO13", """select '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' as report from region""")
def json_rows(t):
    return IO.as_json(t.region.select("r_regionkey", "r_name"))


@query("configured_extract", "IO14 IO8", f"""
select l_returnflag, {n8('count(*)', 'n')}, {r6('avg(l_quantity)', 'mean_quantity')} from lineitem where l_quantity >= 5 and l_linenumber <= 4 group by 1""")
def configured_extract(t):
    """Parameters, columns and a path relative to the configuration's own folder, all read by Spark."""
    import json
    folder = scratch(t)
    t.lineitem.select("l_returnflag", "l_quantity", "l_linenumber", "l_tax").write.parquet(f"{folder}/tables/lines")
    text = json.dumps({"input": {"lines_path": "tables/lines"}, "columns": ["l_returnflag", "l_quantity", "l_linenumber"], "least_quantity": 5, "most_lines": 4})
    t.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/settings")
    config = IO.read_config(f"{folder}/settings", t.spark)
    rows = IO.read_columns(t.spark, config["input"]["lines_path"], config["columns"])
    kept = rows.filter((F.col("l_quantity") >= config["least_quantity"]) & (F.col("l_linenumber") <= config["most_lines"]))
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_quantity"))


@query("indexed_append", "IO12 U4", f"select user_id, {n8('count(*)', 'n')} from events group by 1")
def indexed_append(t):
    """Loads that overlap: the filters of earlier batches tell which parts to compare with."""
    folder = scratch(t)
    counts = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    for part in ("user_id % 3 = 0", "user_id % 2 = 0", "true", "true"):
        key_index.append_indexed(counts.filter(part), folder, ["user_id"], 8)
    return key_index.read_indexed(t.spark, folder, counts.schema)
