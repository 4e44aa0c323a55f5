"""Sorting, sampling and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodia.catalog.registry import query
from episodia.catalog.roles import n8, r6, split_sql, uniform_sql
from episodia.functions import scalars as S
from episodia.operators import sampling as T


@query("hash_uniform", "F5", f"select c_custkey, {r6(uniform_sql("'split'", '42', 'c_custkey'), 'u', 12)} from customer", digits=12)
def hash_uniform(t):
    return t.customer.select("c_custkey", S.uniform(F.lit("split"), F.lit(42), "c_custkey").alias("u"))


@query("hash_split", "T7 F5 Q4", f"select o_orderkey, {split_sql('o_custkey', 7)} as split from orders")
def hash_split(t):
    return T.hash_split(t.orders, "o_custkey", seed=7).select("o_orderkey", "split")


@query("hash_sample", "T6 F5", f"select o_orderkey, o_custkey from orders where {uniform_sql("'sample'", '42', 'o_custkey')} < 0.2")
def hash_sample(t):
    return T.hash_sample(t.orders, "o_custkey", 0.2, 42).select("o_orderkey", "o_custkey")


@query("ordinal_split", "T8", """
with i as (select c_custkey, row_number() over (order by c_custkey) - 1 as i, count(*) over () as n from customer)
select c_custkey, case when i < floor(n * 0.7) then 'train' when i < floor(n * 0.7) + floor(n * 0.15) then 'val' else 'test' end as split from i""")
def ordinal_split(t):
    return T.ordinal_split(t.customer.select("c_custkey"), "c_custkey")


@query("entity_split", "T9", f"select o_orderkey, case when {uniform_sql("'entity'", '42', 'o_custkey')} < 0.2 then 'test' else 'train' end as split from orders")
def entity_split(t):
    return T.entity_split(t.orders, "o_custkey", 0.2, 42).select("o_orderkey", "split")


@query("stratified_split", "T10", f"""
with r as (select doc_id, quality, row_number() over (partition by quality order by {uniform_sql("'strata'", '42', 'doc_id')}, doc_id) - 1 as i, count(*) over (partition by quality) as n from labels)
select doc_id, {n8('quality', 'quality')}, case when i < ceil(n * 0.2) then 'test' else 'train' end as split from r""")
def stratified_split(t):
    return T.stratified_split(t.labels.select("doc_id", "quality"), "doc_id", "quality", 0.2, 42)


@query("cap_per_split", "T11", f"""
with s as (select o_orderkey, o_custkey, {split_sql('o_custkey')} as split from orders),
r as (select split, o_custkey, row_number() over (partition by split order by {uniform_sql("'cap'", '5', 'o_custkey')}, o_custkey) as i from (select distinct split, o_custkey from s))
select o_orderkey, split from s join r using (split, o_custkey) where i <= 30""")
def cap_per_split(t):
    rows = T.hash_split(t.orders.select("o_orderkey", "o_custkey"), "o_custkey")
    return T.capped_per_split(rows, "o_custkey", "split", 30, 5).select("o_orderkey", "split")


@query("early_sample", "T12", f"""
with k as (select count(distinct o_custkey) as s, count(distinct o_orderkey) as e from orders)
select o_orderkey from orders, k where {uniform_sql("'sample'", '9', 'o_custkey')} < least((floor(500 / (e / s)) + 1) / s, 1.0)""")
def early_sample(t):
    return T.early_sample(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 500, 9).select("o_orderkey")


@query("smoke_subset", "T13 IO15", "select o_orderkey from orders where o_custkey in (select distinct o_custkey from orders order by 1 limit 25)")
def smoke_subset(t):
    return T.smallest_ids(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 25).select("o_orderkey")


@query("run_subsample", "T14", f"""
select c_custkey, {n8('run', 'run')} from customer, range(0, 6) r(run) where {uniform_sql("'run'", '3', 'run', 'c_custkey')} < 0.3""")
def run_subsample(t):
    return T.run_subsamples(t.customer.select("c_custkey"), "c_custkey", 6, 0.3, 3)


@query("fixed_sample", "T15", f"select o_orderkey from orders order by {uniform_sql("'fixed'", '11', 'o_orderkey')}, o_orderkey limit 100")
def fixed_sample(t):
    return T.fixed_sample(t.orders.select("o_orderkey"), "o_orderkey", 100, 11)


@query("ranked_pool", "T16 W18", f"""
with m as (select p_brand as name, row_number() over (order by sum(p_retailprice) desc, p_brand) as rank from part group by 1)
select name, {n8('rank', 'rank')} from m where name not in ('Brand#1', 'Brand#5') order by rank limit 8""")
def ranked_pool(t):
    m = t.part.groupBy(F.col("p_brand").alias("name")).agg(F.round(F.sum("p_retailprice"), 4).alias("total"))
    ranking = T.rank_of(m, "total", "name")
    return T.ranked_pool(ranking, "name", "rank", ["Brand#1", "Brand#5"], 8).select("name", "rank")


@query("sort_mixed", "T1", f"""
select l_suppkey, {n8('count(*)', 'n')}, {r6('sum(l_quantity)', 'q')}, {r6('max(l_discount)', 'd')} from lineitem group by 1 order by 2 desc, 3 desc, 1""")
def sort_mixed(t):
    rows = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    return rows.orderBy(F.desc("n"), F.desc("q"), F.asc("l_suppkey"))


@query("top_n", "T2", f"select o_orderkey, {r6('o_totalprice', 'price', 2)} from orders order by o_totalprice desc, o_orderkey limit 25", digits=2)
def top_n(t):
    return T.top_rows(t.orders.select("o_orderkey", F.col("o_totalprice").alias("price")), [F.desc("price"), F.asc("o_orderkey")], 25)


@query("top_n_per_group", "T3", f"""
select o_custkey, o_orderkey, {n8('place', 'place')} from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) where place <= 3""")
def top_n_per_group(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return T.top_per_group(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


@query("one_per_episode", "T5", """
select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) where rn = 1""")
def one_per_episode(t):
    return T.one_per_group(t.orders, ["o_custkey"], ["o_orderkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"])
