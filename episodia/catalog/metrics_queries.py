"""Prediction metric and distribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodia.catalog.registry import query
from episodia.catalog.roles import EV_SQL, LATE_SQL, PANEL_SQL, ev, n8, panel, r6, uniform_sql, with_
from episodia.functions import scalars as S
from episodia.operators import metrics as M

SCORED_SQL = f"""sc as (select doc_id, quality, toxic, 0.05 + 0.9 * floor({uniform_sql("'score'", 'doc_id')} * 50) / 50 as p from labels)"""


def scored(t):
    u = S.uniform(F.lit("score"), "doc_id")
    return t.labels.select("doc_id", "quality", "toxic", (0.05 + 0.9 * F.floor(u * 50) / 50).alias("p"))


@query("binary_metrics", "A30", "with " + SCORED_SQL + f""",
g as (select p, sum(case when quality = 1 then 1 else 0 end) as pos, sum(case when quality = 0 then 1 else 0 end) as neg from sc group by p),
c as (select *, sum(neg) over (order by p) - neg as below, sum(pos) over (order by p desc) as hits, sum(pos + neg) over (order by p desc) as shown, sum(pos) over () as tp, sum(neg) over () as tn from g)
select {n8('sum(pos + neg)', 'n')}, {r6('sum(pos * (below + neg / 2.0)) / max(tp * tn)', 'auc')}, {r6('sum(pos * (hits / shown)) / max(tp)', 'average_precision')},
  {r6('(select avg((p - quality) * (p - quality)) from sc)', 'brier')}, {r6('(select -avg(case when quality = 1 then ln(p) else ln(1 - p) end) from sc)', 'log_loss')},
  {r6('(select avg(case when (p >= 0.5) = (quality = 1) then 1.0 else 0.0 end) from sc)', 'accuracy')} from c""")
def binary_metrics(t):
    return M.binary_metrics(scored(t), "quality", "p")


@query("regression_metrics", "A28", f"""
with x as (select l_extendedprice / 1000 as y, 0.9 * l_extendedprice / 1000 + l_quantity / 10 as yh from lineitem)
select {n8('count(*)', 'n')}, {r6('avg(abs(yh - y))', 'mae')}, {r6('sqrt(avg((yh - y) * (yh - y)))', 'rmse')}, {r6('1 - sum((yh - y) * (yh - y)) / (var_pop(y) * count(*))', 'r2')},
  {r6('avg(y)', 'mean_actual')}, {r6('avg(yh)', 'mean_predicted')} from x""")
def regression_metrics(t):
    rows = t.lineitem.select((F.col("l_extendedprice") / 1000).alias("y"), (0.9 * F.col("l_extendedprice") / 1000 + F.col("l_quantity") / 10).alias("yh"))
    return M.regression_metrics(rows, "y", "yh")


@query("spearman", "A29", f"""
with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as a,
   rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as b from lineitem)
select {r6('corr(a, b)', 'spearman')} from r""")
def spearman(t):
    return M.spearman(t.lineitem.select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")


@query("ks_two_sample", "A32", with_(EV_SQL, select=f"""
, x as (select value, case when event_type in ('click', 'view') then 1 else 0 end as a from ev where value is not null),
g as (select value, sum(a) as n1, sum(1 - a) as n2 from x group by 1),
c as (select *, sum(n1) over (order by value) / sum(n1) over () as f1, sum(n2) over (order by value) / sum(n2) over () as f2 from g),
k as (select max(abs(f1 - f2)) as d, sum(n1) as n, sum(n2) as m from c),
s as (select *, sqrt(n * m / (n + m)) * d as lam from k)
select {n8('n', 'n_first')}, {n8('m', 'n_second')}, {r6('d', 'ks_stat')}, {r6('(select avg(value) from x where a = 1)', 'mean_first')}, {r6('(select stddev_pop(value) from x where a = 1)', 'std_first')},
  {r6('(select avg(value) from x where a = 0)', 'mean_second')}, {r6('(select stddev_pop(value) from x where a = 0)', 'std_second')},
  {r6('case when lam < 0.2 then 1 else least(greatest((select sum(case when i % 2 = 1 then 2.0 else -2.0 end * exp(-2.0 * i * i * lam * lam)) from range(1, 101) r(i)), 0), 1) end', 'ks_pvalue')} from s"""))
def ks_two_sample(t):
    return M.two_sample_ks(ev(t).select("value", "event_type"), "value", F.col("event_type").isin("click", "view"))


@query("one_step_errors", "A31", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
, p as (select *, lead(hb) over (partition by user_id order by bin) as next_hb, lead(bun) over (partition by user_id order by bin) as next_bun from panel)
select 'mse_next_hb' as metric, {r6('avg((hb - next_hb) * (hb - next_hb))', 'value')} from p union all
select 'mse_next_bun', {r6('avg((bun - next_bun) * (bun - next_bun))', 'value')} from p union all select 'rate_vaso', {r6('avg(vaso)', 'value')} from p"""))
def one_step_errors(t):
    from episodia.operators.sequences import next_state
    moved = next_state(panel(t), ["user_id"], ["bin"], ["hb", "bun"])
    return M.feature_errors(moved, [("next_hb", "hb"), ("next_bun", "bun")], ["vaso"])
