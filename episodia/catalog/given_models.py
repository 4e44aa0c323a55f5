"""Scoring with given models: what follows a fit, compared with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodia.catalog.registry import query
from episodia.catalog.roles import n8, r6
from episodia.operators import effects as E
from episodia.operators import models as M
from episodia.operators.sequences import next_state

TREATED = M.LinearScore(["l_quantity", "gap"], [0.04, -1.5], -0.6, {"l_quantity": 20.0, "gap": 0.05}, True)
OUTCOME = M.LinearScore(["l_quantity", "gap", "l_linenumber"], [2.0, 100.0, -3.0], 10.0, {"l_quantity": 20.0, "gap": 0.05, "l_linenumber": 1.0})
LINE_SQL = """x as (select l_orderkey, l_linenumber, l_quantity, nullif(l_discount, 0.04) as gap from lineitem),
s as (select *, 1 / (1 + exp(-(-0.6 + l_quantity * 0.04 + coalesce(gap, 0.05) * -1.5))) as p, 10.0 + l_quantity * 2.0 + coalesce(gap, 0.05) * 100.0 as base from x)"""


def lines(t):
    gap = F.when(F.col("l_discount") != 0.04, F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", gap.alias("gap"))


@query("given_propensity", "M2", f"with {LINE_SQL} select l_orderkey, l_linenumber::bigint as l_linenumber, {r6('p', 'p_drug')} from s")
def given_propensity(t):
    return M.score_propensities(lines(t), {"drug": TREATED}).select("l_orderkey", "l_linenumber", "p_drug")


@query("given_potential_outcomes", "M3", f"with {LINE_SQL} select l_orderkey, l_linenumber::bigint as l_linenumber, {r6('base - 3.0', 'mu1')}, {r6('base', 'mu0')} from s")
def given_potential_outcomes(t):
    return M.potential_outcomes(lines(t), OUTCOME, "l_linenumber").select("l_orderkey", "l_linenumber", "mu1", "mu0")


@query("given_masked_model", "M9 M5 M18", f"""with {LINE_SQL}
select {n8('a', 'action')}, {n8('count(*)', 'n')}, {r6('avg(10.0 + l_quantity * 2.0 + coalesce(gap, 0.05) * 100.0 - 3.0 * (a & 1))', 'mean_next', 4)},
  {r6('avg(1 / (1 + exp(-(-0.6 + l_quantity * 0.04 - 1.5 * ((a >> 1) & 1)))))', 'mean_done', 4)} from s, range(0, 4) r(a) group by 1""", digits=4)
def given_masked_model(t):
    value = M.LinearScore(["l_quantity", "gap", "first"], [2.0, 100.0, -3.0], 10.0, {"l_quantity": 20.0, "gap": 0.05, "first": 0.0})
    done = M.LinearScore(["l_quantity", "second"], [0.04, -1.5], -0.6, {"l_quantity": 20.0, "second": 0.0}, True)
    model = M.MaskedLinearModel({"next": value}, {"next": 0.0}, done)
    rows = lines(t).withColumns({"first": F.lit(0), "second": F.lit(0)})
    swept = M.counterfactual_sweep(rows, model, ["first", "second"])
    return swept.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.avg("pred_next").alias("mean_next"), F.avg("pred_done").alias("mean_done"))


Q = M.LinearScore(["price", "both"], [0.01, 0.5], 1.0, {"price": 0.0, "both": 0.0})
STEP_SQL = """o as (select o_custkey, o_orderkey, o_totalprice / 1000 as price, o_orderkey % 3 as act, o_orderkey % 5 as reward,
  lead(o_totalprice / 1000) over (partition by o_custkey order by o_orderdate, o_orderkey) as next_price,
  row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1 as done from orders)"""


def order_steps(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_totalprice") / 1000).alias("price"), (F.col("o_orderkey") % 3).alias("both"),
                           (F.col("o_orderkey") % 5).cast("double").alias("reward"))
    return next_state(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["price"])


@query("given_q_backup", "M17", f"with {STEP_SQL} select o_orderkey, {r6('reward + case when done then 0 else 0.9 * (1.0 + 0.01 * next_price + 0.5 * 2) end', 'target')} from o")
def given_q_backup(t):
    return M.q_backup(order_steps(t), Q, ["price"], "both", "reward", "done", 3, 0.9, name="target").select("o_orderkey", "target")


@query("given_greedy_action", "M17 T4", f"with {STEP_SQL} select o_orderkey, 2::bigint as best_action, {r6('1.0 + 0.01 * price + 0.5 * 2', 'best_value')} from o")
def given_greedy_action(t):
    return M.greedy_action(order_steps(t), Q, "both", 3).select("o_orderkey", "best_action", "best_value")


@query("given_effects", "M2 M3 A38 A39", f"""with {LINE_SQL},
c as (select *, (l_linenumber % 2) as d, l_quantity + l_linenumber as y, least(greatest(p, 0.01), 0.99) as q, base - 3.0 as mu1, base as mu0 from s)
select {r6('avg(mu1 - mu0 + (d / q) * (y - mu1) - ((1 - d) / (1 - q)) * (y - mu0))', 'aipw', 4)} from c""", digits=4)
def given_effects(t):
    rows = M.score_propensities(lines(t), {"drug": TREATED}).withColumns({"drug": F.col("l_linenumber") % 2, "y": F.col("l_quantity") + F.col("l_linenumber")})
    rows = rows.withColumns({"mu1": OUTCOME.column({"l_linenumber": F.lit(1.0)}), "mu0": OUTCOME.column({"l_linenumber": F.lit(0.0)})})
    out = E.doubly_robust_effect(rows, "drug", "y", "p_drug", "mu1", "mu0")
    return out.select(F.col(out.columns[0]).alias("aipw"))
