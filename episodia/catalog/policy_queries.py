"""Off-policy evaluation and policy comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodia.catalog.registry import query
from episodia.catalog.roles import EV_SQL, ev, n8, r6, uniform_sql, with_
from episodia.functions import scalars as S
from episodia.operators import policy_value as V
from episodia.operators import sampling as T
from episodia.operators.joins import with_action_grid
from episodia.operators.sequences import row_number_in

# events as logged trajectories: action, other policy's action, reward, estimates
TRAJ_SQL = f"""traj as (
  select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as t, event_id % 3 as a, case when event_id % 7 = 0 then (event_id + 1) % 3 else event_id % 3 end as b,
    coalesce(value, 0) / 100 as r, 0.5 + 0.5 * {uniform_sql("'pi'", 'event_id')} as pi, (user_id % 5) / 4.0 as q, (event_id % 9) / 10.0 as rhat from ev)"""


def trajectories(t):
    rows = ev(t).select(
        "user_id", "ts", "event_id", (F.col("event_id") % 3).alias("a"),
        F.when(F.col("event_id") % 7 == 0, (F.col("event_id") + 1) % 3).otherwise(F.col("event_id") % 3).alias("b"),
        (F.coalesce("value", F.lit(0.0)) / 100).alias("r"), (0.5 + 0.5 * S.uniform(F.lit("pi"), "event_id")).alias("pi"),
        ((F.col("user_id") % 5) / 4.0).alias("q"), ((F.col("event_id") % 9) / 10.0).alias("rhat"),
    )
    return row_number_in(rows, ["user_id"], ["ts", "event_id"], "t", 0)


@query("discounted_return", "A46", with_(EV_SQL, TRAJ_SQL, select=f"select user_id, {r6('sum(r * pow(0.99, t))', 'discounted_return')} from traj group by 1"))
def discounted_return(t):
    return V.discounted_returns(trajectories(t), ["user_id"], "t", "r")


@query("return_summary", "A46", with_(EV_SQL, TRAJ_SQL, select=f"""
select {r6('avg(g)', 'mean')}, {r6('stddev_pop(g)', 'std')}, {n8('count(*)', 'n_trajectories')} from (select sum(r * pow(0.99, t)) as g from traj group by user_id)"""))
def return_summary(t):
    return V.return_summary(V.discounted_returns(trajectories(t), ["user_id"], "t", "r"))


DR_SQL = TRAJ_SQL + """,
st as (select user_id, t, rhat, case when a = b then 1 / greatest(pi, 1e-6) else 0.0 end as rho, r, q from traj),
dr as (select user_id, list_reduce(list_prepend({'x': 0.0, 'y': 0.0, 'z': 0.0, 'v': 0.0::double}, list({'x': rhat::double, 'y': rho::double, 'z': (r - q)::double, 'v': 0.0::double} order by t desc)),
    lambda acc, s: {'x': 0.0::double, 'y': 0.0::double, 'z': 0.0::double, 'v': s.x + s.y * (s.z + 0.99 * acc.v)}).v as value from st group by 1)"""


@query("dr_trajectory_values", "A47", with_(EV_SQL, DR_SQL, select=f"select user_id, {r6('case when abs(value) < 1e6 then value end', 'value', 4)} from dr"), digits=4)
def dr_trajectory_values(t):
    out = V.doubly_robust_values(trajectories(t), ["user_id"], "t", "a", "b", "r", "pi", "q", "rhat")
    return out.select("user_id", F.when(F.abs("value") < 1e6, F.col("value")).alias("value"))


@query("dr_ope", "A47", with_(EV_SQL, DR_SQL, select=f"""
select {r6('avg(case when abs(value) <= 40 then value end)', 'mean', 5)}, {r6('stddev_pop(case when abs(value) <= 40 then value end)', 'std', 5)}, {n8('count(*)', 'n_trajectories')},
  {n8('count(case when abs(value) <= 40 then 1 end)', 'n_valid')} from dr"""), digits=5)
def dr_ope(t):
    return V.doubly_robust_summary(V.doubly_robust_values(trajectories(t), ["user_id"], "t", "a", "b", "r", "pi", "q", "rhat"))


# one return per user and policy; policies are the event types
EPI_SQL = "epi as (select user_id, event_type as policy, sum(value) as g, max(case when event_id % 2 = 0 then 1 else 0 end) as ended from events group by 1, 2)"


def policy_episodes(t):
    return t.events.groupBy("user_id", F.col("event_type").alias("policy")).agg(F.sum("value").alias("g"), F.max((F.col("event_id") % 2 == 0).cast("int")).alias("ended"))


@query("policy_summary", "A42 A21", with_(EPI_SQL, select=f"""
select policy, {n8('count(*)', 'episodes')}, {r6('avg(g)', 'mean_return')}, {r6('stddev_pop(g)', 'std_return')}, {r6('avg(ended)', 'mean_ended')},
  {r6('quantile_cont(g, 0.25)', 'p25')}, {r6('quantile_cont(g, 0.5)', 'p50')}, {r6('quantile_cont(g, 0.75)', 'p75')} from epi group by 1"""))
def policy_summary(t):
    return V.policy_summary(policy_episodes(t), "policy", "g", ["ended"])


@query("policy_pairwise", "A43", with_(EPI_SQL, select=f"""
select a.policy as left_policy, b.policy as right_policy, {r6('avg(a.g - b.g)', 'mean_diff')}, {r6('avg(case when a.g - b.g > 0 then 1.0 else 0.0 end)', 'win_rate')}, {n8('count(*)', 'n_common')}
from epi a join epi b on a.user_id = b.user_id and a.policy < b.policy group by 1, 2"""))
def policy_pairwise(t):
    return V.policy_pairwise(policy_episodes(t), "user_id", "policy", "g", ["click", "error", "purchase", "signup", "view"])


RISK_SQL = f"risk as (select event_id, {uniform_sql("'r1'", 'event_id')} as p, {uniform_sql("'r2'", 'event_id')} as n, {uniform_sql("'r3'", 'event_id')} as o from events)"


@query("strategy_comparison", "A44", with_(RISK_SQL, select=f"""
select {n8('count(*)', 'n')}, {r6('avg(p)', 'mean_policy')}, {r6('avg(n)', 'mean_nothing')}, {r6('avg(o)', 'mean_observed')},
  {r6('avg(case when p < n then 1.0 else 0.0 end)', 'better_than_nothing')}, {r6('avg(case when p < o then 1.0 else 0.0 end)', 'better_than_observed')} from risk"""))
def strategy_comparison(t):
    rows = t.events.select(*[S.uniform(F.lit(f"r{i}"), "event_id").alias(n) for i, n in ((1, "p"), (2, "n"), (3, "o"))])
    return V.strategy_comparison(rows, "p", "n", "o")


@query("agreement", "A45", with_(EV_SQL, TRAJ_SQL, select=f"""
select {r6('100.0 * avg(case when a = b then 1.0 else 0.0 end)', 'agreement_percent')}, {n8('count(distinct b)', 'n_unique_actions')} from traj"""))
def agreement(t):
    return V.action_agreement(trajectories(t), "a", "b")


EFFECTS = [0.5, -1.25, 2.0, -0.75, 0.25]
GRID_SQL = """g as (select o_orderkey, a, o_totalprice / 100000 - 2 + """ + " + ".join(
    f"((a >> {i}) & 1) * {e}" for i, e in enumerate(EFFECTS)) + """ as y, o_totalprice, o_custkey from orders, range(0, 32) r(a)),
risk as (select o_orderkey, a, abs(y - (o_custkey % 5)) as risk from g)"""


@query("exhaustive_policy", "J23 F40 F25 T4", with_(GRID_SQL, select=f"""
select o_orderkey, {n8('arg_min(a, round(risk, 9) * 1000 + a)', 'action')}, {r6('min(round(risk, 9))', 'risk', 9)} from risk group by 1""").replace("arg_min(a, round(risk, 9) * 1000 + a)", "arg_min(a, (round(risk, 9), a))"), digits=9)
def exhaustive_policy(t):
    """All 32 combinations are columns that are compared inside the row; nothing is sent.

    Risks that agree to nine digits are ties, so they are compared as whole numbers.
    """
    rows = t.orders.select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 100000 - 2).alias("base"))
    options = []
    for a in range(1 << len(EFFECTS)):
        y = F.col("base") + F.lit(sum(e for i, e in enumerate(EFFECTS) if a >> i & 1))
        risk = F.abs(y - F.col("o_custkey") % 5)
        options.append(F.struct(F.floor(risk * F.lit(1e9) + 0.5).alias("units"), F.lit(a).alias("action"), risk.alias("risk")))
    return rows.select("o_orderkey", F.least(*options).alias("best")).select("o_orderkey", "best.action", "best.risk")


@query("action_grid_rows", "J23 F25", """
select n_name, cast(a as bigint) as action, cast(a & 1 as bigint) as b0, cast((a >> 1) & 1 as bigint) as b1, cast((a >> 2) & 1 as bigint) as b2 from nation, range(0, 8) r(a)""")
def action_grid_rows(t):
    grid = with_action_grid(t.nation.select("n_name"), 3, "action")
    return grid.select("n_name", "action", *[S.decode_bit("action", i).alias(f"b{i}") for i in range(3)])


@query("effect_correction", "F40", f"""
select event_id, {r6("value + (case when event_type = 'click' then 1 else 0 end) * 0.5 + (case when event_type = 'view' or event_type = 'click' then 1 else 0 end) * -1.5", 'corrected')} from events""")
def effect_correction(t):
    kind = F.col("event_type")
    flags = [((kind == "click").cast("int"), F.lit(0.5)), (kind.isin("view", "click").cast("int"), F.lit(-1.5))]
    return t.events.select("event_id", S.add_effects("value", flags).alias("corrected"))


@query("argmax_action", "T4", f"""
with s as (select user_id, event_id % 8 as action, sum(value) as score from events group by 1, 2)
select user_id, {n8('arg_min(action, (-round(score, 6), action))', 'action')}, {r6('max(score)', 'score')} from s group by 1""")
def argmax_action(t):
    scores = t.events.groupBy("user_id", (F.col("event_id") % 8).alias("action")).agg(F.round(F.sum("value"), 6).alias("score"))
    return T.best_action(scores, ["user_id"], "action", "score", lowest=False)
