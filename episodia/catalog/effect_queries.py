"""Treatment-effect queries with given propensity and outcome columns."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from episodia.catalog.registry import query
from episodia.catalog.roles import EV_SQL, ev, n8, r6, uniform_sql, with_
from episodia.functions import scalars as S
from episodia.operators import effects as E
from episodia.operators import joins as J

# treatment and outcome with gaps, a score in (0, 1) and two outcome columns
RX_SQL = f"""rx as (
  select event_id, case when event_id % 11 = 0 then null when event_type in ('click', 'view') then 1 else 0 end as drug, case when event_type in ('error', 'view') then 1 else 0 end as other,
    value as next_y, {uniform_sql("'ps'", 'event_id')} as p, 0.3 + 0.4 * {uniform_sql("'qs'", 'event_id')} as p2,
    40 + cast(user_id % 10 as double) as mu1, 45 - cast(user_id % 7 as double) as mu0, cast(user_id % 13 as double) as c1, case when event_id % 6 = 0 then null else sqrt(sec % 86400) end as c2, cast(event_id % 2 as double) as c3
  from ev),
pc as (select *, least(greatest(p, 0.01), 0.99) as q, least(greatest(p2, 0.01), 0.99) as q2, coalesce(drug, 0) as t from rx)"""


def rx(t):
    kind = F.col("event_type")
    return ev(t).select(
        "event_id", F.when(F.col("event_id") % 11 != 0, kind.isin("click", "view").cast("int")).alias("drug"), kind.isin("error", "view").cast("int").alias("other"),
        F.col("value").alias("next_y"), S.uniform(F.lit("ps"), "event_id").alias("p"), (0.3 + 0.4 * S.uniform(F.lit("qs"), "event_id")).alias("p2"),
        (40 + F.col("user_id") % 10).cast("double").alias("mu1"), (45 - F.col("user_id") % 7).cast("double").alias("mu0"),
        (F.col("user_id") % 13).cast("double").alias("c1"), F.when(F.col("event_id") % 6 != 0, F.sqrt(F.col("sec") % 86400)).alias("c2"), (F.col("event_id") % 2).cast("double").alias("c3"),
    )


def _smd_sql(t: str, q: str, c: str) -> str:
    w = f"case when {t} = 1 then 1 / {q} else 1 / (1 - {q}) end"
    return f"""select '{'drug' if t == 't' else 'other'}' as treatment, '{c}' as confounder,
      (avg({c}) filter ({t} = 1) - avg({c}) filter ({t} = 0)) / nullif(sqrt((var_samp({c}) filter ({t} = 1) + var_samp({c}) filter ({t} = 0)) / 2), 0) as raw_smd,
      sum(({w}) * {c}) filter ({t} = 1) / sum({w}) filter ({t} = 1 and {c} is not null) as a1, sum(({w}) * {c}) filter ({t} = 0) / sum({w}) filter ({t} = 0 and {c} is not null) as a0,
      sum(({w}) * {c} * {c}) filter ({t} = 1) / sum({w}) filter ({t} = 1 and {c} is not null) as b1, sum(({w}) * {c} * {c}) filter ({t} = 0) / sum({w}) filter ({t} = 0 and {c} is not null) as b0 from pc"""


BAL_SQL = "raw as (" + " union all ".join(
    [_smd_sql("t", "q", c) for c in ("c1", "c2", "c3")] + [_smd_sql("other", "q2", c) for c in ("c1", "c2", "c3")]) + """),
bal as (select treatment, confounder, raw_smd, (a1 - a0) / nullif(sqrt((b1 - a1 * a1 + b0 - a0 * a0) / 2), 0) as weighted_smd from raw)"""


def balance(t):
    return E.balance_tables(rx(t), {"drug": "p", "other": "p2"}, ["c1", "c2", "c3"])


@query("overlap_summary", "A36", with_(EV_SQL, RX_SQL, select=f"""
select 'drug' as treatment, {n8('sum(t)', 'n_treated')}, {n8('sum(1 - t)', 'n_control')}, {r6('avg(p) filter (t = 1)', 'mean_treated')}, {r6('avg(p) filter (t = 0)', 'mean_control')},
  {r6('min(p) filter (t = 1)', 'min_treated')}, {r6('max(p) filter (t = 1)', 'max_treated')}, {r6('min(p) filter (t = 0)', 'min_control')}, {r6('max(p) filter (t = 0)', 'max_control')},
  {r6('avg(case when p < 0.1 or p > 0.9 then 1.0 else 0.0 end)', 'share_outside')}, {n8('case when avg(case when p < 0.1 or p > 0.9 then 1.0 else 0.0 end) > 0.2 then 1 else 0 end', 'poor_overlap')} from pc"""))
def overlap_summary(t):
    return E.overlap_summary(rx(t), "drug", "p")


@query("balance_table", "A33 A34 A35", with_(EV_SQL, RX_SQL, BAL_SQL, select=f"""
select treatment, confounder, {r6('raw_smd', 'raw_smd', 5)}, {r6('weighted_smd', 'weighted_smd', 5)}, {n8('case when abs(weighted_smd) < 0.1 then 1 else 0 end', 'well_balanced')} from bal"""), digits=5)
def balance_table(t):
    return balance(t)


@query("balance_summary", "A57", with_(EV_SQL, RX_SQL, BAL_SQL, select=f"""
select treatment, {r6('avg(abs(raw_smd))', 'mean_raw', 5)}, {r6('avg(abs(weighted_smd))', 'mean_weighted', 5)}, {n8('sum(case when abs(raw_smd) > 0.2 then 1 else 0 end)', 'n_bad')},
  {n8('case when avg(abs(weighted_smd)) < avg(abs(raw_smd)) then 1 else 0 end', 'improved')} from bal group by 1"""), digits=5)
def balance_summary(t):
    return E.balance_summary(balance(t))


@query("worst_balanced", "A57 T1", with_(EV_SQL, RX_SQL, BAL_SQL, select=f"""
select treatment, confounder, {r6('raw_smd', 'raw_smd', 5)}, {r6('weighted_smd', 'weighted_smd', 5)} from bal where abs(raw_smd) > 0.01"""), digits=5)
def worst_balanced(t):
    return E.worst_balanced(balance(t), 0.01).drop("well_balanced")


@query("naive_effect", "A37", with_(EV_SQL, RX_SQL, select=f"""
select {r6('avg(next_y) filter (drug = 1) - avg(next_y) filter (drug = 0)', 'naive')} from pc where drug is not null and next_y is not null"""))
def naive_effect(t):
    return E.naive_effect(rx(t), "drug", "next_y")


@query("ipw_effect", "A38", with_(EV_SQL, RX_SQL, select=f"""
select {r6('sum(drug / q * next_y) / sum(drug / q) - sum((1 - drug) / (1 - q) * next_y) / sum((1 - drug) / (1 - q))', 'ipw')} from pc where drug is not null and next_y is not null"""))
def ipw_effect(t):
    return E.weighted_effect(rx(t), "drug", "next_y", "p")


PSI_SQL = "psi as (select event_id, mu1 - mu0 + (drug / q) * (next_y - mu1) - ((1 - drug) / (1 - q)) * (next_y - mu0) as psi from pc where drug is not null and next_y is not null)"


@query("aipw_given_models", "A39", with_(EV_SQL, RX_SQL, PSI_SQL, select=f"select {r6('avg(psi)', 'aipw')} from psi"))
def aipw_given_models(t):
    return E.doubly_robust_effect(rx(t), "drug", "next_y", "p", "mu1", "mu0")


def _boot_sql(rows: str, runs: int, seed: int) -> str:
    """Weighted copies of ``rows`` in all resamples; draw -1 is the sample."""
    def mix(x: str) -> str:
        for shift, factor in ((16, E.MIX_1), (13, E.MIX_2), (16, None)):
            x = f"list_transform([{x}], lambda v: xor(v, v >> {shift}::ubigint))[1]"
            x = f"({x} * {factor}::ubigint) % 4294967296::ubigint" if factor else x
        return x

    u = mix("xor(" + mix(f"(lo + (draw * {E.GOLDEN}) % 4294967296) % 4294967296::ubigint") + ", hi)")
    steps = " + ".join(f"case when u >= {math.ceil(s * 2**32)} then 1 else 0 end" for s in E.POISSON_STEPS)
    return f"""seeds as (select *, sha256('boot:{seed}:' || cast(event_id as varchar)) as h from {rows}),
    halves as (select * exclude h, cast('0x' || substr(h, 1, 8) as ubigint) as lo, cast('0x' || substr(h, 9, 8) as ubigint) as hi from seeds),
    us as (select * exclude (lo, hi), {u} as u from halves, (select unnest(range(0, {runs}))::ubigint as draw)),
    ws as (select * exclude (u, draw), draw::bigint as draw, {steps} as w from us union all by name select * exclude (lo, hi), -1 as draw, 1 as w from halves)"""


# one confounder beside the treatment: the two coefficients have a closed form
FIT_SQL = """fit as (select event_id, coalesce(c2, (select quantile_disc(c2, 0.5) from pc where drug is not null and next_y is not null)) as x, drug as t, next_y as y, q
  from pc where drug is not null and next_y is not null)"""
REFIT_SQL = """sums as (select draw, sum(w) as n, sum(w * x) / sum(w) as mx, sum(w * t) / sum(w) as mt, sum(w * y) / sum(w) as my from ws group by 1),
moments as (select draw, sum(w * (x - mx) * (x - mx)) as xx, sum(w * (t - mt) * (t - mt)) as tt, sum(w * (x - mx) * (t - mt)) as xt, sum(w * (x - mx) * (y - my)) as xy, sum(w * (t - mt) * (y - my)) as ty
  from ws join sums using (draw) group by 1),
coefs as (select draw, mx, mt, my, (xy * tt - ty * xt) / (xx * tt - xt * xt) as bx, (ty * xx - xy * xt) / (xx * tt - xt * xt) as bt from moments join sums using (draw)),
bs as (select draw, sum(w * (bt + t / q * (y - (my + bx * (x - mx) + bt * (1 - mt))) - (1 - t) / (1 - q) * (y - (my + bx * (x - mx) - bt * mt)))) / sum(w) as estimate
  from ws join coefs using (draw) group by 1)"""
FIXED_SQL = "bs as (select draw, sum(w * psi) / nullif(sum(w), 0) as estimate from ws group by 1)"
EFFECT = "(select estimate from bs where draw = -1)"
CUTS = {k: f"(select quantile_cont(estimate, {v}) from bs where draw >= 0)" for k, v in (("ci_lower", 0.025), ("ci_upper", 0.975))}
INTERVAL_SQL = f"select {r6(EFFECT, 'effect', 5)}, " + ", ".join(r6(v, k, 5) for k, v in CUTS.items())


@query("bootstrap_effect", "A40", with_(EV_SQL, RX_SQL, FIT_SQL, _boot_sql("fit", 500, 42), REFIT_SQL, select=INTERVAL_SQL), digits=5)
def bootstrap_effect(t):
    return E.bootstrap_interval(rx(t), "event_id", "drug", "next_y", "p", ["c2"], runs=500)


@query("bootstrap_given_models", "A40", with_(EV_SQL, RX_SQL, PSI_SQL, _boot_sql("psi", 500, 42), FIXED_SQL, select=INTERVAL_SQL), digits=5)
def bootstrap_given_models(t):
    return E.fixed_model_interval(rx(t), "event_id", "drug", "next_y", "p", "mu1", "mu0", runs=500)


@query("effect_driver", "A41 A36 A37 A39 A40 F39", with_(EV_SQL, RX_SQL, FIT_SQL, _boot_sql("fit", 500, 7), REFIT_SQL, select=f"""
, one as (select 'drug' as treatment, 'next_y' as outcome, sum(t) as n_treated, sum(1 - t) as n_control, avg(case when p < 0.1 or p > 0.9 then 1.0 else 0.0 end) as share_outside,
   (select avg(next_y) filter (drug = 1) - avg(next_y) filter (drug = 0) from pc where drug is not null and next_y is not null) as naive,
   {EFFECT} as effect, {CUTS['ci_lower']} as ci_lower, {CUTS['ci_upper']} as ci_upper from pc)
select treatment, outcome, {n8('n_treated', 'n_treated')}, {n8('n_control', 'n_control')}, {r6('share_outside', 'share_outside', 5)}, {r6('naive', 'naive', 5)}, {r6('effect', 'effect', 5)},
  {r6('ci_lower', 'ci_lower', 5)}, {r6('ci_upper', 'ci_upper', 5)}, x as expected, case when (case when effect > 0 then 'up' else 'down' end) = x then 'correct' else 'wrong' end as verdict
from one, (values ('up'), ('down')) v(x)"""), digits=5)
def effect_driver(t):
    return E.effect_table([
        E.effect_row(rx(t), "event_id", "drug", "next_y", "p", ["c2"], x, runs=500, seed=7) for x in ("up", "down")])


@query("effect_compare", "J26", with_(EV_SQL, RX_SQL, PSI_SQL, select=f"""
, a as (select 'drug' as treatment, 'y' as outcome, (select avg(psi) from psi) as e union all select 'other', 'y', (select avg(next_y) filter (other = 1) - avg(next_y) filter (other = 0) from pc)),
b as (select 'drug' as treatment, 'y' as outcome, (select avg(next_y) filter (drug = 1) - avg(next_y) filter (drug = 0) from pc where next_y is not null) as e)
select a.treatment, a.outcome, {r6('a.e', 'population')}, {r6('b.e', 'by_row')}, {n8('coalesce(case when sign(a.e) = sign(b.e) then 1 else 0 end, 0)', 'same_sign')} from a left join b using (treatment, outcome)"""))
def effect_compare(t):
    rows = rx(t)

    def tagged(df, name):
        return df.select(F.lit(name).alias("treatment"), F.lit("y").alias("outcome"), F.col(df.columns[0]).alias("effect"))

    a = tagged(E.doubly_robust_effect(rows, "drug", "next_y", "p", "mu1", "mu0"), "drug").unionByName(tagged(E.naive_effect(rows, "other", "next_y"), "other"))
    return J.effect_comparison(a, tagged(E.naive_effect(rows, "drug", "next_y"), "drug"), "population", "by_row")
