"""Model queries: fitted with Spark ML, checked by row counts and by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodia.catalog.registry import query
from episodia.catalog.roles import EV_SQL, LATE_SQL, PANEL_SQL, ev, panel, r6, with_
from episodia.functions import scalars as S
from episodia.operators import effects as E
from episodia.operators import models as M
from episodia.operators.forests import best_flags, fit_forests
from episodia.operators.metrics import binary_metrics, feature_errors, regression_metrics
from episodia.operators.moments import moments, ridge_left_out
from episodia.operators.sampling import hash_split
from episodia.operators.sequences import next_state
from episodia.session import durable

STATES = ["hb", "bun", "cr"]
ACTIONS = ["vaso", "fluid", "vent"]
# with the two kinds of readings as orders of their own, five flags make 32 actions
FLAGS = [*ACTIONS, "test_hb", "test_bun"]
#: of the boosted trees registered here; README has the times of the sizes of a study
TREES = {"trees": 20, "depth": 6}


def steps(t):
    """One-step rows of the binned panel, written once because models reread them."""
    rows = next_state(panel(t), ["user_id"], ["bin"], [*STATES, *ACTIONS])
    rows = rows.withColumns({
        "key": S.composite_key("user_id", "bin"), "a": S.encode_bits(ACTIONS), "r": F.coalesce(F.col("hb") / 100, F.lit(0.0)),
        "bad_end": (F.col("user_id") % 5 == 0).cast("int"), "test_hb": F.col("hb").isNotNull().cast("int"), "test_bun": F.col("bun").isNotNull().cast("int"),
    })
    rows = rows.withColumn("a5", S.encode_bits(FLAGS))
    return durable(hash_split(rows, "user_id"))


@query("propensity_fit", "M1 M2 M3 A36 A38 A39")
def propensity_fit(t):
    rows = steps(t)
    train, test = rows.filter("split = 'train'"), rows.filter("split != 'train'")
    models = M.fit_propensities(train, ["vaso", "fluid"], [*STATES, *ACTIONS])
    parts = []
    for drug in models:
        scored = M.score_propensities(test, models)
        outcome = M.fit_linear(test, [*STATES, *ACTIONS], "next_bun")
        both = M.potential_outcomes(scored, outcome, drug)
        row = E.overlap_summary(both, drug, f"p_{drug}").select("treatment", "n_treated", "n_control", "share_outside")
        parts.append(row.select(
            "*", E.weighted_effect(both, drug, "next_bun", f"p_{drug}").scalar().alias("ipw"),
            E.doubly_robust_effect(both, drug, "next_bun", f"p_{drug}", "mu1", "mu0").scalar().alias("aipw")))
    return E.effect_table(parts)


@query("effect_study", "A41 A40 M1 M2 M3 J26")
def effect_study(t):
    from episodia.plans.effects import estimate_effects
    rows = steps(t)
    pairs = [("vaso", "bun", "up"), ("fluid", "hb", "down")]
    return estimate_effects(rows.filter("split = 'train'"), rows.filter("split != 'train'"), "key", pairs, [*STATES, *ACTIONS], runs=500)


@query("next_state_models", "M4 M5 A28 A30")
def next_state_models(t):
    rows = steps(t).withColumn("done_next", F.col("done"))
    train, test = rows.filter("split = 'train'"), rows.filter("split != 'train'")
    scored = M.fit_next_state(train, [*STATES, *ACTIONS], STATES, ACTIONS, **TREES).predict(test)
    return feature_errors(scored, [(f"next_{s}", f"pred_{s}") for s in [*STATES, *ACTIONS]])


@query("risk_model", "M6 M8 A30")
def risk_model(t):
    rows = steps(t)
    model = fit_forests(rows.filter("split = 'train'"), [*STATES, *ACTIONS], {"bad_end": True}, balanced=True, **TREES)["bad_end"]
    return binary_metrics(model.score(rows.filter("split != 'train'"), "p"), "bad_end", "p")


@query("terminal_model", "M8 M10 P12")
def terminal_model(t):
    ends = steps(t).filter("done = 1")
    return M.variable_ranking(ends, [*STATES, *ACTIONS], "bad_end", **TREES)


@query("severity_surrogate", "M7 A28 A29")
def severity_surrogate(t):
    rows = steps(t).withColumn("severity", F.coalesce("hb", F.lit(0.0)) * 0.3 + F.coalesce("bun", F.lit(0.0)) * 0.2 + F.col("vaso"))
    model, alpha = ridge_left_out(rows.filter("split = 'train'"), [*STATES, *ACTIONS], "severity", [0.01, 0.1, 1.0, 10.0, 100.0])
    return regression_metrics(rows.filter("split = 'test'").withColumn("p", model.column()), "severity", "p").withColumn("alpha", F.lit(alpha))


def masked(train):
    allowed = {"hb": ["vaso", "fluid"], "bun": ["vent"], "cr": ACTIONS}
    return M.fit_masked_linear(train, STATES, ACTIONS, allowed)


@query("masked_linear_model", "M9 A31")
def masked_linear_model(t):
    rows = steps(t)
    model = masked(rows.filter("split = 'train'"))
    scored = model.predict(rows.filter("split != 'train'"))
    return feature_errors(scored, [(f"next_{s}", f"pred_{s}") for s in STATES])


@query("transition_responsiveness", "M11 A51 W22 T9")
def transition_responsiveness(t):
    from episodia.operators.aggregates import importance_share
    rows = steps(t)
    train = rows.filter("split = 'train'")
    fits = fit_forests(train, [*STATES, *ACTIONS], {f"next_{s}": False for s in STATES}, **TREES)
    out = importance_share(M.importance_table(t.spark, fits), "target", "feature", "importance", ACTIONS)
    return out.withColumn("responsive", (F.col("group_share") >= 0.05).cast("int"))


@query("behaviour_policy", "M12 A47 M13")
def behaviour_policy(t):
    from episodia.operators.policy_value import doubly_robust_summary, doubly_robust_values
    from episodia.operators.sequences import row_number_in
    rows = steps(t)
    train, test = rows.filter("split = 'train'"), rows.filter("split != 'train'")
    policy = M.fit_action_policy(train, STATES, "a5", 32)
    # by Q the best setting is followed; the reward model has the logged one
    q = M.fitted_q_flags(train, STATES, FLAGS, "r", "done", iterations=10, trees=300, depth=6)
    reward = fit_forests(train, [*STATES, *FLAGS], {"r": False}, **TREES)["r"]
    scored = best_flags(test.withColumns({"pi": policy.of_action("a5"), "rhat": reward.column()}), q, FLAGS, "b", "q")
    placed = row_number_in(scored, ["user_id"], ["bin"], "t", 0)
    return doubly_robust_summary(doubly_robust_values(placed, ["user_id"], "t", "a5", "b", "r", "pi", "q", "rhat"))


@query("action_sensitivity", "M14")
def action_sensitivity(t):
    rows = steps(t)
    train = rows.filter("split = 'train'")
    models = {s: M.fit_linear(train, [*STATES, *ACTIONS], f"next_{s}") for s in STATES}
    models |= {f"trees_{k}": m for k, m in fit_forests(train, [*STATES, *ACTIONS], {f"next_{s}": False for s in STATES}, **TREES).items()}
    return M.action_sensitivity(rows.filter("split = 'test'"), models, ACTIONS)


@query("policy_search", "M15 J23 F40 T4 A44")
def policy_search(t):
    from episodia.operators.policy_value import strategy_comparison
    from episodia.plans.policies import score_policies
    rows = steps(t)
    train, test = rows.filter("split = 'train'"), rows.filter("split != 'train'")
    base = {s: M.fit_linear(train, [*STATES, *ACTIONS], f"next_{s}") for s in STATES}
    risk = M.fit_logistic(train, STATES, "bad_end", balanced=True)
    effects = {("vaso", "bun"): 1.5, ("fluid", "hb"): -2.0, ("vent", "cr"): 0.75}
    return strategy_comparison(score_policies(test, ["user_id", "bin"], ACTIONS, base, risk, effects), "policy_risk", "nothing_risk", "observed_risk")


@query("tree_policy_search", "M15 J23 F40 T4")
def tree_policy_search(t):
    """States and risk from forests; 32 combinations of five drugs in each row."""
    from episodia.operators.policy_value import strategy_comparison
    from episodia.plans.policies import score_policies
    rows = steps(t)
    train, test = rows.filter("split = 'train'"), rows.filter("split != 'train'")
    fits = fit_forests(train, [*STATES, *FLAGS], {f"next_{s}": False for s in STATES}, **TREES)
    risk = fit_forests(train, STATES, {"bad_end": True}, balanced=True, **TREES)["bad_end"]
    effects = {("vaso", "bun"): 1.5, ("fluid", "hb"): -2.0, ("vent", "cr"): 0.75, ("test_hb", "hb"): 0.5, ("test_bun", "bun"): -1.0}
    scored = score_policies(test, ["user_id", "bin"], FLAGS, {s: fits[f"next_{s}"] for s in STATES}, risk, effects)
    return strategy_comparison(scored, "policy_risk", "nothing_risk", "observed_risk")


@query("row_effects", "M16 J26")
def row_effects(t):
    rows = steps(t)
    found = M.row_effects(rows.filter("split = 'train'"), "key", "vaso", "next_bun", [*STATES, "fluid", "vent"])
    return M.row_effect_summary(found, "vaso", "bun")


@query("fitted_q", "M17 T4 A45")
def fitted_q(t):
    from episodia.operators.policy_value import action_agreement
    rows = steps(t)
    q = M.fitted_q_flags(rows.filter("split = 'train'"), STATES, FLAGS, "r", "done", iterations=10, trees=10, depth=4)
    return action_agreement(best_flags(rows.filter("split = 'test'"), q, FLAGS, "best_action"), "a5", "best_action")


@query("counterfactual_sweep", "M18 J23")
def counterfactual_sweep(t):
    rows = steps(t)
    swept = M.counterfactual_sweep(rows.filter("split = 'test'"), masked(rows.filter("split = 'train'")), ACTIONS)
    return swept.groupBy("action").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"pred_{c}").alias(f"mean_{c}") for c in [*STATES, "done"]])


@query("stability_selection", "M19 A49 T14")
def stability_selection(t):
    from episodia.operators.aggregates import episode_summary
    from episodia.operators.graphs import stability
    e = episode_summary(panel(t), ["user_id"], ["bin"], first=STATES, delta=STATES, fraction=ACTIONS)
    runs = M.stability_runs(e, "user_id", [f"frac_{a}" for a in ACTIONS], [f"delta_{s}" for s in STATES], [f"first_{s}" for s in STATES], 4000, 0.6)
    return stability(runs, ["drug", "delta"])


@query("similar_row_fill", "M20 A56")
def similar_row_fill(t):
    from episodia.operators.aggregates import fill_gain
    rows = durable(panel(t).select("user_id", "bin", *STATES))
    return fill_gain(rows, M.imputed_from_similar(rows, STATES), STATES)


@query("nearest_row_fill", "M20 A56")
def nearest_row_fill(t):
    from episodia.operators.aggregates import fill_gain
    from episodia.operators.neighbours import filled_from_nearest
    rows = durable(panel(t).select("user_id", "bin", *STATES, *ACTIONS))
    return fill_gain(rows, filled_from_nearest(rows, [*STATES, *ACTIONS]), STATES)


@query("least_squares_effect", "M3 A39", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
, s as (select *, lead(bun) over (partition by user_id order by bin) as y from panel),
k as (select regr_slope(y, vaso) as b, regr_intercept(y, vaso) as a, corr(y, vaso) as c from s where y is not null)
select {r6('a', 'mu0', 5)}, {r6('a + b', 'mu1', 5)} from k"""), digits=5)
def least_squares_effect(t):
    rows = next_state(panel(t), ["user_id"], ["bin"], ["bun"]).select("vaso", "next_bun")
    model = M.fit_linear(durable(rows), ["vaso"], "next_bun")
    return M.potential_outcomes(rows.groupBy().agg(F.max("vaso").alias("vaso")), model, "vaso").select("mu0", "mu1")


def _split_sql(source: str, nodes: str) -> str:
    """The best split of every node of ``source`` (target, node, g, h, f0, f1, f2) as ``nodes``."""
    return f"""{nodes}_values as (select target, node, feature, v, sum(g) as g, sum(h) as h, count(*) as n
    from (select target, node, g, h, unnest([0, 1, 2]) as feature, unnest([f0, f1, f2]) as v from {source}) group by all),
  {nodes}_sides as (select *, sum(g) over w as gl, sum(h) over w as hl, sum(n) over w as nl, sum(g) over p as ga, sum(h) over p as ha, sum(n) over p as na
    from {nodes}_values window w as (partition by target, node, feature order by v), p as (partition by target, node, feature)),
  {nodes} as (select target, node, feature, v as cut, -gl / hl as below, -(ga - gl) / (ha - hl) as above from {nodes}_sides where nl >= 20 and na - nl >= 20
    qualify row_number() over (partition by target, node order by gl * gl / hl + (ga - gl) * (ga - gl) / (ha - hl) desc, feature, v) = 1)"""


@query("two_level_trees", "M4 M6", f"""
with x as (select l_linenumber::double as f0, round(l_discount * 100) as f1, l_quantity::double as f2, l_extendedprice::double / 1000 as price,
    case when l_linenumber < 7 then case when l_returnflag = 'R' then 1.0 else 0.0 end end as returned from lineitem),
  m as (select avg(price) as mp, avg(returned) as mr from x),
  root as (select 'price' as target, 0 as node, mp - price as g, 1.0::double as h, f0, f1, f2 from x, m where price is not null
    union all select 'returned', 0, mr - returned, mr * (1 - mr), f0, f1, f2 from x, m where returned is not null),
  {_split_sql('root', 'top')},
  halves as (select r.target, case when (case feature when 0 then f0 when 1 then f1 else f2 end) <= cut then 1 else 2 end as node, g, h, f0, f1, f2 from root r join top using (target)),
  {_split_sql('halves', 'low')}
select target, node::bigint as node, feature::bigint as feature, {r6('cut', 'cut')}, {r6('below', 'below', 5)}, {r6('above', 'above', 5)} from (from top union all from low)""", digits=5)
def two_level_trees(t):
    rows = t.lineitem.select(
        F.col("l_linenumber").cast("double").alias("f0"), F.round(F.col("l_discount") * 100).alias("f1"), F.col("l_quantity").cast("double").alias("f2"),
        (F.col("l_extendedprice").cast("double") / 1000).alias("price"), F.when(F.col("l_linenumber") < 7, (F.col("l_returnflag") == "R").cast("double")).alias("returned"))
    fits = fit_forests(rows, ["f0", "f1", "f2"], {"price": False, "returned": True}, trees=1, depth=2, rate=1.0)
    out = []
    for name, f in fits.items():
        feature, cut, value = f.feature[0], f.cut[0], f.value[0]
        out += [(name, n, int(feature[n]), float(f.cuts[feature[n]][cut[n] - 1]), float(value[2 * n + 1]), float(value[2 * n + 2])) for n in range(3) if feature[n] >= 0]
    return t.spark.createDataFrame(out, "target string, node int, feature int, cut double, below double, above double")


@query("ridge_path", "M7 M9", f"""
with x as (select l_quantity as q, l_extendedprice as y, case when l_orderkey % 5 = 0 then 'v' else 't' end as part from lineitem),
  t as (select any_value(mq) as mq, any_value(my) as my, sum((q - mq) * (q - mq)) as xx, sum((q - mq) * (y - my)) as xy from (select q, y, avg(q) over () as mq, avg(y) over () as my from x where part = 't')),
  w as (select a, xy / (xx + a) as slope, my - xy / (xx + a) * mq as intercept from t, (select unnest([1000.0, 1000000.0, 1000000000.0])::double as a)),
  e as (select a, any_value(slope) as slope, any_value(intercept) as intercept, avg((y - intercept - slope * q) * (y - intercept - slope * q)) as error from w, x where part = 'v' group by a)
select a as alpha, {r6('slope', 'slope', 3)}, {r6('intercept', 'intercept', 3)}, {r6('sqrt(error)', 'error', 3)} from e""", digits=3)
def ridge_path(t):
    m = moments(t.lineitem.select("*", F.when(F.col("l_orderkey") % 5 == 0, "v").otherwise("t").alias("part")), ["l_quantity"], ["l_extendedprice"], F.col("part"), ["t"])
    path = m.path("l_extendedprice", [1e3, 1e6, 1e9], ["t"], ["v"])
    return t.spark.createDataFrame([(a, f.weights[0], f.intercept, e ** 0.5) for a, f, e in path], "alpha double, slope double, intercept double, error double")
