"""Fitted models against numpy on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodia.operators import effects as E
from episodia.operators import graphs as G
from episodia.operators import models as M
from episodia.plans.effects import balance_study, estimate_effects


@pytest.fixture(scope="module")
def study(spark):
    """Treatment depends on x; the true effect is 2 for z = 0 and 4 for z = 1."""
    rng = np.random.default_rng(1)
    n = 4000
    x, z = rng.normal(size=n), rng.integers(0, 2, n)
    t = (rng.uniform(size=n) < 1 / (1 + np.exp(-x))).astype(int)
    y = 1 + 3 * x + (2 + 2 * z) * t + rng.normal(scale=0.5, size=n)
    rows = [(i, float(x[i]), float(z[i]), int(t[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, z double, t int, next_y double").cache(), x, z, t, y


def test_least_squares_and_ridge(study):
    df, x, z, t, y = study
    X = np.column_stack([np.ones(len(x)), x, z, t])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    m = M.fit_linear(df, ["x", "z", "t"], "next_y")
    assert np.allclose([m.intercept, *m.weights], beta, atol=1e-6)
    alpha = 50.0
    Xc, yc = X[:, 1:] - X[:, 1:].mean(0), y - y.mean()
    ridge = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(3), Xc.T @ yc)
    assert np.allclose(M.fit_linear(df, ["x", "z", "t"], "next_y", alpha).weights, ridge, atol=1e-4)


def test_logistic_gradient_is_zero(study):
    df, x, z, t, _ = study
    m = M.fit_logistic(df, ["x", "z"], "t")
    p = 1 / (1 + np.exp(-(m.intercept + m.weights[0] * x + m.weights[1] * z)))
    assert np.allclose([np.mean(p - t), np.mean((p - t) * x), np.mean((p - t) * z)], 0, atol=1e-4)
    got = np.array([r.p for r in df.orderBy("id").select(m.column().alias("p")).collect()])
    assert np.allclose(got, p)


def test_doubly_robust_effect_recovers_the_truth(study):
    df, *_ = study
    r = estimate_effects(df, df, "id", [("t", "y", "up")], ["x", "z"], runs=2000).first()  # the bounds of 100 draws vary by 0.006
    assert r.naive > 4 and abs(r.effect - 3) < 0.1
    assert r.ci_lower < 3 < r.ci_upper and r.ci_upper - r.ci_lower < 0.4
    assert r.verdict == "correct"


def test_weighting_improves_balance(study):
    df, *_ = study
    table = balance_study(df, df, ["t"], ["x", "z"])
    s = E.balance_summary(table).first()
    assert s.improved == 1 and s.mean_weighted < 0.05


def test_bootstrap_weights_are_poisson(spark):
    df = spark.range(3000).select("id", F.lit(1.0).alias("one"))
    draws = E.bootstrap_draws(df.withColumn("v", (F.col("id") % 2).cast("double")), "id", "v", 64, 3).collect()
    assert [r.estimate for r in draws if r.draw == -1] == [0.5]
    est = np.array([r.estimate for r in draws if r.draw >= 0])
    assert len(est) == 64 and abs(est.mean() - 0.5) < 0.01
    assert abs(est.std() - 0.5 / np.sqrt(3000)) < 0.003


def test_refitted_draws_equal_a_fit_for_each_resample(spark):
    rng = np.random.default_rng(4)
    n = 300
    x, t = rng.normal(size=n), rng.integers(0, 2, n)
    z = np.where(rng.uniform(size=n) < 0.2, np.nan, rng.normal(size=n))
    p, y = rng.uniform(0.0, 1.0, n), 1 + x + 2 * t + rng.normal(size=n)
    rows = [(i, float(x[i]), None if np.isnan(z[i]) else float(z[i]), int(t[i]), float(p[i]), float(y[i])) for i in range(n)]
    rows += [(n, 1.0, 1.0, None, 0.5, 1.0), (n + 1, 1.0, 1.0, 1, 0.5, None), (n + 2, 1.0, 1.0, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, z double, t int, p double, y double").repartition(3)
    # one confounder is twice another, so no fit is unique
    df = df.withColumn("twice", 2 * F.col("x"))
    got = {r.draw: r.estimate for r in E.refitted_draws(df, "id", "t", "y", "p", ["x", "z", "twice"], 20, 9).collect()}
    numbers = {r["id"]: (r["_lo"], r["_hi"]) for r in df.select("id", *E.row_seed("id", 9)).collect()}
    lo, hi = np.array([numbers[i] for i in range(n)]).T
    weights = E.poisson_weights(lo, hi, 20)
    middle = np.sort(z[~np.isnan(z)])[(np.sum(~np.isnan(z)) - 1) // 2]
    zf, q = np.where(np.isnan(z), middle, z), np.clip(p, 0.01, 0.99)
    design = np.column_stack([np.ones(n), x, zf, 2 * x, t])
    for b, w in enumerate(weights):
        root = np.sqrt(w)
        beta = np.linalg.lstsq(design * root[:, None], y * root, rcond=None)[0]
        on, off = design.copy(), design.copy()
        on[:, -1], off[:, -1] = 1, 0
        psi = (on - off) @ beta + t / q * (y - on @ beta) - (1 - t) / (1 - q) * (y - off @ beta)
        assert np.isclose(got[b - 1], (w * psi).sum() / w.sum(), rtol=1e-7)
    assert len(got) == 21


def test_row_effects_find_the_modifier(study):
    df, _, z, *_ = study
    got = M.row_effects(df, "id", "t", "next_y", ["x", "z"]).groupBy("z").agg(F.avg("row_effect").alias("e")).collect()
    e = {r.z: r.e for r in got}
    assert abs(e[0.0] - 2) < 0.25 and abs(e[1.0] - 4) < 0.25


def test_action_policy_sums_to_one(study):
    df, *_ = study
    rows = df.withColumn("a", F.col("t") + 2 * F.col("z").cast("int"))
    p = M.fit_action_policy(rows, ["x", "z"], "a", 4)
    out = rows.select(p.probabilities().alias("p"), p.of_action("a").alias("pa"), "a").limit(50).collect()
    for r in out:
        assert abs(sum(r.p) - 1) < 1e-9 and abs(r.p[r.a] - r.pa) < 1e-12


def test_masked_model_ignores_what_is_not_allowed(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), int(u), int(v), float(a + u), float(b - v), int(i % 10 == 0))
            for i, (a, b, u, v) in enumerate(zip(rng.normal(size=500), rng.normal(size=500), rng.integers(0, 2, 500), rng.integers(0, 2, 500)))]
    df = spark.createDataFrame(rows, "a double, b double, u int, v int, next_a double, next_b double, done int")
    m = M.fit_masked_linear(df, ["a", "b"], ["u", "v"], {"a": ["u"], "b": ["v"]}, alpha=1e-6)
    assert m.scores["a"].features == ["a", "b", "u"] and np.allclose(m.scores["a"].weights, [1, 0, 1], atol=1e-3)
    assert m.residual_std["b"] < 1e-3
    swept = M.counterfactual_sweep(df.limit(3), m, ["u", "v"])
    assert swept.count() == 12


def test_fitted_q_prefers_the_better_action(spark):
    rows = [(float(i % 5), i % 2, float(i % 2), 1, float((i + 1) % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "s double, a int, r double, done int, next_s double")
    q = M.fitted_q(df, ["s"], "a", "r", "done", 2, iterations=2, trees=5, depth=2)
    assert {r.best_action for r in M.greedy_action(df, q, "a", 2).select("best_action").distinct().collect()} == {1}


def test_sensitivity_and_importance(study):
    df, *_ = study
    lin = M.fit_linear(df, ["x", "z", "t"], "next_y")
    row = M.action_sensitivity(df, {"y": lin}, ["t"]).first()
    assert abs(row.mean_diff - lin.weights[2]) < 1e-9 and row.std_diff < 1e-9 and row.share_affected == 1.0
    trees = M.fit_trees(df, ["x", "z"], "t", classifier=True, trees=3, depth=2)
    imp = trees.importances()
    assert abs(sum(imp.values()) - 1) < 1e-9 and imp["x"] > 0.8


def test_next_state_models_are_bounded(study):
    df, *_ = study
    rows = df.withColumns({"done_next": (F.col("id") % 9 == 0).cast("int"), "next_t": F.col("t")})
    m = M.fit_next_state(rows, ["x", "z", "t"], ["y"], ["t"], trees=3, depth=3)
    lo, hi = m.continuous["y"].bounds
    r = m.predict(rows).agg(F.min("pred_y").alias("a"), F.max("pred_y").alias("b"), F.max("pred_t").alias("c"), F.max("pred_done").alias("d")).first()
    assert lo <= r.a and r.b <= hi and r.c == 1 and 0 <= r.d <= 1


def test_stability_selection_finds_the_real_pair(spark):
    rng = np.random.default_rng(5)
    n = 600
    base, d1, d2 = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y1, y2 = 0.8 * d1 + 0.3 * base + rng.normal(scale=0.5, size=n), rng.normal(size=n)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(base, d1, d2, y1, y2))], "id long, base double, d1 double, d2 double, y1 double, y2 double")
    runs = M.stability_runs(df, "id", ["d1", "d2"], ["y1", "y2"], ["base"], 20, 0.6, n_base=1)
    got = {(r.drug, r.delta): r.freq_definite for r in G.stability(runs, ["drug", "delta"]).collect()}
    assert got[("d1", "y1")] == 1.0 and max(v for k, v in got.items() if k != ("d1", "y1")) < 0.5


def test_partial_correlation_by_regression(spark):
    rng = np.random.default_rng(6)
    b, d, y = rng.normal(size=300), rng.normal(size=300), rng.normal(size=300)
    d, y = d + b, y + b + 0.2 * d
    df = spark.createDataFrame([(i, float(b[i]), float(d[i]), float(y[i])) for i in range(300)], "id long, b double, d double, y double")
    r = M.stability_runs(df, "id", ["d"], ["y"], ["b"], 1, 1.1, n_base=1).first()
    res = [v - np.polyval(np.polyfit(b, v, 1), b) for v in (d, y)]
    assert abs(r.partial - np.corrcoef(*res)[0, 1]) < 1e-9


def test_similar_rows_fill_every_gap(spark):
    rows = [(float(i % 2) * 10, None if i % 7 == 0 else float(i % 2) * 100, None) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out = M.imputed_from_similar(df, ["a", "b", "c"], groups=2)
    assert out.filter("b is null").count() == 0 and out.filter("c is not null").count() == 0
    gap = out.filter("a = 10 and b != 100").count()
    assert gap == 0


def test_final_features_fill_and_score(spark):
    """Gaps are filled, and the scores follow the filled values."""
    from episodia.plans.icu import final_features

    fields = ["pao2", "fio2_1", "hr", "sysbp", "meanbp", "platelets", "total_bili", "gcs", "creatinine", "temp_c", "rr", "paco2", "wbc"]
    healthy = [95.0, 0.21, 80.0, 120.0, 85.0, 250.0, 0.8, 15.0, 0.9, 37.0, 16.0, 40.0, 8.0]
    rows = [(s, b, 400.0, 0, 0.0, *[None if (c == "hr" and s == 1 and b == 3) else v for c, v in zip(fields, healthy)])
            for s in range(1, 11) for b in range(8)]
    kinds = ", ".join(f"{c} double" for c in fields)
    df = spark.createDataFrame(rows, f"stay int, bin int, output_step double, mechvent int, max_dose_vaso double, {kinds}")
    out = final_features(df, fields, groups=2)
    assert out.count() == 80 and out.filter("hr is null").count() == 0
    late = out.filter("bin = 7").first()
    assert (late.sofa, late.sirs) == (0, 0) and abs(late.pao2_fio2 - 95 / 0.21) < 1e-9 and abs(late.shock_index - 80 / 120) < 1e-9
    # the first bin has only 400 ml in its day so far: three points for the kidney
    assert out.filter("bin = 0").first().sofa == 3


def test_the_flow_from_events_to_replay_rows(spark, small):
    from episodia.catalog.icu_flow import icu_replay
    from episodia.catalog.registry import Tables

    rows = icu_replay(Tables(spark, small)).toPandas()
    assert len(rows) > 50 and (rows.groupby("stay").done.sum() == 1).all() and set(rows.a) <= {0, 1, 2, 3}
    states = [c for c in rows if c.startswith("s_")]
    assert not rows[states].isna().any().any() and rows[states].abs().max().max() <= 5 and rows.r[rows.done == 1].isin([15, -15]).all()


def test_registered_runs_and_groups_are_full(spark, small, monkeypatch):
    from episodia.catalog import load_queries, model_queries

    seen = {}
    fill = model_queries.M.imputed_from_similar
    monkeypatch.setattr(model_queries.M, "imputed_from_similar", lambda df, columns, **options: seen.update(options) or fill(df, columns, **options))
    queries = load_queries()
    queries["similar_row_fill"].run(spark, small)
    assert "groups" not in seen  # the operator's own default
    assert max(r["n_runs_included"] for r in queries["stability_selection"].run(spark, small).collect()) > 30


def test_fits_from_sums_equal_spark_ml(study):
    from episodia.operators.moments import moments, ridge_left_out

    df, x, z, t, y = study
    df = df.withColumn("w", F.when(F.col("id") % 3 != 0, F.col("x") * F.col("t")))
    m = moments(df, ["x", "z", "t"], ["next_y", "w"], F.col("id") % 2)
    for label in ("next_y", "w"):
        for some in (["x", "z", "t"], ["x"], ["t", "z"]):
            for alpha, standardised in ((0.0, False), (50.0, False), (50.0, True)):
                a, b = m.fit(label, some, alpha, standardised), M.fit_linear(df, some, label, alpha, standardised)
                # the penalised fit of Spark ML scales the label by another spread, which shows in the fifth digit
                assert np.allclose([a.intercept, *a.weights], [b.intercept, *b.weights], atol=1e-4 if alpha else 1e-6)
    X = np.column_stack([x, z, t]) - np.column_stack([x, z, t]).mean(0)
    assert np.allclose(m.fit("next_y", alpha=50.0).weights, np.linalg.solve(X.T @ X + 50 * np.eye(3), X.T @ (y - y.mean())), atol=1e-9)
    scaled = np.diag(X.var(0, ddof=1))
    assert np.allclose(m.fit("next_y", alpha=50.0, standardised=True).weights, np.linalg.solve(X.T @ X + 50 * scaled, X.T @ (y - y.mean())), atol=1e-9)
    one = M.fit_linear(df.filter("id % 2 = 1"), ["x", "z", "t"], "next_y")
    assert np.allclose(m.fit("next_y", groups=["1"]).weights, one.weights, atol=1e-6)
    other = df.filter("id % 2 = 0").select(F.avg(F.pow(one.column() - F.col("next_y"), 2))).first()[0]
    path = m.path("next_y", [0.0, 10.0], ["1"], ["0"])
    assert np.isclose(path[0][2], other) and path[1][2] > path[0][2]
    # leaving a row out, by leaving each row out
    few = df.filter("id < 25").withColumn("z", F.when(F.col("id") != 4, F.col("z"))).cache()
    fill = np.sort(np.delete(z[:25], 4))[11]
    design = np.column_stack([x[:25], np.where(np.arange(25) == 4, fill, z[:25])])
    errors = []
    for alpha in (0.1, 5.0, 500.0):
        total = 0.0
        for i in range(25):
            rest = np.arange(25) != i
            c, b = design[rest].mean(0), y[:25][rest].mean()
            w = np.linalg.solve((design[rest] - c).T @ (design[rest] - c) + alpha * np.eye(2), (design[rest] - c).T @ (y[:25][rest] - b))
            total += (y[i] - b - (design[i] - c) @ w) ** 2
        errors.append(total / 25)
    from episodia.operators.moments import left_out_errors

    assert np.allclose(left_out_errors(few, moments(few, ["x", "z"], ["next_y"]), "next_y", [0.1, 5.0, 500.0]), errors)
    assert ridge_left_out(few, ["x", "z"], "next_y", [0.1, 5.0, 500.0])[1] == [0.1, 5.0, 500.0][int(np.argmin(errors))]
