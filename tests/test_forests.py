"""Boosted forests against a plain search and against themselves in other forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodia.operators import forests as R
from episodia.operators import models as M


def plain_trees(bins, y, logistic, trees, depth, rate, least, n_bins):
    """Margins after boosting with an exhaustive search in numpy."""
    m = y.mean()
    s = np.full(len(y), np.log(m / (1 - m)) if logistic else m)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-s)) if logistic else s
        g, h = p - y, p * (1 - p) if logistic else np.ones(len(y))

        def grow(rows, level):
            best = None
            if level < depth:
                for j in range(bins.shape[1]):
                    for b in range(n_bins):
                        left = bins[rows, j] <= b
                        if left.sum() < least or (~left).sum() < least:
                            continue
                        a, c = rows[left], rows[~left]
                        gain = g[a].sum() ** 2 / h[a].sum() + g[c].sum() ** 2 / h[c].sum() - g[rows].sum() ** 2 / h[rows].sum()
                        if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                            best = (gain, a, c)
            if best is None:
                s[rows] -= rate * g[rows].sum() / h[rows].sum()
            else:
                grow(best[1], level + 1)
                grow(best[2], level + 1)

        grow(np.arange(len(y)), 0)
    return s


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    n = 600
    a, b, u = rng.normal(size=n), rng.integers(0, 6, n).astype(float), rng.integers(0, 2, n).astype(float)
    a[rng.uniform(size=n) < 0.1] = np.nan
    y = np.nan_to_num(a) * 2 + (b > 2) * u + rng.normal(scale=0.3, size=n)
    z = (rng.uniform(size=n) < 1 / (1 + np.exp(-y))).astype(float)
    rows = [(i, None if np.isnan(a[i]) else float(a[i]), float(b[i]), float(u[i]), float(y[i]), float(z[i])) for i in range(n)]
    rows += [(n + i, 1.0, 1.0, 1.0, None, None) for i in range(5)]
    return spark.createDataFrame(rows, "id long, a double, b double, u double, y double, z double").repartition(4).cache(), y, z


@pytest.mark.parametrize("direct", [True, False])
def test_forests_equal_the_plain_search(table, monkeypatch, direct):
    df, y, z = table
    monkeypatch.setattr(R, "KEEP", 2)
    if not direct:
        monkeypatch.setattr(R, "DIRECT_CELLS", 0)
    fits = R.fit_forests(df, ["a", "b", "u"], {"y": False, "z": True}, trees=5, depth=3, rate=0.3, bins=16, least_rows=10)
    got = df.filter("y is not null").orderBy("id").select("a", "b", "u", fits["y"].column().alias("y"), fits["z"].column().alias("z")).toPandas()
    bins = fits["y"].binned([got[c] for c in ("a", "b", "u")])
    n_bins = max(len(c) for c in fits["y"].cuts) + 2
    assert np.allclose(got.y, plain_trees(bins, y, False, 5, 3, 0.3, 10, n_bins))
    assert np.allclose(got.z, 1 / (1 + np.exp(-plain_trees(bins, z, True, 5, 3, 0.3, 10, n_bins))))
    assert sum(fits["y"].importances().values()) == pytest.approx(1.0)


def test_all_settings_equal_single_overrides(table):
    df, *_ = table
    f = R.fit_forests(df, ["a", "b", "u"], {"y": False}, trees=4, depth=3, least_rows=5)["y"]
    one = [f.column({"u": F.lit(float(c & 1)), "b": F.lit(float(c >> 1))}).alias(f"v{c}") for c in range(4)]
    rows = R.best_flags(df.select("*", f.over_flags(["u", "b"]).alias("all"), *one), f, ["u", "b"], "code", "top").collect()
    for r in rows:
        values = [r[f"v{c}"] for c in range(4)]
        assert r["all"] == values and r["top"] == max(values) and r["code"] == values.index(max(values))
        assert (r["best_u"], r["best_b"]) == (r["code"] & 1, r["code"] >> 1)


def test_forest_of_no_rows_and_of_one_value(table):
    df, *_ = table
    f = R.fit_forests(df.filter("1 = 0"), ["a", "b"], {"y": False, "z": True}, trees=2, depth=2)
    assert df.limit(3).select(f["y"].column().alias("p")).distinct().collect()[0].p == 0.0
    same = R.fit_forests(df.withColumn("y", F.lit(3.0)), ["a"], {"y": False}, trees=2, depth=2)["y"]
    assert {r.p for r in df.select(same.column().alias("p")).collect()} == {3.0}
    assert df.filter("1 = 0").select(same.over_flags(["a"])).count() == 0


def test_bounds_and_balance(table):
    df, y, z = table
    f = R.fit_forests(df, ["a", "b", "u"], {"y": False}, trees=10, depth=3, rate=0.5, bounds={"y": (-0.5, 0.5)})["y"]
    got = df.agg(F.min(f.column()), F.max(f.column())).first()
    assert got[0] == -0.5 and got[1] == 0.5
    rare = df.withColumn("z", (F.col("id") % 20 == 0).cast("int"))
    b = R.fit_forests(rare, ["a", "b", "u"], {"z": True}, trees=3, depth=2, balanced=True)["z"]
    assert abs(rare.agg(F.avg(b.column())).first()[0] - 0.5) < 0.1


def test_fitted_q_over_two_flags_finds_the_best_setting(spark):
    rows = [(float(i % 5), i % 2, i // 2 % 2, float(i % 2 - 2 * (i // 2 % 2)), int(i % 7 == 0), float((i + 1) % 5)) for i in range(800)]
    df = spark.createDataFrame(rows, "s double, u int, v int, r double, done int, next_s double")
    q = M.fitted_q_flags(df, ["s"], ["u", "v"], "r", "done", iterations=3, trees=20, depth=3, rate=0.3)
    assert {r.code for r in R.best_flags(df, q, ["u", "v"], "code").select("code").distinct().collect()} == {1}
    backed = M.q_backup_flags(df, q, ["s"], ["u", "v"], "r", "done", 0.9).collect()
    best = {r.s: r.m for r in df.select("s", F.array_max(q.over_flags(["u", "v"])).alias("m")).distinct().collect()}
    assert all(np.isclose(r["_target"], r.r + (0 if r.done else 0.9 * best[r.next_s])) for r in backed)


def test_policy_with_a_forest_risk_equals_every_combination(table):
    df, *_ = table
    risk = R.fit_forests(df, ["a", "b"], {"z": True}, trees=4, depth=3)["z"]
    rows = df.withColumns({"d1": F.col("u"), "d2": F.lit(0), "base_a": F.col("a"), "base_b": F.col("b")})
    effects = {("d1", "a"): 0.7, ("d2", "b"): -1.5}
    got = {r.id: r for r in M.exhaustive_policy(rows, ["id"], ["d1", "d2"], effects, {"a": "base_a", "b": "base_b"}, risk).collect()}
    data = df.select("id", "a", "b").toPandas()
    moved = [risk.predicted(risk.binned([data.a + 0.7 * (c & 1), data.b - 1.5 * (c >> 1)])) for c in range(4)]
    for i, key in enumerate(data.id):
        values = [m[i] for m in moved]
        assert got[key].action == int(np.argmin(values)) and np.isclose(got[key].policy_risk, min(values))


def test_fitted_q_equals_rounds_over_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 700
    s, u, v = np.round(rng.normal(size=n), 1), rng.integers(0, 2, n), rng.integers(0, 2, n)
    rows = [(None if i % 11 == 0 else float(s[i]), int(u[i]), int(v[i]), None if i % 50 == 1 else float(np.nan if i % 50 == 2 else s[i] * (u[i] - v[i]) + rng.normal(scale=0.1)),
             None if i % 40 == 3 else int(i % 9 == 0), None if i % 13 == 0 else float(s[(i + 1) % n])) for i in range(n)]
    rows += rows[:60]
    df = spark.createDataFrame(rows, "s double, u int, v int, r double, done int, next_s double").repartition(3).cache()
    options = dict(trees=6, depth=3, rate=0.3, least_rows=10)
    want, cuts = None, R.quantile_cuts(df, ["s", "u", "v"], 64)
    for _ in range(3):
        backed = M.q_backup_flags(df, want, ["s"], ["u", "v"], "r", "done", 0.9, name="y")
        want = R.fit_forests(backed, ["s", "u", "v"], {"y": False}, cuts=cuts, **options)["y"]
    bins = rng.integers(0, 20, (200, 3)).astype(np.int16)
    for rows_at_once in (R.WHOLE_ROWS, 0):
        monkeypatch.setattr(R, "WHOLE_ROWS", rows_at_once)
        got = M.fitted_q_flags(df, ["s"], ["u", "v"], "r", "done", iterations=3, gamma=0.9, **options)
        assert len(got.value) == 6 and np.allclose(got.predicted(bins), want.predicted(bins)) and np.allclose(got.gains, want.gains)
    monkeypatch.undo()
    assert M.fitted_q_flags(df.filter("1 = 0"), ["s"], ["u", "v"], "r", "done", iterations=2, trees=2, depth=2).predicted(bins).tolist() == [0.0] * 200


def test_behaviour_policy_has_all_rounds_and_trees(spark, monkeypatch):
    from episodia.catalog import model_queries as Q

    class Enough(Exception):
        pass

    def grown(state, features, cuts, target, **options):
        size.update(options)
        rounds.append(state.count())
        if len(rounds) == 10:
            raise Enough
        return R.Forest(list(features), cuts, 0.0, 1, feature=[np.array([-1, -1, -1])], cut=[np.zeros(3, int)], value=[np.zeros(3)])

    rounds, size = [], {}
    rows = [(i, i % 4, float(i % 3), float(i % 5), None, i % 2, 0, 0, 1, 1, i % 4, 0.5, int(i == 9), "train", 1.0, 2.0, None) for i in range(10)]
    df = spark.createDataFrame(rows, "user_id int, bin int, hb double, bun double, cr double, vaso int, fluid int, vent int, test_hb int, test_bun int, a5 int, r double, done int, split string, next_hb double, next_bun double, next_cr double")
    monkeypatch.setattr(Q, "steps", lambda t: df)
    monkeypatch.setattr(M, "fit_action_policy", lambda *a, **o: None)
    monkeypatch.setattr(M, "fit_whole", grown)
    with pytest.raises(Enough):
        Q.behaviour_policy(None)
    assert size == {"trees": 300, "depth": 6} and rounds == [rounds[0]] * 10
