"""Ordered columns are the same whether or not a key is cut into segments."""

import random

import pytest
from pyspark.sql import functions as F

from episodia.operators import joins as J
from episodia.operators import metrics as M
from episodia.operators import sampling as T
from episodia.operators import sequences as W
from episodia.operators.aggregates import exact_quantiles
from episodia.operators.policy_value import backward_fold
from episodia.operators.scan import (
    Following, History, LastSeen, NextSeen, Preceding, RowIndex, RunningMax, RunningSum, Total, find_hot_keys, ordered,
)

TINY = 20


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds half of all rows; values have gaps; some keys are null."""
    rng = random.Random(3)
    data = []
    for i in range(600):
        key = 1 if i % 2 else (None if i % 17 == 0 else rng.randrange(2, 40))
        data.append((i, key, rng.randrange(400), None if rng.random() < 0.3 else round(rng.uniform(0, 100), 2), rng.choice("abcd")))
    return spark.createDataFrame(data, "id long, k long, at long, v double, c string").cache()


def same(a, b, key="id"):
    def norm(v):
        if isinstance(v, float):
            return round(v, 6)
        if isinstance(v, (list, tuple)):
            return tuple(norm(x) for x in v)
        return v

    def table(df):
        return sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)

    assert table(a) == table(b)


CELLS = dict(
    total=lambda: RunningSum("v"), index=RowIndex, top=lambda: RunningMax("v"), sum_all=lambda: Total("v"),
    low=lambda: Total("v", "min"), n=lambda: Total("id", "count"), last=lambda: LastSeen("v"), following=lambda: NextSeen("v"),
    lead=lambda: Following("v"), lag=lambda: Preceding("v"), past=lambda: History(F.struct("v"), 4),
)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("order", [["at", "id"], ["c", "id"]])
def test_segments_change_nothing(rows, keys, order):
    cells = {n: make() for n, make in CELLS.items()}
    hot = find_hot_keys(rows, keys, order, TINY)
    assert hot and hot.rows[0]["_size"] >= 3
    same(ordered(rows, keys, order, cells), ordered(rows, keys, order, cells, hot=hot))


def test_only_large_keys_are_hot(rows):
    hot = find_hot_keys(rows, ["k"], ["at"], TINY)
    assert [r["k"] for r in hot.rows] == [1]
    assert not find_hot_keys(rows, ["k"], ["at"])


def test_texts_with_a_common_start_and_equal_first_values_are_cut(spark):
    from episodia.operators.scan import with_segments

    df = spark.range(4000).select(F.format_string("Customer#%09d", "id").alias("name"), F.lit(0).alias("same"), (F.col("id") * 7 % 4001).alias("id"))
    for order in (["name"], ["same", "id"]):
        hot = find_hot_keys(df, [], order, 250)
        sizes = [r["count"] for r in with_segments(df, order, hot).groupBy("_segment").count().collect()]
        assert len(sizes) >= 16 and max(sizes) <= 500 and sum(sizes) == 4000


def test_null_keys_match_nothing(spark):
    df = spark.createDataFrame([(1, None, 10, 12), (2, None, 14, 15), (3, 7, 1, 2), (4, 7, 3, 4)], "e int, s int, a long, b long")
    df = df.withColumns({c: F.timestamp_seconds(F.col(c) * 86400) for c in ("a", "b")})
    assert {r.e: r.readmit_30d for r in J.returned_within(df, "s", "e", "a", "b", 30).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}


def test_equal_probes_stay_apart(spark):
    probes = spark.createDataFrame([(1, 5, 0), (1, 5, 0), (None, 5, 0)], "k int, at int, since int")
    visits = spark.createDataFrame([(1, 2), (1, 3), (None, 2)], "k int, seen int")
    assert sorted(r.n for r in J.prior_count(probes, visits, ["k"], "at", "since", "seen", "n").collect()) == [0, 2, 2]


def test_rules_of_a_column_apply_one_after_the_other(spark):
    from episodia.operators.cleaning import component_total, defaults_filled

    df = spark.createDataFrame([(300.0, None, 4.0, 9.0), (None, 1.0, 2.0, None), (50.0, None, None, None)], "age double, p double, q double, total double")
    got = [r.age for r in defaults_filled(df.withColumn("m", F.lit(70.0)), {}, {"age": (200, None)}, {"age": "m"}).collect()]
    assert got == [70.0, 70.0, 50.0]
    assert [r.total for r in component_total(df, ["p", "q"], "total").collect()] == [9.0, 3.0, None]


OPS = {
    "next_state": lambda d, n: W.next_state(d, ["k"], ["at", "id"], ["v", "c"], index="i", rows_per_task=n),
    "held": lambda d, n: W.held_values(d, ["k"], "at", ["id"], {"v": 0.01}, rows_per_task=n),
    "entries": lambda d, n: W.entries_and_exits(d.withColumn("in", (F.col("c") == "a").cast("int")), ["k"], ["at", "id"], "in", rows_per_task=n),
    "interpolated": lambda d, n: W.interpolated(d.withColumn("x", F.col("at") * 1000 + F.col("id")), ["k"], "x", ["v"], rows_per_task=n),
    "history": lambda d, n: W.history_vectors(d, ["k"], ["at", "id"], ["v"], 5, rows_per_task=n),
    "window": lambda d, n: W.random_window(d, ["k"], ["at", "id"], 6, 1, rows_per_task=n),
    "seed": lambda d, n: W.seed_rows(d, ["k"], ["at", "id"], 3, 2, rows_per_task=n),
    "pairs": lambda d, n: W.transition_pairs(d, ["k"], ["at", "id"], "v", rows_per_task=n),
    "padded": lambda d, n: W.padded_sequences(d, ["k"], ["at", "id"], ["v"], 8, rows_per_task=n),
    "bounds": lambda d, n: W.episode_bounds(d, ["k"], ["at", "id"], "at", "at", rows_per_task=n),
    "rank": lambda d, n: T.rank_of(d.filter("v is not null"), "v", "id", rows_per_task=n),
    "ordinal": lambda d, n: T.ordinal_split(d, "id", rows_per_task=n),
    "strata": lambda d, n: T.stratified_split(d, "id", "c", 0.3, 1, rows_per_task=n),
    "cap": lambda d, n: T.capped_per_split(d, "id", "c", 7, 1, rows_per_task=n),
    "codes": lambda d, n: T.category_codes(d, "c", "code", rows_per_task=1 if n else None),
    "quantiles": lambda d, n: exact_quantiles(d, ["c"], "v", {"a": 0.1, "b": 0.5, "e": 0.9}, rows_per_task=n),
    "spearman": lambda d, n: M.spearman(d, "v", "at", rows_per_task=n),
    "ks": lambda d, n: M.two_sample_ks(d, "v", F.col("c") == "a", rows_per_task=n),
    "binary": lambda d, n: M.binary_metrics(d.select((F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("v") / 101).alias("p")), "y", "p", rows_per_task=n),
    "as_of": lambda d, n: J.as_of(d.filter("k is not null").select("id", "k", "at"), d.filter("id % 5 = 0").select("k", F.col("at").alias("b"), F.col("id").alias("r")), ["k"], "at", "b", ["r"], rows_per_task=n),
    "as_of_forward": lambda d, n: J.as_of(d.select("id", "k", "at"), d.filter("id % 5 = 0").select("k", F.col("at").alias("b"), F.col("id").alias("r")), ["k"], "at", "b", ["r"], direction="forward", allow_equal=False, rows_per_task=n),
    "prior": lambda d, n: J.prior_count(d.select("id", "k", "at", (F.col("at") - 50).alias("since")), d.filter("id % 4 = 0").select("k", F.col("at").alias("seen")), ["k"], "at", "since", "seen", "n", rows_per_task=n),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_operators_survive_a_hot_key(rows, name):
    same(OPS[name](rows, None), OPS[name](rows, TINY))


@pytest.mark.parametrize("name", ["next_state", "held", "quantiles", "as_of", "cap"])
def test_row_order_does_not_matter(rows, name):
    same(OPS[name](rows, None), OPS[name](rows.orderBy(F.rand(5)), None))


def test_as_of_by_brute_force(rows):
    left = rows.select("id", "k", "at")
    right = rows.filter("id % 5 = 0").select("k", F.col("at").alias("b"), F.col("id").alias("r"))
    got = {r.id: r.r for r in J.as_of(left, right, ["k"], "at", "b", ["r"], rows_per_task=TINY).collect()}
    data = right.collect()
    for q in left.collect():
        hits = [(x.b, x.r) for x in data if x.k == q.k and q.k is not None and x.b <= q.at]
        assert got[q.id] == (max(hits)[1] if hits else None)


def test_prior_count_by_brute_force(rows):
    out = OPS["prior"](rows, TINY).collect()
    seen = rows.filter("id % 4 = 0").collect()
    for q in out:
        assert q.n == sum(1 for s in seen if s.k == q.k and q.k is not None and q.since <= s["at"] < q["at"])


def test_backward_fold_of_long_runs(spark):
    n = 5000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), ((F.col("id") % 7) / 10).alias("a"),
                               F.when(F.col("id") % 300 == 299, 0.0).otherwise(0.9).alias("b"))
    got = backward_fold(df, ["k"], "t", F.col("a"), F.col("b")).first()["value"]
    v = 0.0
    for i in range(n - 1, -1, -1):
        v = (i % 7) / 10 + (0.0 if i % 300 == 299 else 0.9) * v
    assert abs(got - v) < 1e-9


def test_backward_fold_has_no_longest_run(spark, monkeypatch):
    from episodia.operators import policy_value

    monkeypatch.setattr(policy_value, "FAN", 4)
    df = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    got = backward_fold(df, ["k"], "t", F.lit(1.0), F.lit(0.5)).first()["value"]
    assert abs(got - 2.0) < 1e-9


def test_sweeps_equal_expanded_intervals_with_large_keys(spark):
    import random

    from episodia.operators import intervals as I
    from episodia.operators import sweeps as W

    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), rng.randrange(-500, 2500), rng.choice([0, 5, 90, 700, 3000]), rng.choice([None, 1.0, 2.5, 7.0]), rng.choice("ab")) for _ in range(400)]
    iv = spark.createDataFrame([(k, b, b + n, r, c) for k, b, n, r, c in rows], "k int, b long, f long, r double, c string").repartition(4)
    stays = spark.createDataFrame([(1, 0, 2400), (2, 100, 1000), (4, 0, 50)], "k int, s long, e long")
    bins = I.bin_spine(stays, "s", "e", 100).select("k", "bin")

    def same(a, b):
        a, b = (sorted(map(tuple, x.collect())) for x in (a, b))
        assert len(a) == len(b) and all(x[:2] == y[:2] and x[2:] == pytest.approx(y[2:]) for x, y in zip(a, b))

    for most in (None, 20):
        same(W.volume_at(iv, bins, stays, ["k"], "b", "f", "r", "s", 100, rows_per_task=most), I.volume_per_bin(iv, stays, ["k"], "b", "f", "r", "s", "e", 100))
        same(W.flags_at(iv, bins, stays, ["k"], "b", "f", "c", {"a": "fa", "b": "fb"}, "s", 100, rows_per_task=most),
             I.active_flags_per_bin(iv, stays, ["k"], "b", "f", "c", {"a": "fa", "b": "fb"}, "s", "e", 100))
    active = I.active_rates_per_bin(iv, stays, ["k"], "b", "f", "r", "s", "e", 100)
    want = active.groupBy("k", "bin").agg(F.percentile("r", F.lit(0.5)).alias("median"), F.max("r").alias("max"))
    for stretch in (1024, 2):
        same(W.rates_at(iv, bins, stays, ["k"], "b", "f", "r", "s", 100, stretch=stretch), want)
    # a panel's own bins are enough, and an interval is not repeated for the bins it spans
    few = bins.filter("bin % 5 = 0")
    same(W.volume_at(iv, few, stays, ["k"], "b", "f", "r", "s", 100), I.volume_per_bin(iv, stays, ["k"], "b", "f", "r", "s", "e", 100).filter("bin % 5 = 0"))
    assert W.volume_at(iv.filter("1 = 0"), bins, stays, ["k"], "b", "f", "r", "s", 100).count() == 0
