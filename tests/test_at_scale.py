"""What keeps time and memory of a task in bounds on larger tables."""

import numpy as np
from pyspark.sql import functions as F

from episodia.operators import aggregates as A
from episodia.operators import forests as R
from episodia.operators import models as M
from episodia.operators import neighbours as N
from episodia.operators import sweeps as W


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_margins_of_a_policy_are_computed_once(spark):
    p = M.ActionPolicy(["x"], {"x": 0.0}, [0, 1, 2], [[0.5], [0.25], [-1.0]], [0.125, 0.0, 0.40625])
    assert str(p.probabilities()._jc.toString()).count("0.40625") == 1
    row = spark.createDataFrame([(2.0, 1)], "x double, a int").select(p.probabilities().alias("p"), p.of_action("a").alias("pa")).first()
    want = np.exp([1.125, 0.5, -1.59375])
    assert np.allclose(row.p, want / want.sum()) and row.pa == row.p[1]
    unknown = spark.createDataFrame([(2.0, 7)], "x double, a int").select(p.of_action("a").alias("pa")).first()
    assert unknown.pa == 0.0


def test_rows_of_equal_bins_become_one(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(u), None if i % 9 == 0 else float(a + rng.normal()), float(i % 3 == 0)) for i, (a, u) in enumerate(zip(rng.normal(size=400), rng.integers(0, 2, 400)))]
    kept, durable = [], R.durable
    monkeypatch.setattr(R, "durable", lambda df: kept.append(durable(df)) or kept[-1])
    R.fit_forests(spark.createDataFrame(rows, "a double, u double, y double, z double"), ["a", "u"], {"y": False, "z": True}, trees=1, depth=1, bins=8)
    assert kept[0].count() == kept[0].select("bins").distinct().count() < 20
    assert kept[0].agg(F.sum("n0"), F.sum(F.col("n1") + F.col("n2"))).first()[:] == (355.0, 400.0)


def test_settings_of_flags_are_scored_together():
    rng = np.random.default_rng(2)
    feature = [np.array([0, 1, 2, -1, -1, 0, -1] + [-1] * 4 + [-1] * 4), np.array([2, 0, 1] + [-1] * 12)]
    cut, value = [rng.integers(0, 2, 15) for _ in range(2)], [rng.normal(size=15) for _ in range(2)]
    f = R.Forest(["s", "u", "v"], [np.array([0.0, 1.0])] * 3, 0.5, 3, feature=feature, cut=cut, value=value)
    bins = rng.integers(0, 4, (50, 3)).astype(np.int16)
    got = f.flag_margins(bins, [1, 2], [1, 1], [2, 2])
    for code in range(4):
        bins[:, 1], bins[:, 2] = 1 + (code & 1), 1 + (code >> 1)
        assert (got[:, code] == f.margins(bins)).all()


def test_prefixes_are_looked_up_per_code(spark):
    dim = spark.createDataFrame([("abc", "x", 1), ("abcd", "y", 2), ("q12", "x", 5)], "prefix string, category string, weight int")
    codes = spark.createDataFrame([(1, "abcde"), (1, "abcde"), (1, "abc9"), (1, "q123"), (2, "zzz"), (3, None), (None, "abcde")], "h int, code string")
    out = A.prefix_score(codes, dim, ["h"], "code", shortest=3)
    assert {r.h: r.score for r in out.collect()} == {1: 7, 2: 0, 3: 0, None: 0}
    # structs make Spark sort what it groups, which must not be the groups' rows
    assert not [x for x in plan(out).splitlines() if "SortAggregate(key=[h" in x]


def test_bins_of_rates_are_not_gathered(spark):
    stays = spark.createDataFrame([(1, 0), (2, 0)], "u long, s long")
    iv = spark.createDataFrame([(1, 0, 15, 2.0), (1, 5, 8, 6.0), (3, 0, 9, 1.0)], "u long, b long, f long, r double")
    bins = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (None, 0)], "u long, bin long")
    out = W.rates_at(iv, bins, stays, ["u"], "b", "f", "r", "s", 10)
    assert "Aggregate" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 4.0, 6.0), (1, 1, 2.0, 2.0)]


def test_nearest_rows_come_as_arrays():
    z = np.array([[0.0, 1.0], [1.0, 2.0], [5.0, np.nan], [0.9, np.nan], [np.nan, np.nan]])
    (rows, j, d, found), = N.nearest_known(z, np.array([0, 1]), np.array([2, 3]), 1)
    assert list(rows) == [2, 3] and j == 1 and found.tolist() == [[1], [1]] and np.allclose(d, [[16.0], [0.01]])


def test_texts_that_stay_are_not_sent(spark):
    from episodia.llm.language_id import keep_identified

    docs = spark.createDataFrame([(i, "a", "en" if i % 2 else "de", ["the cat and the dog", "der Hund und die Katze"][1 - i % 2] * 3) for i in range(40)] + [(99, "a", None, "12 34")],
                                 "doc_id long, source string, lang string, text string")
    kept = keep_identified(docs)
    assert "SortMergeJoin" not in plan(kept) and kept.filter("doc_id = 99").count() == 0


def test_days_meet_all_sources_in_one_layout(spark):
    from datetime import date, datetime

    from episodia.operators import intervals as I
    from episodia.plans import daily

    at = lambda d, h=8: datetime(2024, 1, d, h)
    stays = spark.createDataFrame([(1, at(2), at(5)), (1, at(2), at(5)), (2, at(2), at(3)), (None, at(2), at(3))], "hadm_id long, admittime timestamp, dischtime timestamp")
    labs = spark.createDataFrame([(1, 50912, at(1), 9.0), (1, 50912, at(2), 4.0), (1, 51006, at(5), 7.0), (None, 50912, at(2), 5.0), (2, 50912, None, 5.0)], "hadm_id long, itemid int, charttime timestamp, valuenum double")
    cultures = spark.createDataFrame([(1, at(1), at(1), "ORG", "BLOOD CULTURE"), (1, at(3), at(3), "ORG", "URINE")], "hadm_id long, charttime timestamp, chartdate timestamp, org_name string, spec_type_desc string")
    drugs = spark.createDataFrame([(1, "Vancomycin", "MAIN", at(3), at(4))], "hadm_id long, drug string, drug_type string, starttime timestamp, stoptime timestamp")
    units = spark.createDataFrame([(1, 1, "Vascular", "transfer", at(1), at(3)), (1, 2, "Medical Intensive Care Unit (MICU)", "transfer", at(4), None)],
                                  "hadm_id long, transfer_id int, careunit string, eventtype string, intime timestamp, outtime timestamp")
    services = spark.createDataFrame([(1, 1, "MED", at(1)), (1, 2, "CSURG", at(4)), (2, 3, "TRAUM", at(9))], "hadm_id long, service_id int, curr_service string, transfertime timestamp")
    zero = lambda *names: dict.fromkeys(names, 0)
    out = daily.with_windows(I.day_spine(stays, "admittime", "dischtime"), {
        "_labs": (daily.daily_labs(labs), zero("lactate_elevated", "n_labs_today")), "_cultures": (daily.daily_cultures(cultures), zero("culture_ordered_today")),
        "_prescriptions": (daily.daily_prescriptions(drugs), zero(*[f"{c}_active" for c in daily.CLASSES], "antibiotic_started", "antibiotic_stopped")),
        "_changes": (daily.daily_care_changes(units), zero("icu_escalation", "icu_stepdown", "discharged")),
        "_locations": (daily.daily_locations(units, daily.frames(stays)), {}), "_services": (daily.daily_services(services), {}),
    })
    shown = ["creatinine", "bun", "n_labs_today", "culture_ordered_today", "positive_culture_cumulative", "blood_culture_positive_cumulative",
             "antibiotic_active", "antibiotic_started", "antibiotic_stopped", "icu_escalation", "careunit_group", "days_in_current_unit", "curr_service_group"]
    # days are looked up without a join by day: the only joins are those of drug names and of stays with transfers
    assert plan(out).count("Join") == 2
    rows = {}
    for r in out.collect():
        rows.setdefault((r.hadm_id, r.calendar_date.day), []).append(tuple(r[c] for c in shown))
    blank = (None, None, 0, 0, 0, 0, 0, 0, 0, 0, "other", 0, "other")
    # values from before the stay do not fill; unit and service do
    want = {
        2: (4.0, None, 1, 0, 0, 0, 0, 0, 0, 0, "surgery", 1, "medicine"), 3: (4.0, None, 0, 1, 1, 0, 1, 1, 0, 0, "surgery", 2, "medicine"),
        4: (4.0, None, 0, 0, 1, 0, 0, 0, 1, 1, "icu", 0, "surgery"), 5: (None, 7.0, 1, 0, 1, 0, 0, 0, 0, 0, "icu", 1, "surgery"),
    }
    assert rows == {**{(1, d): [v, v] for d, v in want.items()}, **{(h, d): [blank] for h in (2, None) for d in (2, 3)}}


def test_nearest_rows_open_few_boxes(monkeypatch):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(6000, 3))
    z[rng.uniform(size=z.shape) < 0.4] = np.nan
    z[:1500] = np.round(z[:1500])  # many equal distances
    merged, keep = [], N.keep_nearest
    monkeypatch.setattr(N, "keep_nearest", lambda distance, giver, rows, d, found: merged.append(len(rows)) or keep(distance, giver, rows, d, found))
    every, lacking = np.arange(len(z)), np.isnan(z).any(1)
    asked = 0
    for rows, j, d, found in N.nearest_by_boxes(z, every, every[lacking], 2):
        asked += len(rows)
        assert (np.diff(d[np.isfinite(d).all(1)]) >= 0).all() and not np.isnan(z[found[np.isfinite(d)], j]).any()
    # about a third of 6000 rows could give to each
    assert asked > 5000 and sum(merged) < 20 * asked
