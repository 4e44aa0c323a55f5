"""Small tables with known results, and edge cases of bins, fills and joins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodia.catalog.transitions import LABELS
from episodia.functions import fixed_values as fixed
from episodia.functions import scalars as S
from episodia.operators import aggregates as A
from episodia.operators import cleaning as C
from episodia.operators import intervals as I
from episodia.operators import joins as J
from episodia.operators import quality as Q
from episodia.operators import sampling as P
from episodia.operators import sequences as W
from episodia.plans.hourly import FLAGS, STATES, hourly_transitions


def hourly(spark, rows):
    names = ["subject_id", "hadm_id", "stay_id", "hr", "starttime", "endtime", "s_t_sofa", *FLAGS]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n == 's_t_sofa' else 'long'}" for n in names))
    return df.withColumns({f"s_t_{s}": F.lit(1.0) for s in STATES if s != "sofa"})


def test_jump_label(spark):
    df = hourly(spark, [(1, 10, 100, h, h, h + 1, s, 0, 0, 0) for h, s in enumerate([1.0, 3.0, 4.0, 4.0])])
    out = hourly_transitions(df, LABELS, threshold=2).orderBy("t").collect()
    assert [r.y_t1 for r in out] == [1, 0, 0, 0]
    assert [r.s_t1_sofa for r in out] == [3.0, 4.0, 4.0, None]
    assert [r.episode_step for r in out] == [0, 1, 2, 3]


def test_done_flag(spark):
    df = hourly(spark, [(1, 10, 100, 0, 0, 1, 1.0, 0, 0, 0), (1, 10, 100, 1, 1, 2, 1.0, 0, 0, 0), (2, 20, 200, 0, 0, 1, 1.0, 0, 0, 0)])
    out = hourly_transitions(df, LABELS).collect()
    done = {(r.episode_id, r.t): r.done for r in out}
    assert done == {("100", 0): 0, ("100", 1): 1, ("200", 0): 1}
    checks = Q.transition_checks(spark.createDataFrame(out), "episode_id", "t").collect()
    assert all(r.violations == 0 for r in checks)


def test_action_labels(spark):
    df = hourly(spark, [(1, 1, 1, 0, 0, 1, 1.0, 1, 0, 0), (1, 1, 1, 1, 1, 2, 1.0, 0, 1, 0), (1, 1, 1, 2, 2, 3, 1.0, 1, 1, 1)])
    out = hourly_transitions(df, LABELS).orderBy("t").collect()
    assert [r.a_t for r in out] == ["A_VASO", "A_VENT", "A_VASO_VENT_CRRT"]


def test_unmapped_action_is_an_error(spark):
    df = hourly(spark, [(1, 1, 1, 0, 0, 1, 1.0, 1, 0, 0)])
    with pytest.raises(Exception, match="no label for flags 1,0,0"):
        hourly_transitions(df, {(0, 0, 0): "A_NONE"}).collect()


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="s_t_gcs"):
        hourly_transitions(hourly(spark, [(1, 1, 1, 0, 0, 1, 1.0, 0, 0, 0)]).drop("s_t_gcs"), LABELS)


def test_contract_finds_violations(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 0, 0), ("a", 1, 0), ("b", 0, 0)], "e string, t int, done int")
    found = {r.check: r.violations for r in Q.transition_checks(df, "e", "t").collect()}
    assert found == {"duplicate_keys": 1, "episodes_without_one_end": 1, "end_not_last": 2}


def test_episode_summary(spark):
    df = spark.createDataFrame([("e1", 0, 1.0, 15.0, 1.2), ("e1", 1, 3.0, 14.0, 1.1)], "episode_id string, t int, sofa double, gcs double, urine double")
    r = A.episode_summary(df, ["episode_id"], ["t"], last=["sofa", "gcs"], mean=["urine"], delta=["sofa"], count="hours").first()
    assert (r.hours, r.last_sofa, r.last_gcs, round(r.mean_urine, 6), r.delta_sofa) == (2, 3.0, 14.0, 1.15, 2.0)


def test_sampling_is_repeatable(spark):
    df = spark.createDataFrame([(s, h) for h, s in enumerate([1, 1, 2, 3, 4, 5, 6, 7, 8])], "subject_id long, hadm_id long")
    a = P.hash_sample(df, "subject_id", 0.5, 42).collect()
    assert sorted(a) == sorted(P.hash_sample(df.repartition(3), "subject_id", 0.5, 42).collect())
    assert P.hash_sample(df, "subject_id", 1.0, 42).count() == df.count()


def test_uniform_number_matches_the_hash(spark):
    import hashlib

    got = spark.range(20).select("id", S.uniform(F.lit("split"), F.lit(42), "id").alias("u")).collect()
    for r in got:
        head = hashlib.sha256(f"split:42:{r.id}".encode()).digest()[:8]
        assert r.u == int.from_bytes(head, "big") / 2**64


def test_split_fills_all_parts(spark):
    df = P.hash_split(spark.range(1, 1001).withColumnRenamed("id", "patient_id"), "patient_id")
    n = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert set(n) == {"train", "valid", "test"} and abs(n["train"] - 700) < 60
    with pytest.raises(ValueError, match="sum to 1"):
        P.hash_split(df, "patient_id", 0.7, 0.2, 0.2)


def test_bins_conserve_volume(spark):
    stays = spark.createDataFrame([(1, 0, 100_000)], "s long, a long, b long")
    iv = spark.createDataFrame([(1, 0, 14_400, 2.0), (1, 14_400, 14_400, 9.0), (1, 7_200, 90_000, 1.5), (1, -5_000, 5_000, 1.0), (1, 95_000, 300_000, 1.0)],
                               "s long, x long, y long, rate double")
    out = I.volume_per_bin(iv, stays, ["s"], "x", "y", "rate", "a", "b", 14_400)
    # the last bin ends at 7 * 14400 = 100800
    expected = 2.0 * 14_400 + 1.5 * 82_800 + 1.0 * 5_000 + 1.0 * 5_800
    assert abs(out.agg(F.sum("volume")).first()[0] * 3600 - expected) < 1e-6
    first = out.filter("bin = 0").first()["volume"] * 3600
    assert abs(first - (2.0 * 14_400 + 1.5 * 7_200 + 5_000)) < 1e-6


def test_point_on_a_bin_edge_is_in_one_bin(spark):
    stays = spark.createDataFrame([(1, 0, 28_800)], "s long, a long, b long")
    pts = spark.createDataFrame([(1, 0), (1, 14_400), (1, 28_799), (1, 28_800), (1, -1)], "s long, x long")
    got = sorted(r.bin for r in I.points_to_bins(pts, stays, ["s"], "x", "a", "b", 14_400).collect())
    assert got == [0, 1, 1]


def test_interval_days_edges(spark):
    d = dt.date
    df = spark.createDataFrame([(1, d(2024, 1, 1), d(2024, 1, 1)), (2, d(2024, 1, 1), d(2024, 1, 3)), (3, d(2024, 1, 5), None), (4, d(2024, 1, 5), d(2024, 1, 1))],
                               "i int, a date, b date")
    got = sorted((r.i, r.calendar_date.day) for r in I.interval_days(df, "a", "b").collect())
    assert got == [(2, 1), (2, 2), (3, 5)]


def test_spine_drops_same_day_episodes(spark):
    t = dt.datetime
    df = spark.createDataFrame([(1, t(2024, 1, 1, 23), t(2024, 1, 3, 1)), (2, t(2024, 1, 1, 1), t(2024, 1, 1, 22))], "i int, a timestamp, b timestamp")
    got = [(r.i, r.day_of_stay, r.is_last_day) for r in I.day_spine(df, "a", "b").orderBy("calendar_date").collect()]
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 1)]


def test_containing_interval_prefers_the_latest_that_contains(spark):
    d = dt.date
    days = spark.createDataFrame([(1, d(2024, 1, i)) for i in range(1, 8)], "k int, day date")
    iv = spark.createDataFrame([(1, d(2024, 1, 2), d(2024, 1, 6), "long", 1), (1, d(2024, 1, 3), d(2024, 1, 4), "short", 2)], "k int, a date, b date, name string, id int")
    got = {r.day.day: (r.name, r.contained) for r in I.containing_interval(days, iv, ["k"], "day", "a", "b", ["id"], ["name"]).collect()}
    # day 6 is contained by none: the last one that began wins
    assert got == {1: (None, 0), 2: ("long", 1), 3: ("short", 1), 4: ("long", 1), 5: ("long", 1), 6: ("short", 0), 7: ("short", 0)}


def test_hold_limit_is_inclusive(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 7_200, None), (1, 7_201, None)], "k int, at long, v double")
    got = [r.v for r in W.held_values(df, ["k"], "at", [], {"v": 2}).orderBy("at").collect()]
    assert got == [5.0, 5.0, None]


def test_fill_limit(spark):
    df = spark.createDataFrame([(1, i, 1.0 if i == 0 else None) for i in range(5)], "k int, i int, v double")
    got = [r.v for r in W.filled_forward(df, ["k"], "i", {"v": 2}).orderBy("i").collect()]
    assert got == [1.0, 1.0, 1.0, None, None]


def test_gaps_are_not_filled_across_keys(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, 6.0), (1, 4, None), (2, 0, None), (2, 1, None)], "k int, i int, v double")
    got = [(r.k, r.v) for r in W.interpolated(df, ["k"], "i", ["v"]).orderBy("k", "i").collect()]
    assert got == [(1, None), (1, 2.0), (1, 4.0), (1, 6.0), (1, None), (2, None), (2, None)]


def test_returns_and_same_day_starts(spark):
    t = dt.datetime
    df = spark.createDataFrame([(1, 7, t(2024, 1, 1), t(2024, 1, 5)), (2, 7, t(2024, 1, 5), t(2024, 1, 6)), (3, 7, t(2024, 2, 5), t(2024, 2, 6)), (4, 7, t(2024, 3, 8), t(2024, 3, 9))],
                               "e int, s int, a timestamp, b timestamp")
    got = {r.e: r.readmit_30d for r in J.returned_within(df, "s", "e", "a", "b", 30).collect()}
    # a start exactly at the end is not later; 30 days after 6 January is 5 February
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}


def test_step_lookup(spark):
    df = spark.createDataFrame([(0.5,), (4.0,), (9.0,), (15.0,), (16.0,)], "x double")
    got = [r[0] for r in df.select(S.step_value("x", fixed.FLOW_NON_REBREATHER, fixed.FLOW_NON_REBREATHER_HIGH)).collect()]
    assert got == [60.0, 60.0, 80.0, 100.0, 100.0]


def test_exact_quantiles_of_small_groups(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0, 4.0)] + [("b", 3.0)], "g string, v double")
    got = {r.g: (r.q1, r.q2) for r in A.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5}).collect()}
    assert got == {"a": (1.75, 3.0), "b": (3.0, 3.0)}


def test_oxygen_rules_read_held_values(spark):
    df = spark.createDataFrame([(None, 0, 4.0, None), (None, 0, None, None), (None, 7, 12.0, None), (50.0, 0, 4.0, 50.0), (None, None, 6.0, None), (77.0, 3, None, None)],
                               "p double, device int, flow double, held double")
    got = [r.p for r in C.oxygen_estimate(df, "p", "device", "flow", "held").collect()]
    assert got == [36.0, 21.0, 90.0, 50.0, 40.0, None]


def test_clip_and_ratio_keep_nulls(spark):
    r = spark.createDataFrame([(None, 5.0)], "a double, b double").select(S.clip("a", 0, 1).alias("x"), S.capped_ratio("a", "b").alias("y"), S.above("a", 1).alias("z")).first()
    assert (r.x, r.y, r.z) == (None, None, 0)


def test_require_finite_names_the_columns(spark):
    df = spark.createDataFrame([(1.0, None), (float("inf"), 2.0)], "a double, b double")
    with pytest.raises(ValueError, match=r"a \(0 null, 1 infinite\), b \(1 null, 0 infinite\)"):
        Q.require_finite(df, ["a", "b"])
    assert Q.require_finite(spark.createDataFrame([(1.0,)], "a double"), ["a"]).count() == 1


def test_guards(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="already present"):
        Q.forbid_columns(df, ["id"])
    assert Q.coverage_report(df, ["id", "x"]) == {"absent": ["x"], "extra": []}
    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("id", T.StringType())])
    assert Q.conform(df, schema).collect()[0].asDict() == {"x": None, "id": "0"}


def test_care_units_and_services(spark):
    df = spark.createDataFrame([("Coronary Care Unit (CCU)",), ("Medicine/Cardiology",), ("Labor & Delivery",), ("Vascular",), (None,)], "u string")
    assert [r[0] for r in df.select(S.care_unit_group("u")).collect()] == ["icu", "medicine", "obstetrics", "surgery", "other"]
    df = spark.createDataFrame([("GYN",), ("ORTHO",), ("ZZZ",), (None,)], "s string")
    assert [r[0] for r in df.select(S.code_group("s", fixed.SERVICE_GROUPS)).collect()] == ["obstetrics", "surgery", "other", "other"]


def test_drug_classes(spark):
    df = spark.createDataFrame([("VANCOMYCIN 1g",), ("Heparin / insulin",), ("saline",), (None,)], "d string")
    got = [r[0] for r in df.select(S.matching_classes("d", fixed.DRUG_PATTERNS)).collect()]
    assert got == [["antibiotic"], ["anticoagulant", "insulin"], [], []]


def test_comorbidity_score(spark):
    dim = spark.createDataFrame([(p, c, w) for c, w, ps in fixed.COMORBIDITY_PREFIXES for p in ps], "prefix string, category string, weight int")
    codes = spark.createDataFrame([(1, "I2510"), (1, "I252"), (1, "E1021"), (1, "E109"), (2, "Z00"), (3, "C7800"), (3, "C781")], "h int, code string")
    got = {r.h: r.score for r in A.prefix_score(codes, dim, ["h"], "code").collect()}
    assert got == {1: 1 + 2 + 1, 2: 0, 3: 6}
