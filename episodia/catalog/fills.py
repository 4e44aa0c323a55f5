"""Cleaning, fill and score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodia.catalog.registry import query
from episodia.catalog.roles import EV_SQL, LATE_SQL, PANEL_SQL, ev, n8, panel, r6, with_
from episodia.functions import fixed_values as fixed
from episodia.functions import scalars as S
from episodia.operators import aggregates as A
from episodia.operators import cleaning as C
from episodia.operators import sequences as W

# line items as wide measurements; a third of each column is missing
MEAS_SQL = """meas as (
  select l_orderkey as id, l_linenumber as n, l_quantity as q, l_extendedprice as price, l_discount as d, l_tax as tx,
    case when (l_partkey + 0) % 3 = 0 then null else 60 + l_quantity * 3 end as sysbp,
    case when (l_partkey + 1) % 3 = 0 then null else 40 + l_quantity * 2 end as meanbp,
    case when (l_suppkey + 2) % 3 = 0 then null else 20 + l_quantity end as diabp,
    case when l_suppkey % 4 = 0 then null else 20 + l_quantity * 1.6 end as temp_c,
    case when l_suppkey % 5 < 2 then null else 20 + l_quantity * 2.0 end as temp_f,
    case when l_partkey % 4 = 0 then null else l_quantity / 3.0 end as hb,
    case when l_partkey % 5 = 0 then null else l_quantity * 1.2 end as ht,
    case when l_linenumber = 1 then null else l_quantity / 10.0 end as total_bili,
    case when l_linenumber = 2 then null else l_quantity / 20.0 end as direct_bili,
    case when l_linenumber % 3 = 0 then null else 20 + l_quantity * 1.6 end as fio2_100,
    case when l_linenumber % 2 = 0 then null else (20 + l_quantity) / 100.0 end as fio2_1,
    case when l_suppkey % 3 = 0 then null else l_quantity / 3.0 end as o2flow,
    case when l_partkey % 6 = 0 then null else l_partkey % 11 end as device
  from lineitem)"""


def meas(t):
    q, part, supp, num = F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")

    def gap(missing, value):
        return F.when(~missing, value)

    return t.lineitem.select(
        F.col("l_orderkey").alias("id"), num.alias("n"), q.alias("q"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("d"), F.col("l_tax").alias("tx"),
        gap(part % 3 == 0, 60 + q * 3).alias("sysbp"), gap((part + 1) % 3 == 0, 40 + q * 2).alias("meanbp"),
        gap((supp + 2) % 3 == 0, 20 + q).alias("diabp"), gap(supp % 4 == 0, 20 + q * 1.6).alias("temp_c"),
        gap(supp % 5 < 2, 20 + q * 2.0).alias("temp_f"), gap(part % 4 == 0, q / 3.0).alias("hb"),
        gap(part % 5 == 0, q * 1.2).alias("ht"), gap(num == 1, q / 10.0).alias("total_bili"),
        gap(num == 2, q / 20.0).alias("direct_bili"), gap(num % 3 == 0, 20 + q * 1.6).alias("fio2_100"),
        gap(num % 2 == 0, (20 + q) / 100.0).alias("fio2_1"), gap(supp % 3 == 0, q / 3.0).alias("o2flow"),
        gap(part % 6 == 0, part % 11).alias("device"),
    )


@query("hold_with_expiry", "W6", with_(EV_SQL, select=f"""
, m as (select user_id, event_id, sec, case when event_type in ('click', 'view') then value end as hr, case when event_type = 'error' then value end as lab from ev),
h as (select *, last_value(hr ignore nulls) over w as hv, last_value(case when hr is not null then sec end ignore nulls) over w as ht,
   last_value(lab ignore nulls) over w as lv, last_value(case when lab is not null then sec end ignore nulls) over w as lt
   from m window w as (partition by user_id order by sec, event_id rows unbounded preceding))
select event_id, {r6('case when sec - ht <= 6 * 3600 then hv end', 'hr')}, {r6('case when sec - lt <= 28 * 3600 then lv end', 'lab')} from h"""))
def hold_with_expiry(t):
    rows = ev(t).select("user_id", "event_id", "sec", F.when(F.col("event_type").isin("click", "view"), F.col("value")).alias("hr"),
                        F.when(F.col("event_type") == "error", F.col("value")).alias("lab"))
    out = W.held_values(rows, ["user_id"], "sec", ["event_id"], {"hr": 6, "lab": fixed.LAB_HOLD_HOURS})
    return out.select("event_id", "hr", "lab")


@query("gap_interpolation", "W17", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
, g as (select user_id, bin, bun, last_value(bun ignore nulls) over a as pv, last_value(case when bun is not null then bin end ignore nulls) over a as pi,
   first_value(bun ignore nulls) over b as nv, first_value(case when bun is not null then bin end ignore nulls) over b as ni from panel
   window a as (partition by user_id order by bin rows unbounded preceding), b as (partition by user_id order by bin rows between 1 following and unbounded following))
select user_id, {n8('bin', 'bin')}, {r6('coalesce(bun, pv + (nv - pv) * ((bin - pi) / (ni - pi)))', 'bun')} from g"""))
def gap_interpolation(t):
    return W.interpolated(panel(t).select("user_id", "bin", "bun"), ["user_id"], "bin", ["bun"])


@query("fill_gain", "A56 W17", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
, g as (select user_id, bin, bun, cr, last_value(bun ignore nulls) over (partition by user_id order by bin rows between 2 preceding and current row) as b2,
   last_value(cr ignore nulls) over (partition by user_id order by bin rows between 3 preceding and current row) as c2 from panel),
c as (select 'bun' as column_name, sum(case when bun is null then 1 else 0 end) as nb, sum(case when b2 is null then 1 else 0 end) as na from g
   union all select 'cr', sum(case when cr is null then 1 else 0 end), sum(case when c2 is null then 1 else 0 end) from g)
select column_name, {n8('nb', 'nulls_before')}, {n8('na', 'nulls_after')}, {r6('1 - na / greatest(nb, 1)', 'share_removed')} from c"""))
def fill_gain(t):
    before = panel(t).select("user_id", "bin", "bun", "cr")
    after = W.filled_forward(before, ["user_id"], "bin", {"bun": 2, "cr": 3})
    return A.fill_gain(before, after, ["bun", "cr"])


@query("bounds_to_null", "F13", with_(MEAS_SQL, select=f"""
select id, {n8('n', 'n')}, {r6('case when sysbp between 0 and 200 then sysbp end', 'sysbp')}, {r6('case when temp_c between 25 and 45 then temp_c end', 'temp_c')},
  {r6('case when hb between 1 and 12 then hb end', 'hb')}, {r6('case when price <= 10000 and price between 0 and 20000 then price end', 'price')} from meas"""))
def bounds_to_null(t):
    limits = {"sysbp": (0, 200), "temp_c": fixed.BOUNDS["temp_c"], "hb": (1, 12), "price": (0, 20000)}
    return C.within_bounds(meas(t), limits).select("id", "n", "sysbp", "temp_c", "hb", "price")


@query("clip_log_zscore", "F14 F15 F16 A22 T7", with_(MEAS_SQL, select=f"""
, s as (select *, case when id % 10 < 7 then 'train' else 'test' end as split, case when hb is not null then least(greatest(hb, 2), 14) end as chb, case when ht is not null then ln(1 + least(greatest(ht, 5), 50)) end as lht from meas),
k as (select avg(chb) as m1, stddev_samp(chb) as s1, avg(lht) as m2, stddev_samp(lht) as s2 from s where split = 'train')
select id, {n8('n', 'n')}, {r6('case when hb is not null then least(greatest((chb - m1) / s1, -1.5), 1.5) end', 'z_hb')},
  {r6('case when ht is not null then least(greatest((lht - m2) / s2, -1.5), 1.5) end', 'z_ht')} from s, k"""))
def clip_log_zscore(t):
    rows = meas(t).select("id", "n", F.when(F.col("id") % 10 < 7, "train").otherwise("test").alias("split"),
                          S.clip("hb", 2, 14).alias("chb"), F.log1p(S.clip("ht", 5, 50)).alias("lht"))
    out = A.with_single_row(rows, A.train_scaler(rows, ["chb", "lht"]))
    return out.select("id", "n", S.zscore("chb", "chb_mean", "chb_std", 1.5).alias("z_hb"),
                      S.zscore("lht", "lht_mean", "lht_std", 1.5).alias("z_ht"))


@query("quartile_levels", "F37 A21", with_(MEAS_SQL, select=f"""
, x as (select id, n, case when id % 4 = 0 then 0 else price end as dose from meas),
k as (select quantile_cont(dose::double, 0.25) as q1, quantile_cont(dose::double, 0.5) as q2, quantile_cont(dose::double, 0.75) as q3 from x where dose > 0)
select id, {n8('n', 'n')}, {n8('case when dose >= q3 then 4 when dose >= q2 then 3 when dose >= q1 then 2 when dose > 0 then 1 else 0 end', 'level')} from x, k"""))
def quartile_levels(t):
    rows = meas(t).select("id", "n", F.when(F.col("id") % 4 == 0, 0.0).otherwise(F.col("price")).alias("dose"))
    cuts = A.exact_quantiles(rows.filter("dose > 0"), [], "dose", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return A.with_single_row(rows, cuts).select("id", "n", S.quartile_level("dose", "q1", "q2", "q3").alias("level"))


@query("group_quantiles", "A21", f"""
select l_returnflag, l_linestatus, {r6('quantile_cont(l_extendedprice, 0.01)', 'p01', 4)}, {r6('quantile_cont(l_extendedprice, 0.5)', 'p50', 4)}, {r6('quantile_cont(l_extendedprice, 0.99)', 'p99', 4)}
from lineitem group by 1, 2""", digits=4)
def group_quantiles(t):
    return A.exact_quantiles(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p99": 0.99})


OXY = "case when fio2_100 is null and o2flow is not null and device in (0, 2) then {a} when fio2_100 is null and o2flow is null and device in (0, 2) then 21 " \
      "when fio2_100 is null and o2flow is not null and (device is null or device in (1, 3, 4, 5, 6, 9, 10)) then {b} " \
      "when fio2_100 is null and o2flow is not null and device = 7 then {c} else fio2_100 end"


def _ladder(pairs, op):
    return "case " + " ".join(f"when o2flow {op} {a} then {b}" for a, b in pairs) + " end"


@query("stepwise_lookup", "F22", with_(MEAS_SQL, select="select id, cast(n as bigint) as n, " + r6(OXY.format(
    a=_ladder(fixed.FLOW_CANNULA, "<="), b=_ladder(fixed.FLOW_MASK, "<="),
    c="coalesce(" + _ladder(sorted(fixed.FLOW_NON_REBREATHER_HIGH, reverse=True), ">=") + ", " + _ladder(fixed.FLOW_NON_REBREATHER, "<=") + ")"), "fio2_100") + " from meas"))
def stepwise_lookup(t):
    rows = meas(t).withColumns({"dh": F.col("device"), "fh": F.col("o2flow"), "ph": F.col("fio2_100")})
    return C.oxygen_estimate(rows, "fio2_100", "dh", "fh", "ph").select("id", "n", "fio2_100")


@query("ratio_cap", "F17 F18", with_(MEAS_SQL, select=f"""
select id, {n8('n', 'n')}, {r6('case when hb / nullif(tx, 0) is not null then least(hb / nullif(tx, 0), 50) end', 'ratio')},
  {n8('coalesce(case when hb > 8 then 1 else 0 end, 0)', 'high')} from meas"""))
def ratio_cap(t):
    return meas(t).select("id", "n", S.capped_ratio("hb", "tx").alias("ratio"), S.above("hb", 8).alias("high"))


@query("cross_fill", "F19 F20 F21", with_(MEAS_SQL, select=f"""
, t1 as (select *, case when temp_f > 25 and temp_f < 45 then temp_f else temp_c end as c1, case when temp_f > 25 and temp_f < 45 then null else temp_f end as f1 from meas),
t2 as (select *, case when c1 > 70 then null else c1 end as c2, case when c1 > 70 then c1 else f1 end as f2 from t1)
select id, {n8('n', 'n')}, {r6('coalesce(diabp, (3 * meanbp - sysbp) / 2)', 'diabp')}, {r6('coalesce(meanbp, (sysbp + 2 * diabp) / 3)', 'meanbp')},
  {r6('coalesce(sysbp, 3 * meanbp - 2 * diabp)', 'sysbp')}, {r6('coalesce(c2, (f2 - 32) / 1.8)', 'temp_c')}, {r6('coalesce(f2, c2 * 1.8 + 32)', 'temp_f')},
  {r6('coalesce(hb, (ht - 1.216) / 2.862)', 'hb')}, {r6('coalesce(ht, hb * 2.862 + 1.216)', 'ht')},
  {r6('coalesce(total_bili, (direct_bili + 0.1752) / 0.6934)', 'total_bili')},
  {r6('case when coalesce(direct_bili, total_bili * 0.6934 - 0.1752) < 0 then 0 else coalesce(direct_bili, total_bili * 0.6934 - 0.1752) end', 'direct_bili')},
  {r6('coalesce(fio2_1, fio2_100 / 100)', 'fio2_1')}, {r6('coalesce(fio2_100, fio2_1 * 100)', 'fio2_100')}, {r6('hb + ht + sysbp', 'total')} from t2"""))
def cross_fill(t):
    rows = C.component_total(meas(t), ["hb", "ht", "sysbp"], "total")
    rows = C.pressure_fill(rows, "sysbp", "meanbp", "diabp")
    rows = C.temperature_fill(rows, "temp_c", "temp_f")
    rows = C.reciprocal_fill(C.blood_fill(rows), "fio2_1", "fio2_100")
    return rows.select("id", "n", "diabp", "meanbp", "sysbp", "temp_c", "temp_f", "hb", "ht", "total_bili", "direct_bili", "fio2_1", "fio2_100", "total")


@query("unit_reassign", "F23", with_(MEAS_SQL, select=f"""
select id, {n8('n', 'n')}, {r6('case when temp_c > 45 and temp_f is null then temp_c else temp_f end', 'temp_f')},
  {r6('case when temp_c > 45 and temp_f is null then null else temp_c end', 'temp_c')}, {r6('case when fio2_1 < 1 then fio2_1 * 100 else fio2_1 end', 'fio2_1')} from meas"""))
def unit_reassign(t):
    return C.units_reassigned(meas(t), "temp_c", "temp_f", "fio2_1").select("id", "n", "temp_f", "temp_c", "fio2_1")


@query("null_defaults", "F31 F29", with_(MEAS_SQL, select=f"""
, k as (select median(hb::double) as m from meas)
select id, {n8('n', 'n')}, {r6('coalesce(total_bili, 0)', 'total_bili')}, {r6('case when sysbp > 180 then 91 else sysbp end', 'sysbp')}, {r6('coalesce(hb, m)', 'hb')},
  {n8('case when device = 2 then 1 else 0 end', 'is_two')}, {n8('case when device = 2 then 1 when device = 3 then 0 end', 'two_or_three')} from meas, k"""))
def null_defaults(t):
    rows = meas(t)
    mid = A.exact_quantiles(rows, [], "hb", {"hb_median": 0.5})
    out = C.defaults_filled(A.with_single_row(rows, mid), {"total_bili": 0.0}, {"sysbp": (180, 91.0)}, {"hb": "hb_median"})
    return out.select("id", "n", "total_bili", "sysbp", "hb", S.two_way("device", 2).alias("is_two"), S.two_way("device", 2, 3).alias("two_or_three"))


Z_SQL = MEAS_SQL + """,
z as (select id, n, (q - 25) / 15 as hb, (price - 40000) / 30000 as bun, (d - 0.05) / 0.03 as creatinine, (tx - 0.04) / 0.02 as phosphate,
   (25 - q) / 10 as hr, (price - 30000) / 40000 as chloride, case when n = 7 then 1 else 0 end as done, n % 2 as bad from meas)"""


def z_rows(t):
    return meas(t).select(
        "id", "n", ((F.col("q") - 25) / 15).alias("hb"), ((F.col("price") - 40000) / 30000).alias("bun"),
        ((F.col("d") - 0.05) / 0.03).alias("creatinine"), ((F.col("tx") - 0.04) / 0.02).alias("phosphate"),
        ((25 - F.col("q")) / 10).alias("hr"), ((F.col("price") - 30000) / 40000).alias("chloride"),
        (F.col("n") == 7).cast("int").alias("done"), (F.col("n") % 2).alias("bad"),
    )


@query("severity_index", "F32 F33", with_(Z_SQL, select=f"""
select id, {n8('n', 'n')}, {r6('0.28 * greatest(-hb, 0) + 0.24 * greatest(bun, 0) + 0.24 * greatest(creatinine, 0) + 0.10 * greatest(phosphate, 0) + 0.09 * greatest(hr, 0) + 0.05 * abs(chloride)', 'severity')},
  {r6('least(greatest(1.5 + 0.4 * hb - 0.2 * bun + 0.1 * hr, 0), 3)', 'surrogate')} from z"""))
def severity_index(t):
    linear = S.linear_severity({"hb": 0.4, "bun": -0.2, "hr": 0.1}, 1.5, 0.0, 3.0)
    return z_rows(t).select("id", "n", S.hinge_severity().alias("severity"), linear.alias("surrogate"))


@query("reward_columns", "F34 F35", with_(Z_SQL, select=f"""
select id, {n8('n', 'n')}, {r6('15 - 2 * 15 * (1 / (1 + exp(-hb)))', 'terminal')}, {r6('case when done = 0 then hb - bun when bad = 0 then 15 else -15 end', 'reward')} from z"""))
def reward_columns(t):
    return z_rows(t).select("id", "n", S.terminal_reward(1 / (1 + F.exp(-F.col("hb")))).alias("terminal"),
                            S.step_reward("done", "hb", "bun", "bad").alias("reward"))


@query("direction_verdict", "F39", with_(Z_SQL, select="""
select id, cast(n as bigint) as n, case when n = 3 then 'error' when n = 4 then 'unknown' when (case when hb > 0 then 'up' else 'down' end) = (case when n % 2 = 0 then 'up' else 'down' end) then 'correct' else 'wrong' end as verdict from z"""))
def direction_verdict(t):
    rows = z_rows(t).select("id", "n", F.when(F.col("n") != 3, F.col("hb")).alias("effect"),
                            F.when(F.col("n") == 4, "unknown").when(F.col("n") % 2 == 0, "up").otherwise("down").alias("expected"))
    return rows.select("id", "n", S.verdict("effect", "expected").alias("verdict"))


@query("clinical_scores", "F36", with_(MEAS_SQL, select=f"""
, s as (select id, n, hb * 40 as pao2, fio2_1, q * 3 as hr, sysbp, meanbp, temp_c, q as rr, device as vent, price / 300 as platelets, total_bili as bili, tx as vaso,
   3 + n * 1.7 as gcs, d * 60 as crea, q * 20 as urine, total_bili * 12 as paco2, hb as wbc from meas),
r as (select *, pao2 / nullif(fio2_1, 0) as pf from s)
select id, {n8('n', 'n')}, {r6('pf', 'pf')}, {r6('hr / nullif(sysbp, 0)', 'shock')},
 {n8('''(case when pf < 100 and coalesce(vent, 0) > 0 then 4 when pf < 200 and coalesce(vent, 0) > 0 then 3 when pf < 300 then 2 when pf < 400 then 1 else 0 end)
 + (case when platelets < 20 then 4 when platelets < 50 then 3 when platelets < 100 then 2 when platelets < 150 then 1 else 0 end)
 + (case when bili >= 12 then 4 when bili >= 6 then 3 when bili >= 2 then 2 when bili >= 1.2 then 1 else 0 end)
 + (case when vaso > 0.1 then 4 when vaso > 0 then 3 when meanbp < 70 then 1 else 0 end)
 + (case when gcs < 6 then 4 when gcs < 10 then 3 when gcs < 13 then 2 when gcs < 15 then 1 else 0 end)
 + (case when crea >= 5 or urine < 200 then 4 when crea >= 3.5 or urine < 500 then 3 when crea >= 2 then 2 when crea >= 1.2 then 1 else 0 end)''', 'organ_failure')},
 {n8('''coalesce(case when temp_c > 38 or temp_c < 36 then 1 else 0 end, 0) + (case when hr > 90 then 1 else 0 end)
 + greatest(case when rr > 20 then 1 else 0 end, coalesce(case when paco2 < 32 then 1 else 0 end, 0)) + coalesce(case when wbc > 12 or wbc < 4 then 1 else 0 end, 0)''', 'inflammation')} from r"""))
def clinical_scores(t):
    s = meas(t).select(
        "id", "n", (F.col("hb") * 40).alias("pao2"), "fio2_1", (F.col("q") * 3).alias("hr"), "sysbp", "meanbp", "temp_c",
        F.col("q").alias("rr"), F.col("device").alias("vent"), (F.col("price") / 300).alias("platelets"), F.col("total_bili").alias("bili"),
        F.col("tx").alias("vaso"), (3 + F.col("n") * 1.7).alias("gcs"), (F.col("d") * 60).alias("crea"), (F.col("q") * 20).alias("urine"),
        (F.col("total_bili") * 12).alias("paco2"), F.col("hb").alias("wbc"),
    ).withColumn("pf", S.oxygen_ratio("pao2", "fio2_1"))
    return s.select(
        "id", "n", "pf", S.shock_index("hr", "sysbp").alias("shock"),
        S.organ_failure_score("pf", "vent", "platelets", "bili", "meanbp", "vaso", "gcs", "crea", "urine").alias("organ_failure"),
        S.inflammation_score("temp_c", "hr", "rr", "paco2", "wbc").alias("inflammation"),
    )


@query("drug_class_regex", "F10", "select doc_id, " + ", ".join(
    n8(f"case when regexp_matches(lower(text), '{'|'.join(p)}') then 1 else 0 end", n) for n, p in fixed.DRUG_PATTERNS.items()) + " from documents")
def drug_class_regex(t):
    return t.documents.select("doc_id", *[S.pattern_flag("text", p).alias(n) for n, p in fixed.DRUG_PATTERNS.items()])


TEXT_CLASSES = {"house": ["the ", "les "], "number": ["[0-9]{3}"], "mail": ["@"], "rare": ["licen[sc]e"]}


@query("text_classes", "F10", "select doc_id, array_to_string(list_filter([" + ", ".join(
    f"case when regexp_matches(lower(text), '{'|'.join(p)}') then '{n}' end" for n, p in TEXT_CLASSES.items()) + "], lambda x: x is not null), ',') as classes from documents")
def text_classes(t):
    return t.documents.select("doc_id", F.array_join(S.matching_classes("text", TEXT_CLASSES), ",").alias("classes"))


@query("active_count", "F42", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"select user_id, {n8('bin', 'bin')}, {n8('vaso + fluid + vent', 'n_active')} from panel"))
def active_count(t):
    return panel(t).select("user_id", "bin", S.active_count(["vaso", "fluid", "vent"]).alias("n_active"))
