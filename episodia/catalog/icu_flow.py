"""The four-hour panel on events, from long events to dosed bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodia.catalog.registry import query
from episodia.catalog.roles import EV_SQL, IV_SQL, LATE_SQL, BINS_SQL, ev, intervals, late_stays, n8, r6, with_
from episodia.functions import fixed_values as fixed
from episodia.plans import icu
from episodia.session import durable

ITEMS = [("click", "sysbp"), ("view", "meanbp"), ("purchase", "creatinine"), ("signup", "hr"), ("error", "hb")]
FIELDS = ["sysbp", "meanbp", "diabp", "creatinine", "hr", "hb"]
HOURS = {c: fixed.HOLD_HOURS.get(c, fixed.LAB_HOLD_HOURS) for c in FIELDS}
WIDE_SQL = "w0 as (select e.user_id, sec, " + ", ".join(
    f"arg_min(case when event_type = '{i}' then value end, case when event_type = '{i}' and value is not null then event_id end) as {f}" for i, f in ITEMS
) + """, null::double as diabp from ev e join late l using (user_id) where value is not null and sec between l.start_sec and l.end_sec group by 1, 2)"""


def _bounded(c: str) -> str:
    lo, hi = fixed.BOUNDS[c]
    return f"case when {c} <= {fixed.SENTINEL_ABOVE} and {c} between {lo} and {hi} then {c} end as {c}"


CLEAN_SQL = f"""w1 as (select user_id, sec, {", ".join(_bounded(c) for c in FIELDS)} from w0),
w2 as (select user_id, sec, coalesce(sysbp, 3 * meanbp - 2 * diabp) as sysbp, coalesce(meanbp, (sysbp + 2 * diabp) / 3) as meanbp, coalesce(diabp, (3 * meanbp - sysbp) / 2) as diabp, creatinine, hr, hb from w1),
w3 as (select user_id, sec, {", ".join(f"case when sec - last_value(case when {c} is not null then sec end ignore nulls) over w <= {h} * 3600 then last_value({c} ignore nulls) over w end as {c}" for c, h in HOURS.items())}
   from w2 window w as (partition by user_id order by sec rows unbounded preceding)),
st as (select w3.user_id, (sec - l.start_sec) // 14400 as bin, {", ".join(f"avg({c}) as {c}" for c in FIELDS)} from w3 join late l using (user_id)
   where (sec - l.start_sec) // 14400 < cast(ceil((l.end_sec - l.start_sec) / 14400.0) as bigint) group by 1, 2)"""
DOSE_SQL = """fl as (select *, case when rate is null or amount = 0 then null else (amount * 2) * rate / amount end as nr, amount * 2 as tev from iv where event_type in ('click', 'view')),
inf as (select b.user_id, b.bin, sum(nr * (least(finishes, t1) - greatest(begins, t0)) / 3600.0) as v from bins b join fl on fl.user_id = b.user_id and nr is not null and begins < t1 and finishes > t0 and finishes > begins group by 1, 2),
bol as (select b.user_id, b.bin, sum(tev) as v from bins b join fl on fl.user_id = b.user_id and nr is null and begins >= t0 and begins < t1 group by 1, 2),
uo as (select b.user_id, b.bin, sum(amount) as v from bins b join iv on iv.user_id = b.user_id and event_type = 'error' and begins >= t0 and begins < t1 group by 1, 2),
va as (select b.user_id, b.bin, median(rate::double) as med, max(rate) as top from bins b join iv on iv.user_id = b.user_id and event_type = 'purchase' and rate is not null
   and ((begins < t1 and finishes > t0) or (begins >= t0 and begins < t1)) group by 1, 2),
dr as (select b.user_id, b.bin, max(case when event_type = 'signup' then 1 else 0 end) as s, max(case when event_type = 'view' then 1 else 0 end) as v from bins b join iv on iv.user_id = b.user_id and event_type in ('signup', 'view')
   and ((begins < t1 and finishes > t0) or (begins >= t0 and begins < t1)) group by 1, 2),
op as (select l.user_id, coalesce((select sum(nr * (least(finishes, l.start_sec) - begins) / 3600.0) from fl where fl.user_id = l.user_id and least(finishes, l.start_sec) > begins), 0)
     + coalesce((select sum(tev) from fl where fl.user_id = l.user_id and nr is null and begins < l.start_sec), 0) as i0,
     coalesce((select sum(amount) from iv where iv.user_id = l.user_id and event_type = 'error' and begins < l.start_sec), 0) as o0 from late l),
p as (select st.*, coalesce(inf.v, 0) + coalesce(bol.v, 0) as istep, coalesce(uo.v, 0) as ostep, coalesce(med, 0) as med, coalesce(top, 0) as top, coalesce(s, 0) as s, coalesce(dr.v, 0) as v, i0, o0
   from st left join inf on inf.user_id = st.user_id and inf.bin = st.bin left join bol on bol.user_id = st.user_id and bol.bin = st.bin left join uo on uo.user_id = st.user_id and uo.bin = st.bin
   left join va on va.user_id = st.user_id and va.bin = st.bin left join dr on dr.user_id = st.user_id and dr.bin = st.bin join op on op.user_id = st.user_id),
kept as (select *, i0 + sum(istep) over w as itot, o0 + sum(ostep) over w as otot from p where user_id not in (select user_id from p where ostep > 12000 or istep > 10000)
   window w as (partition by user_id order by bin rows unbounded preceding)),
q as (select quantile_cont(top::double, 0.25) filter (top > 0) as v1, quantile_cont(top::double, 0.5) filter (top > 0) as v2, quantile_cont(top::double, 0.75) filter (top > 0) as v3,
   quantile_cont(round(istep, 6), 0.25) filter (istep > 0) as f1, quantile_cont(round(istep, 6), 0.5) filter (istep > 0) as f2, quantile_cont(round(istep, 6), 0.75) filter (istep > 0) as f3 from kept)"""


@query("icu_panel", "P3 P9 P14 A9 J14 F13 F19 F20 F23 W6 A11 J7 J8 J9 J10 A12 A13 A14 A15 W9 W20 J22 J16 U2 F12 F37 A21 F31", with_(EV_SQL, IV_SQL, LATE_SQL, BINS_SQL, WIDE_SQL, CLEAN_SQL, DOSE_SQL, select=f"""
select user_id as stay, {n8('bin', 'bin')}, {", ".join(r6(c, c, 4) for c in FIELDS)}, {r6('istep', 'input_step', 4)}, {r6('ostep', 'output_step', 4)}, {r6('itot', 'input_total', 4)}, {r6('otot', 'output_total', 4)},
  {r6('itot - otot', 'cumulated_balance', 4)}, {r6('med', 'median_dose_vaso', 4)}, {n8('s', 'signup_active')}, {n8('v', 'view_active')},
  {n8('case when top >= v3 then 4 when top >= v2 then 3 when top >= v1 then 2 when top > 0 then 1 else 0 end', 'vasopressor_dose')},
  {n8('case when round(istep, 6) >= f3 then 4 when round(istep, 6) >= f2 then 3 when round(istep, 6) >= f1 then 2 when istep > 0 then 1 else 0 end', 'ivfluid_dose')} from kept, q"""), digits=4)
def icu_panel(t):
    return dosed_panel(t).select("stay", "bin", *FIELDS, "input_step", "output_step", "input_total", "output_total", "cumulated_balance",
                                 "median_dose_vaso", "signup_active", "view_active", "vasopressor_dose", "ivfluid_dose")


def dosed_panel(t):
    iv = intervals(t).select(F.col("user_id").alias("stay"), "event_type", F.col("begins").alias("starttime"), F.col("finishes").alias("endtime"), "amount", F.col("rate").cast("double").alias("rate"))
    stays = late_stays(t).select(F.col("user_id").alias("stay"), F.col("start_sec").alias("intime"), F.col("end_sec").alias("outtime"))
    events = ev(t).select(F.col("user_id").alias("stay"), F.col("sec").alias("at"), F.col("event_type").alias("item"), "value", F.lit(0).alias("priority"), F.col("event_id").alias("seq"))
    items = t.spark.createDataFrame(ITEMS, "item string, field string")
    wide = icu.wide_states(events, items, stays, [f for _, f in ITEMS]).withColumn("diabp", F.lit(None).cast("double"))
    states = icu.clean_states(wide)
    fluids = iv.filter("event_type in ('click', 'view')").withColumn("tev", F.col("amount") * 2)
    panel = icu.binned_panel(
        states, stays, fluids, iv.filter("event_type = 'purchase'").withColumnRenamed("rate", "ratestd"),
        iv.filter("event_type in ('signup', 'view')").withColumnRenamed("event_type", "drug_class"),
        iv.filter("event_type = 'error'").select("stay", F.col("starttime").alias("at"), F.col("amount").alias("value")), ["signup", "view"])
    # sums of many fractions differ in the last digit by order; the doses compare values
    return icu.dataset(panel.withColumn("input_step", F.round("input_step", 6)))


def icu_replay(t):
    """From events to the replay table: panel, doses, filled features and scores, scaled states and rewards.

    Measures that the events do not have stay unknown, which the scores count as normal.
    """
    from episodia.plans.replay import replay_table
    absent = ["pao2", "fio2_1", "mechvent", "platelets", "total_bili", "gcs", "temp_c", "rr", "paco2", "wbc"]
    rows = dosed_panel(t).withColumns({c: F.lit(None).cast("double") for c in absent}).withColumn("readmit_30d", (F.col("stay") % 5 == 0).cast("int"))
    final = durable(icu.final_features(durable(rows), FIELDS))
    return replay_table(final, entity="stay", step="bin", dynamic={c: fixed.BOUNDS[c] for c in FIELDS if c != "diabp"}, static={}, logged=[], actions=["vaso", "fluid"],
                        sources={"vaso": "vasopressor_dose", "fluid": "ivfluid_dose"}, keep=["sofa", "sirs"])


@query("icu_replay_flow", "P9 P15 M20 F43 W5 T8 F24", with_(EV_SQL, IV_SQL, LATE_SQL, BINS_SQL, WIDE_SQL, CLEAN_SQL, DOSE_SQL, select=f"""
, ids as (select user_id, row_number() over (order by user_id) - 1 as i, count(*) over () as n from (select distinct user_id from kept))
select kept.user_id as stay, {n8('bin', 'bin')}, case when i < floor(n * 0.7) then 'train' when i < floor(n * 0.7) + floor(n * 0.15) then 'val' else 'test' end as split,
  {n8('case when lead(bin) over (partition by kept.user_id order by bin) is null then 1 else 0 end', 'done')},
  {n8('case when top > 0 then 1 else 0 end + case when istep > 0 then 2 else 0 end', 'a')}, 0::bigint as n_unknown from kept join ids using (user_id)"""))
def icu_replay_flow(t):
    """What does not follow from the filled values, which have no SQL, and how many of these are still unknown."""
    rows = icu_replay(t)
    states = [c for c in rows.columns if c.startswith("s_")]
    unknown = sum((F.col(c).isNull() | F.isnan(c)).cast("int") for c in [*states, "r"])
    return rows.select("stay", "bin", "split", "done", "a", unknown.alias("n_unknown"))
