"""The whole daily panel on star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodia.catalog.registry import query
from episodia.catalog.roles import n8, r6, split_sql
from episodia.functions import fixed_values as fixed
from episodia.session import written

ITEMS = [50912, 51006, 51244, 51256, 50862, 50813, 51237]
UNITS = ["Medical Intensive Care Unit (MICU)", "Emergency Department", "Med/Surg", "Vascular", "Coronary Care Unit (CCU)"]
SERVICES = ["MED", "CSURG", "TRAUM", "CCU", "XYZ"]
DRUGS = ["Vancomycin", "Heparin Sodium", "Furosemide", "PredniSONE", "Insulin", "Morphine", "Aspirin", "Ampicillin-Sulbactam"]


def inputs(t):
    """Orders as admissions; line items as the events of a stay."""
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i % len(names) + 1).cast("int"))
    adm = t.orders.select(
        F.col("o_orderkey").alias("hadm_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("admittime"),
        F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 9 as int))").alias("dischtime"),
        (F.col("o_orderkey") % 50 == 0).cast("int").alias("hospital_expire_flag"),
        F.col("o_orderpriority").alias("admission_type"), F.col("o_orderstatus").alias("admission_location"))
    people = t.customer.select(
        F.col("c_custkey").alias("subject_id"), F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("gender"),
        (10 + F.col("c_custkey") % 80).alias("anchor_age"), F.lit(1990).alias("anchor_year"))
    lines = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey").select(
        F.col("l_orderkey").alias("hadm_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("seq"), "l_returnflag",
        F.expr("o_orderdate + make_dt_interval(cast(l_partkey % 9 as int), cast(l_quantity as int))").alias("at"))
    # seven roles come from these rows, so the join runs once
    lines = written(lines, "lines")
    line = F.col("l_linenumber")
    supp, part = F.col("l_suppkey"), F.col("l_partkey")
    later = lambda days: F.expr(f"at + make_dt_interval(cast({days} as int))")
    return {
        "admissions": adm, "patients": people,
        "severity": lines.select("hadm_id", F.when(F.col("l_returnflag") == "A", "APR").otherwise("HCFA").alias("drg_type"),
                                 line.alias("drg_severity"), (line % 4).alias("drg_mortality")),
        "comorbidity": lines.groupBy("hadm_id").agg(F.max(supp % 7).alias("charlson_score")),
        "transfers": lines.filter(line <= 3).select(
            "hadm_id", F.col("seq").alias("transfer_id"), pick(UNITS, supp).alias("careunit"), F.when(line == 3, "discharge").otherwise("transfer").alias("eventtype"),
            F.col("at").alias("intime"), F.when(supp % 4 != 0, later("l_suppkey % 4")).alias("outtime")),
        "services": lines.filter(line == 4).select("hadm_id", F.col("seq").alias("service_id"), pick(SERVICES, supp).alias("curr_service"), F.col("at").alias("transfertime")),
        "labs": lines.filter(line.isin(5, 6)).select(
            "hadm_id", pick(ITEMS, supp).alias("itemid"), F.col("at").alias("charttime"), F.when(part % 11 != 0, F.col("l_extendedprice") / 10000).alias("valuenum")),
        "cultures": lines.filter(line == 7).select(
            "hadm_id", F.when(part % 2 == 0, F.col("at")).alias("charttime"), F.to_date("at").cast("timestamp_ntz").alias("chartdate"),
            F.when(part % 3 != 0, "ORG").alias("org_name"), F.when(supp % 2 == 0, "BLOOD CULTURE").otherwise("URINE").alias("spec_type_desc")),
        "prescriptions": lines.filter(line.isin(1, 4, 6)).select(
            "hadm_id", pick(DRUGS, supp).alias("drug"), F.when(supp % 9 == 0, "BASE").otherwise("MAIN").alias("drug_type"), F.col("at").alias("starttime"),
            F.when(part % 10 != 0, later("l_quantity % 6")).alias("stoptime")),
    }


def _pick(names, i):
    quoted = ", ".join(f"'{n}'" if isinstance(n, str) else str(n) for n in names)
    return f"[{quoted}][{i} % {len(names)} + 1]"


LABS = ["creatinine", "bun", "inr", "albumin", "nlr"]
LIMIT = {"creatinine": 2, "bun": 2, "inr": 3, "nlr": 3, "albumin": 5}
CLASSES = list(fixed.DRUG_PATTERNS)
ICU = "(careunit like '%Intensive Care%' or careunit = 'Coronary Care Unit (CCU)')"
GROUP = f"""case when careunit is null then 'other' when {ICU} then 'icu' when careunit like '%Emergency Department%' then 'ed'
   when careunit like '%Med/Surg%' then 'medicine' when careunit like '%Vascular%' then 'surgery' else 'other' end"""
SQL = f"""
with ln as (select l_orderkey as hadm_id, l_partkey as part, l_suppkey as supp, l_linenumber as line, l_quantity as q, l_extendedprice as price, l_partkey * 100000 + l_suppkey as seq, l_returnflag,
    o_orderdate + to_days(cast(l_partkey % 9 as integer)) + to_hours(cast(l_quantity as integer)) as tm from lineitem join orders on o_orderkey = l_orderkey),
adm as (select o_orderkey as hadm_id, o_custkey as subject_id, o_orderdate as admittime, o_orderdate + to_days(cast(o_orderkey % 9 as integer)) as dischtime,
    o_orderpriority as admission_type, 10 + o_custkey % 80 + year(o_orderdate) - 1990 as age from orders),
sp0 as (select *, cast(unnest(generate_series(cast(admittime as date), cast(dischtime as date), interval 1 day)) as date) as d from adm where age >= 18 and cast(dischtime as date) > cast(admittime as date)),
sp as (select *, date_diff('day', cast(admittime as date), d) as day_of_stay, case when d = cast(dischtime as date) then 1 else 0 end as is_last_day from sp0),
sev as (select hadm_id, max(line) as drg_severity, max(line % 4) as drg_mortality from ln where l_returnflag = 'A' group by 1),
cc as (select hadm_id, max(supp % 7) as charlson from ln group by 1),
tr as (select hadm_id, seq, {_pick(UNITS, 'supp')} as careunit, case when line = 3 then 'discharge' else 'transfer' end as kind, tm as intime, cast(tm as date) as indate,
    cast(case when supp % 4 = 0 then tm + interval 1 day else tm + to_days(cast(supp % 4 as integer)) end as date) as outdate from ln where line <= 3),
loc as (select hadm_id, d, careunit, indate from (select s.hadm_id, s.d, t.careunit, t.indate, row_number() over (partition by s.hadm_id, s.d
    order by case when s.d >= t.indate and s.d < t.outdate then 1 else 0 end desc, t.intime desc, t.seq desc) as rn
    from sp s left join tr t on t.hadm_id = s.hadm_id and t.kind <> 'discharge' and t.indate <= s.d) where rn = 1),
sv as (select hadm_id, d, svc from (select s.hadm_id, s.d, {_pick(SERVICES, 'v.supp')} as svc, row_number() over (partition by s.hadm_id, s.d order by v.tm desc, v.seq desc) as rn
    from sp s left join ln v on v.hadm_id = s.hadm_id and v.line = 4 and cast(v.tm as date) <= s.d) where rn = 1),
lb as (select hadm_id, cast(tm as date) as d, {_pick(ITEMS, 'supp')} as item, price / 10000 as v from ln where line in (5, 6) and part % 11 <> 0),
lw as (select hadm_id, d, avg(v) filter (item = 50912) as creatinine, avg(v) filter (item = 51006) as bun, avg(v) filter (item = 51237) as inr, avg(v) filter (item = 50862) as albumin,
    avg(v) filter (item = 51256) / nullif(avg(v) filter (item = 51244), 0) as ratio, coalesce(case when avg(v) filter (item = 50813) > 2.0 then 1 else 0 end, 0) as lact, count(distinct item) as n_labs from lb group by 1, 2),
cu as (select hadm_id, cast(tm as date) as d, max(case when part % 3 <> 0 then 1 else 0 end) as pos, max(case when part % 3 <> 0 and supp % 2 = 0 then 1 else 0 end) as blood from ln where line = 7 group by 1, 2),
rx0 as (select hadm_id, lower({_pick(DRUGS, 'supp')}) as drug, cast(tm as date) as a, case when part % 10 = 0 then cast(tm as date) + 1 else cast(tm + to_days(cast(q % 6 as integer)) as date) end as b
    from ln where line in (1, 4, 6) and supp % 9 <> 0),
rx as (select *, {", ".join(f"case when regexp_matches(drug, '{'|'.join(p)}') then 1 else 0 end as {c}" for c, p in fixed.DRUG_PATTERNS.items())} from rx0),
act as (select hadm_id, d, {", ".join(f"max({c}) as {c}" for c in CLASSES)} from (select *, cast(unnest(generate_series(a, b - 1, interval 1 day)) as date) as d from rx where b > a) group by 1, 2),
ast as (select distinct hadm_id, a as d from rx where antibiotic = 1), asp as (select distinct hadm_id, b as d from rx where antibiotic = 1),
mv as (select *, case when {ICU} then 1 else 0 end as icu, lag(case when {ICU} then 1 else 0 end) over (partition by hadm_id order by intime, seq) as prev from tr where kind <> 'discharge'),
mvd as (select hadm_id, indate as d, max(case when icu = 1 and prev = 0 then 1 else 0 end) as esc, max(case when icu = 0 and prev = 1 then 1 else 0 end) as stp from mv group by 1, 2),
dc as (select distinct hadm_id, indate as d from tr where kind = 'discharge'),
rd as (select a.hadm_id, case when min(b.admittime) <= a.dischtime + interval 30 day then 1 else 0 end as r from adm a left join adm b on a.subject_id = b.subject_id and b.admittime > a.dischtime group by a.hadm_id, a.dischtime)
select sp.hadm_id, sp.subject_id, {n8('day_of_stay', 'day_of_stay')}, strftime(sp.d, '%Y-%m-%d') as calendar_date, {n8('is_last_day', 'is_last_day')}, {n8('age', 'age_at_admit')},
  case when sp.subject_id % 2 = 0 then 'M' else 'F' end as gender, admission_type, {n8('drg_severity', 'drg_severity')}, {n8('drg_mortality', 'drg_mortality')}, {n8('charlson', 'charlson_score')},
  {GROUP} as careunit_group, {n8(f'case when {ICU} then 1 else 0 end', 'is_icu')}, {n8("coalesce(date_diff('day', indate, sp.d), 0)", 'days_in_current_unit')},
  case svc when 'MED' then 'medicine' when 'CSURG' then 'surgery' when 'TRAUM' then 'trauma' when 'CCU' then 'icu_svc' else 'other' end as curr_service_group,
  {", ".join(r6(f"last_value({'least(ratio, 50)' if c == 'nlr' else c} ignore nulls) over (partition by sp.hadm_id order by day_of_stay rows between {LIMIT[c]} preceding and current row)", c) for c in LABS).replace("least(ratio, 50)", "case when ratio is not null then least(ratio, 50) end")},
  {n8('coalesce(lact, 0)', 'lactate_elevated')}, {n8('coalesce(n_labs, 0)', 'n_labs_today')}, {n8('case when pos is null then 0 else 1 end', 'culture_ordered_today')},
  {n8('max(coalesce(pos, 0)) over (partition by sp.hadm_id order by day_of_stay rows unbounded preceding)', 'positive_culture_cumulative')},
  {n8('max(coalesce(blood, 0)) over (partition by sp.hadm_id order by day_of_stay rows unbounded preceding)', 'blood_culture_positive_cumulative')},
  {", ".join(n8(f'coalesce(act.{c}, 0)', f'{c}_active') for c in CLASSES)}, {n8('case when ast.hadm_id is null then 0 else 1 end', 'antibiotic_started')}, {n8('case when asp.hadm_id is null then 0 else 1 end', 'antibiotic_stopped')},
  {n8('coalesce(esc, 0)', 'icu_escalation')}, {n8('coalesce(stp, 0)', 'icu_stepdown')}, {n8('case when dc.hadm_id is null then 0 else 1 end', 'discharged')},
  {n8(' + '.join(f'coalesce(act.{c}, 0)' for c in CLASSES), 'n_active_drug_classes')}, {n8('r', 'readmit_30d')}, {split_sql('sp.subject_id')} as split
from sp left join sev using (hadm_id) left join cc using (hadm_id) left join loc on loc.hadm_id = sp.hadm_id and loc.d = sp.d left join sv on sv.hadm_id = sp.hadm_id and sv.d = sp.d
left join lw on lw.hadm_id = sp.hadm_id and lw.d = sp.d left join cu on cu.hadm_id = sp.hadm_id and cu.d = sp.d left join act on act.hadm_id = sp.hadm_id and act.d = sp.d
left join ast on ast.hadm_id = sp.hadm_id and ast.d = sp.d left join asp on asp.hadm_id = sp.hadm_id and asp.d = sp.d left join mvd on mvd.hadm_id = sp.hadm_id and mvd.d = sp.d
left join dc on dc.hadm_id = sp.hadm_id and dc.d = sp.d left join rd on rd.hadm_id = sp.hadm_id"""
SHOWN = [
    "hadm_id", "subject_id", "day_of_stay", "calendar_date", "is_last_day", "age_at_admit", "gender", "admission_type", "drg_severity", "drg_mortality", "charlson_score",
    "careunit_group", "is_icu", "days_in_current_unit", "curr_service_group", *LABS, "lactate_elevated", "n_labs_today", "culture_ordered_today",
    "positive_culture_cumulative", "blood_culture_positive_cumulative", *[f"{c}_active" for c in CLASSES], "antibiotic_started", "antibiotic_stopped",
    "icu_escalation", "icu_stepdown", "discharged", "n_active_drug_classes", "readmit_30d", "split",
]


@query("daily_panel", "W19 J1 J2 J5 J11 J12 J13 J19 A1 A5 A7 A8 A10 W7 W8 W12 F3 F8 F9 F10 F17 F18 F41 F42 T7 P1 P15", SQL)
def daily_panel(t):
    from episodia.plans.daily import build_daily_panel
    return build_daily_panel(inputs(t), "2024-01-01T00:00:00+00:00").select(*SHOWN)
