"""Daily panel queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodia.catalog.registry import Tables, query
from episodia.catalog.roles import ADM_SQL, EV_SQL, ITEMS, STAY_SQL, admissions, ev, n8, r6, split_sql, stays, with_
from episodia.functions import scalars as S
from episodia.operators import aggregates as A
from episodia.operators import intervals as I
from episodia.operators import joins as J
from episodia.operators import sequences as W
from episodia.operators.sampling import hash_split
from episodia.operators.scan import Following, ordered, panel_window
from episodia.sources.tables import bucketed, co_located

SPINE_SQL = """spine as (
    select user_id, d, date_diff('day', first_day, d) as day_of_stay, case when d = last_day then 1 else 0 end as is_last_day
    from (select user_id, cast(intime as date) as first_day, cast(outtime as date) as last_day,
                 cast(unnest(generate_series(cast(intime as date), cast(outtime as date), interval 1 day)) as date) as d
          from stay where cast(outtime as date) > cast(intime as date)))"""
WIDE_SQL = "wide as (select user_id, day as d, " + ", ".join(
    f"avg(case when event_type = '{i}' then value end) as \"{i}\"" for i in ITEMS
) + " from ev where value is not null group by 1, 2)"


def user_spine(t):
    return I.day_spine(stays(t), "intime", "outtime").select("user_id", "calendar_date", "day_of_stay", "is_last_day")


def user_panel(t):
    """Spine with daily item means; events are reduced per day before they join."""
    wide = A.mean_wide(ev(t).filter(F.col("value").isNotNull()), ["user_id", "day"], "event_type", "value",
                       {i: i for i in ITEMS})
    return user_spine(t).join(wide.withColumnRenamed("day", "calendar_date"), ["user_id", "calendar_date"], "left")


@query("day_spine_panel", "W19 A8 A10 W7 W2 W5 F5 T7 F2", with_(EV_SQL, STAY_SQL, SPINE_SQL, WIDE_SQL, select=f"""
, j as (select spine.*, wide.* exclude (user_id, d) from spine left join wide using (user_id, d)),
f as (select user_id, d, day_of_stay, is_last_day,
    last_value(click ignore nulls) over (partition by user_id order by day_of_stay rows between 2 preceding and current row) as click,
    last_value("view" ignore nulls) over (partition by user_id order by day_of_stay rows between 3 preceding and current row) as "view",
    last_value(purchase ignore nulls) over (partition by user_id order by day_of_stay rows between 5 preceding and current row) as purchase
  from j)
select user_id, strftime(d, '%Y-%m-%d') as calendar_date, {n8('day_of_stay', 'day_of_stay')}, {n8('is_last_day', 'is_last_day')},
  {r6('click', 'click')}, {r6('"view"', '"view"')}, {r6('purchase', 'purchase')},
  {r6('lead(click) over w', 'next_click')}, {r6('lead("view") over w', 'next_view')},
  {n8('case when lead(d) over w is null then 1 else 0 end', 'done')}, {split_sql('user_id')} as split
from f window w as (partition by user_id order by day_of_stay)"""))
def day_spine_panel(t):
    filled = W.filled_forward(user_panel(t), ["user_id"], "day_of_stay", {"click": 2, "view": 3, "purchase": 5})
    w = panel_window(["user_id"], ["day_of_stay"])
    out = filled.select(
        "user_id", "calendar_date", "day_of_stay", "is_last_day", "click", "view", "purchase",
        F.lead("click").over(w).alias("next_click"), F.lead("view").over(w).alias("next_view"),
        F.lead("day_of_stay").over(w).isNull().cast("int").alias("done"),
    )
    return hash_split(out, "user_id")


@query("episode_days", "W19 F41 F2", with_(ADM_SQL, select=f"""
select episode, strftime(d, '%Y-%m-%d') as calendar_date, {n8("date_diff('day', cast(starts as date), d)", 'day_of_stay')},
  {n8("case when d = cast(ends as date) then 1 else 0 end", 'is_last_day')}
from (select *, cast(unnest(generate_series(cast(starts as date), cast(ends as date), interval 1 day)) as date) as d
      from adm where cast(ends as date) > cast(starts as date))"""))
def episode_days(t):
    return I.day_spine(admissions(t), "starts", "ends").select("episode", "calendar_date", "day_of_stay", "is_last_day")


@query("item_day_means", "A8 P4", with_(EV_SQL, select=f"""
select user_id, strftime(day, '%Y-%m-%d') as day, event_type, {r6('avg(value)', 'mean_value')}, {n8('count(*)', 'n_values')}
from ev where value is not null group by user_id, ev.day, event_type"""))
def item_day_means(t):
    return A.item_means(ev(t), ["user_id", "day"], "event_type", "value")


@query("distinct_items_per_day", "A7", with_(EV_SQL, select=f"""
select user_id, strftime(day, '%Y-%m-%d') as day, {n8('least(count(distinct event_type), 4)', 'n_items')}
from ev where value is not null group by user_id, ev.day"""))
def distinct_items_per_day(t):
    rows = ev(t).filter(F.col("value").isNotNull())
    return rows.groupBy("user_id", "day").agg(F.least(F.countDistinct("event_type"), F.lit(4)).alias("n_items"))


@query("pivot_mean", "A10", with_(EV_SQL, WIDE_SQL, select="select user_id, strftime(d, '%Y-%m-%d') as day, "
       + ", ".join(r6(f'"{i}"', f'"{i}"') for i in ITEMS) + " from wide"))
def pivot_mean(t):
    return A.mean_wide(ev(t).filter(F.col("value").isNotNull()), ["user_id", "day"], "event_type", "value", {i: i for i in ITEMS})


@query("pivot_first", "A9", with_(EV_SQL, select="select user_id, strftime(day, '%Y-%m-%d') as day, " + ", ".join(
    r6(f"arg_min(case when event_type = '{i}' then value end, case when event_type = '{i}' and value is not null then sec * 1000000 + event_id end)", f'"{i}"')
    for i in ITEMS) + " from ev group by user_id, ev.day"))
def pivot_first(t):
    return A.first_value_wide(ev(t), ["user_id", "day"], "event_type", "value", ITEMS, ["sec", "event_id"])


@query("daily_flags_latched", "W8 A1 J19", with_(EV_SQL, STAY_SQL, SPINE_SQL, select=f"""
, micro as (select user_id, day as d, max(case when value > 100 then 1 else 0 end) as pos,
    max(case when value > 100 and event_type = 'error' then 1 else 0 end) as blood from ev group by 1, 2)
select user_id, {n8('day_of_stay', 'day_of_stay')}, {n8('case when micro.pos is null then 0 else 1 end', 'ordered_today')},
  {n8('max(coalesce(pos, 0)) over w', 'positive_ever')}, {n8('max(coalesce(blood, 0)) over w', 'blood_ever')}
from spine left join micro using (user_id, d)
window w as (partition by user_id order by day_of_stay rows unbounded preceding)"""))
def daily_flags_latched(t):
    tests = {"positive": F.col("value") > 100, "blood": (F.col("value") > 100) & (F.col("event_type") == "error")}
    hits = A.flags_by_group(ev(t), ["user_id", "day"], tests).withColumnRenamed("day", "calendar_date")
    joined = J.enrich(user_spine(t), [(hits.withColumn("ordered_today", F.lit(1)), ["user_id", "calendar_date"],
                                       {"positive": 0, "blood": 0, "ordered_today": 0})])
    out = W.latched(joined, ["user_id"], "day_of_stay", {"positive": "positive_ever", "blood": "blood_ever"})
    return out.select("user_id", "day_of_stay", "ordered_today", "positive_ever", "blood_ever")


@query("co_located_panel", "IO7 IO11 W8 W2 A10 J19", with_(EV_SQL, STAY_SQL, SPINE_SQL, WIDE_SQL, select=f"""
, micro as (select user_id, day as d, max(case when value > 100 then 1 else 0 end) as pos from ev group by 1, 2)
select user_id, {n8('day_of_stay', 'day_of_stay')}, {r6('click', 'click')}, {n8('max(coalesce(pos, 0)) over w', 'positive_ever')}, {r6('lead(click) over w2', 'next_click')}
from spine left join micro using (user_id, d) left join wide using (user_id, d)
window w as (partition by user_id order by day_of_stay rows unbounded preceding), w2 as (partition by user_id order by day_of_stay)"""))
def co_located_panel(t):
    return bucketed_panel(t)


def bucketed_panel(t):
    """Spine, daily means and flags bucketed by user: they meet and are windowed without another exchange."""
    here = Tables(co_located(t.spark), t.folder)
    days = {"user_id": F.col("user_id"), "calendar_date": F.col("day")}
    means = A.mean_wide(ev(here).filter(F.col("value").isNotNull()), ["user_id", "day"], "event_type", "value", {i: i for i in ITEMS})
    hits = A.flags_by_group(ev(here), ["user_id", "day"], {"positive": F.col("value") > 100})
    parts = [bucketed(x.select(*[c.alias(n) for n, c in days.items()], *kept), ["user_id"], ["calendar_date"]) for x, kept in ((means, ["click"]), (hits, ["positive"]))]
    spine = bucketed(user_spine(here), ["user_id"], ["calendar_date"])
    joined = J.enrich(spine, [(p, ["user_id", "calendar_date"], fill) for p, fill in zip(parts, ({}, {"positive": 0}))])
    w = panel_window(["user_id"], ["day_of_stay"])
    latched = F.max("positive").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("user_id", "day_of_stay", "click", latched.alias("positive_ever"), F.lead("click").over(w).alias("next_click"))


# care units: every event starts a stretch in a unit, until the user's next event
UNITS = {"click": "Medical Intensive Care Unit (MICU)", "view": "Emergency Department", "purchase": "Med/Surg",
         "signup": "Vascular", "error": "Coronary Care Unit (CCU)"}
UNIT_SQL = """units as (
    select user_id, event_id, ts as intime, cast(ts as date) as indate,
      lead(ts) over (partition by user_id order by ts, event_id) as outtime,
      case event_type when 'click' then 'Medical Intensive Care Unit (MICU)' when 'view' then 'Emergency Department'
           when 'purchase' then 'Med/Surg' when 'signup' then 'Vascular' else 'Coronary Care Unit (CCU)' end as unit
    from events)"""
GROUP_SQL = """case when unit = 'Coronary Care Unit (CCU)' or unit like '%Intensive Care%' then 'icu'
    when unit like '%Emergency Department%' then 'ed' when unit like '%Med/Surg%' or unit like '%Medicine%' then 'medicine'
    when unit like '%Surgery%' or unit like '%Vascular%' or unit like '%Transplant%' then 'surgery' else 'other' end"""


def unit_stretches(t):
    pairs = [F.lit(x) for kv in UNITS.items() for x in kv]
    stretches = t.events.select("user_id", "event_id", F.col("ts").alias("intime"), F.element_at(F.create_map(*pairs), F.col("event_type")).alias("unit"))
    return ordered(stretches, ["user_id"], ["intime", "event_id"], {"outtime": Following("intime")})


@query("unit_by_day", "J13 F8 F41", with_(STAY_SQL, SPINE_SQL, UNIT_SQL, select=f"""
, c as (select s.user_id, s.d, s.day_of_stay, u.unit, u.indate, u.intime, u.event_id,
    case when s.d >= u.indate and s.d < cast(coalesce(u.outtime, u.intime + interval 1 day) as date) then 1 else 0 end as inside
  from spine s left join units u on u.user_id = s.user_id and u.indate <= s.d),
b as (select *, row_number() over (partition by user_id, d order by inside desc, intime desc, event_id desc) as rn from c)
select user_id, {n8('day_of_stay', 'day_of_stay')}, case when unit is null then 'other' else {GROUP_SQL} end as unit_group,
  {n8("coalesce(date_diff('day', indate, d), 0)", 'days_in_unit')}
from b where rn = 1"""))
def unit_by_day(t):
    found = I.containing_interval(user_spine(t), unit_stretches(t), ["user_id"], "calendar_date", "intime", "outtime",
                                  ["event_id"], ["unit"])
    return found.select(
        "user_id", "day_of_stay", F.coalesce(S.care_unit_group("unit"), F.lit("other")).alias("unit_group"),
        F.coalesce(S.day_count(F.to_date("matched_start"), "calendar_date"), F.lit(0)).alias("days_in_unit"),
    )


@query("service_by_day", "J12 F9", with_(STAY_SQL, SPINE_SQL, select=f"""
, svc as (select user_id, cast(ts as date) as svc_date, ts, event_id,
    case event_type when 'click' then 'MED' when 'view' then 'CSURG' when 'purchase' then 'TRAUM' when 'signup' then 'CCU' else 'XYZ' end as service
  from events),
c as (select s.user_id, s.d, s.day_of_stay, v.service,
    row_number() over (partition by s.user_id, s.d order by v.ts desc, v.event_id desc) as rn
  from spine s left join svc v on v.user_id = s.user_id and v.svc_date <= s.d)
select user_id, {n8('day_of_stay', 'day_of_stay')},
  case service when 'MED' then 'medicine' when 'CSURG' then 'surgery' when 'TRAUM' then 'trauma' when 'CCU' then 'icu_svc' else 'other' end as service_group
from c where rn = 1"""))
def service_by_day(t):
    codes = {"click": "MED", "view": "CSURG", "purchase": "TRAUM", "signup": "CCU", "error": "XYZ"}
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    services = t.events.select(
        "user_id", "ts", "event_id", F.to_date("ts").alias("svc_date"),
        F.element_at(F.create_map(*pairs), F.col("event_type")).alias("service"),
    )
    found = J.as_of(user_spine(t), services, ["user_id"], "calendar_date", "svc_date", ["ts", "event_id"])
    from episodia.functions.fixed_values import SERVICE_GROUPS
    return found.select("user_id", "day_of_stay", S.code_group("service", SERVICE_GROUPS).alias("service_group"))


CLASSES = {"warm": ["red", "hot"], "tools": ["bolt", "gear"], "ring": ["RING"]}


@query("active_classes_by_day", "J11 F10 F42 A1", f"""
with rx as (
  select l_orderkey as episode, cast(l_shipdate as date) as start_date,
    cast(l_shipdate as date) + cast(l_quantity as integer) % 6 as stop_date, lower(p_name) as drug
  from lineitem join part on p_partkey = l_partkey),
flags as (select episode, start_date, stop_date,
    case when regexp_matches(drug, 'red|hot') then 1 else 0 end as warm,
    case when regexp_matches(drug, 'bolt|gear') then 1 else 0 end as tools,
    case when regexp_matches(drug, 'ring') then 1 else 0 end as ring from rx),
days as (select *, cast(unnest(generate_series(start_date, stop_date - 1, interval 1 day)) as date) as d
  from flags where stop_date > start_date)
select episode, strftime(d, '%Y-%m-%d') as calendar_date, {n8('max(warm)', 'warm')}, {n8('max(tools)', 'tools')}, {n8('max(ring)', 'ring')},
  {n8('max(warm) + max(tools) + max(ring)', 'n_active')}
from days where warm + tools + ring > 0 group by episode, d""")
def active_classes_by_day(t):
    rx = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").select(
        F.col("l_orderkey").alias("episode"), F.to_date("l_shipdate").alias("start_date"),
        F.date_add(F.to_date("l_shipdate"), (F.col("l_quantity").cast("int") % 6)).alias("stop_date"),
        *[S.pattern_flag("p_name", p).alias(n) for n, p in CLASSES.items()],
    )
    hit = rx.filter(S.active_count(list(CLASSES)) > 0)
    days = I.interval_days(hit, "start_date", "stop_date")
    out = days.groupBy("episode", "calendar_date").agg(*[F.max(n).alias(n) for n in CLASSES])
    return out.withColumn("n_active", S.active_count(list(CLASSES)))


@query("started_and_stopped", "J19 J11", f"""
with rx as (select l_orderkey as episode, cast(l_shipdate as date) as a, cast(l_shipdate as date) + cast(l_quantity as integer) % 6 as b
  from lineitem where l_discount > 0.05),
days as (select episode, a as d from rx union select episode, b from rx)
select d.episode, strftime(d.d, '%Y-%m-%d') as calendar_date,
  {n8('case when exists (select 1 from rx where rx.episode = d.episode and rx.a = d.d) then 1 else 0 end', 'started')},
  {n8('case when exists (select 1 from rx where rx.episode = d.episode and rx.b = d.d) then 1 else 0 end', 'stopped')}
from days d""")
def started_and_stopped(t):
    rx = t.lineitem.filter("l_discount > 0.05").select(
        F.col("l_orderkey").alias("episode"), F.to_date("l_shipdate").alias("a"),
        F.date_add(F.to_date("l_shipdate"), (F.col("l_quantity").cast("int") % 6)).alias("b"),
    )
    marks = rx.select("episode", F.inline(F.array(
        F.struct(F.col("a").alias("calendar_date"), F.lit(1).alias("started"), F.lit(0).alias("stopped")),
        F.struct(F.col("b").alias("calendar_date"), F.lit(0).alias("started"), F.lit(1).alias("stopped")),
    )))
    return marks.groupBy("episode", "calendar_date").agg(F.max("started").alias("started"), F.max("stopped").alias("stopped"))


@query("unit_transitions", "W12", f"""
with e as (select *, case when event_type in ('purchase', 'signup') then 1 else 0 end as inside,
    lag(case when event_type in ('purchase', 'signup') then 1 else 0 end) over (partition by user_id order by ts, event_id) as prev from events)
select user_id, event_id, {n8('case when inside = 1 and prev = 0 then 1 else 0 end', 'entered')},
  {n8('case when inside = 0 and prev = 1 then 1 else 0 end', 'left_unit')} from e""")
def unit_transitions(t):
    rows = t.events.select("user_id", "event_id", "ts", F.col("event_type").isin("purchase", "signup").cast("int").alias("inside"))
    return W.entries_and_exits(rows, ["user_id"], ["ts", "event_id"], "inside").select("user_id", "event_id", "entered", "left_unit")


@query("measured_flags", "J19 J20", with_(EV_SQL, STAY_SQL, SPINE_SQL, select=f"""
select user_id, {n8('day_of_stay', 'day_of_stay')},
  {n8("coalesce(max(case when event_type = 'click' then 1 end), 0)", 'click_measured')},
  {n8("coalesce(max(case when event_type = 'view' then 1 end), 0)", 'view_measured')},
  {n8("case when count(distinct case when event_type in ('error', 'signup') then event_type end) = 2 then 1 else 0 end", 'both_measured')}
from spine left join (select * from ev where value is not null) e on e.user_id = spine.user_id and e.day = spine.d
group by spine.user_id, day_of_stay""").replace("select user_id, cast(day_of_stay", "select spine.user_id as user_id, cast(day_of_stay"))
def measured_flags(t):
    hits = ev(t).filter(F.col("value").isNotNull()).withColumnRenamed("day", "calendar_date")
    keys = ["user_id", "calendar_date"]
    out = J.presence_flags(user_spine(t), hits, keys, "event_type", {"click": "click_measured", "view": "view_measured"})
    out = J.all_items_flag(out, hits, keys, "event_type", ["error", "signup"], "both_measured")
    return out.select("user_id", "day_of_stay", "click_measured", "view_measured", "both_measured")
