"""Episode, cohort and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodia.catalog.registry import query
from episodia.catalog.roles import ADM_SQL, EV_SQL, LATE_SQL, PANEL_SQL, admissions, ev, late_stays, n8, panel, r6, with_
from episodia.functions import scalars as S
from episodia.operators import aggregates as A
from episodia.operators import intervals as I
from episodia.operators import joins as J
from episodia.operators import sequences as W
from episodia.operators.quality import require_columns
from episodia.operators.scan import Following, ordered

KINDS = ["1-URGENT", "2-HIGH"]


@query("episode_order", "W1", with_(ADM_SQL, select=f"""
select episode, subject, {n8('row_number() over (partition by subject order by starts, episode)', 'episode_order')} from adm"""))
def episode_order(t):
    out = W.row_number_in(admissions(t).select("episode", "subject", "starts"), ["subject"], ["starts", "episode"], "episode_order")
    return out.select("episode", "subject", "episode_order")


@query("return_within_30d", "J4 F4", with_(ADM_SQL, select=f"""
select a.episode, {n8("max(case when b.episode is not null and b.starts <= a.ends + interval 30 day then 1 else 0 end)", 'readmit_30d')}
from adm a left join adm b on a.subject = b.subject and b.episode <> a.episode and b.starts > a.ends
group by a.episode"""))
def return_within_30d(t):
    rows = admissions(t).select("episode", "subject", "starts", "ends")
    return J.returned_within(rows, "subject", "episode", "starts", "ends", 30).select("episode", "readmit_30d")


@query("earliest_return", "J5", with_(ADM_SQL, select=f"""
select a.episode, epoch_us(min(b.starts)) as next_start,
  {n8("case when min(b.starts) <= a.ends + interval 30 day then 1 else 0 end", 'readmit_30d')}
from adm a left join adm b on a.subject = b.subject and b.starts > a.ends
group by a.episode, a.ends"""))
def earliest_return(t):
    rows = admissions(t).select("episode", "subject", "starts", "ends")
    out = J.returned_within(rows, "subject", "episode", "starts", "ends", 30)
    return out.select("episode", "next_start", "readmit_30d")


@query("return_another_day", "J4 F4", with_(ADM_SQL, select=f"""
select a.episode, {n8("max(case when b.starts <= a.ends + interval 30 day then 1 else 0 end)", 'readmit_30d')}
from (select episode, subject, ends from adm) a left join adm b on a.subject = b.subject and b.kind <> '5-LOW' and b.starts > a.ends and cast(b.starts as date) > cast(a.ends as date)
group by a.episode"""))
def return_another_day(t):
    """Starts on the day of the end and episodes of the lowest kind do not count."""
    rows = admissions(t).select("episode", "subject", "starts", "ends", "kind")
    out = J.returned_within(rows, "subject", "episode", "starts", "ends", 30, exclude_same_day=True, counted=F.col("kind") != "5-LOW")
    return out.select("episode", "readmit_30d")


@query("prior_visits_without_current", "J6 A7 F4", with_(ADM_SQL, select=f"""
select a.episode, {n8("least(count(distinct b.episode), 4)", 'prior_visits')}
from adm a left join adm b on a.subject = b.subject and b.kind in ('1-URGENT', '2-HIGH') and b.episode <> a.episode
  and b.starts < a.starts + interval 1 day and b.starts >= a.starts + interval 1 day - interval 6 month
group by a.episode"""))
def prior_visits_without_current(t):
    """Before the second day of an episode, which itself does not count."""
    adm = admissions(t).withColumn("second", F.col("starts") + F.expr("interval 1 day")).withColumn("listed", F.col("kind").isin(KINDS))
    probes = adm.select("episode", "subject", "starts", "listed", "second", S.months_before("second", 6).cast("timestamp_ntz").alias("since"))
    visits = adm.filter("listed").select("subject", "starts")
    out = J.prior_count(probes, visits, ["subject"], "second", "since", "starts", "prior_visits", 4, exclude_current=("starts", "listed"))
    return out.select("episode", "prior_visits")


@query("prior_visits_6m_capped", "J6 A7 F4 F6", with_(ADM_SQL, select=f"""
select a.episode, {n8("least(count(distinct b.episode), 4)", 'prior_visits')}
from adm a left join adm b on a.subject = b.subject and b.kind in ('1-URGENT', '2-HIGH')
  and b.starts < a.starts and b.starts >= a.starts - interval 6 month
group by a.episode"""))
def prior_visits_6m_capped(t):
    adm = admissions(t)
    probes = adm.select("episode", "subject", "starts", S.months_before("starts", 6).cast("timestamp_ntz").alias("since"))
    visits = adm.filter(F.col("kind").isin(KINDS)).select("subject", "starts")
    out = J.prior_count(probes, visits, ["subject"], "starts", "since", "starts", "prior_visits", 4)
    return out.select("episode", "prior_visits")


@query("enrichment_chain", "J1 J2 A5 F6", with_(ADM_SQL, select=f"""
select a.episode, c.c_mktsegment as segment, n.n_name as nation, {n8('coalesce(m.top_line, 0)', 'top_line')},
  {r6('coalesce(s.spent, 0)', 'spent', 2)}
from adm a join customer c on c.c_custkey = a.subject join nation n on n.n_nationkey = c.c_nationkey
left join (select l_orderkey, max(l_linenumber) as top_line from lineitem where l_returnflag = 'R' group by 1) m on m.l_orderkey = a.episode
left join (select l_orderkey, sum(l_extendedprice) as spent from lineitem group by 1) s on s.l_orderkey = a.episode"""), digits=2)
def enrichment_chain(t):
    people = t.customer.select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    places = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    base = J.episode_frame(admissions(t).select("episode", "subject"), (people, ["subject"]), (places, ["c_nationkey"]))
    lines = t.lineitem.withColumnRenamed("l_orderkey", "episode")
    top = lines.filter("l_returnflag = 'R'").groupBy("episode").agg(F.max("l_linenumber").alias("top_line"))
    spent = lines.groupBy("episode").agg(F.sum("l_extendedprice").alias("spent"))
    out = J.enrich(base, [(top, ["episode"], {"top_line": 0}), (spent, ["episode"], {"spent": 0.0})])
    return out.select("episode", "segment", "nation", "top_line", "spent")


@query("weight_normalised_rate", "J3 F11 P4", f"""
with w as (select l_suppkey, max(l_tax) + 1 as weight from lineitem where l_tax > 0 group by 1)
select l_orderkey, l_linenumber::bigint as l_linenumber,
  {r6("case when l_linenumber = 1 then l_extendedprice / weight * 0.0833333 when l_linenumber = 2 then l_extendedprice / weight * 0.0166667 else l_extendedprice end", 'rate')}
from lineitem join w using (l_suppkey) where l_returnflag <> 'N' and l_quantity > 10""")
def weight_normalised_rate(t):
    lines = t.lineitem.withColumn("_w", F.when(F.col("l_tax") > 0, F.col("l_tax") + 1))
    heavy = J.with_key_maximum(lines, ["l_suppkey"], "_w", "weight").filter("l_returnflag != 'N' and l_quantity > 10")
    rate = S.weight_rate("l_extendedprice", "weight", "l_linenumber", {1: 0.0833333, 2: 0.0166667})
    return heavy.select("l_orderkey", "l_linenumber", rate.alias("rate"))


@query("point_in_interval", "J7 P9", f"""
with e as (select event_id, user_id, epoch_us(ts) // 1000000 as sec from events),
i as (select event_id as interval_id, user_id, sec as begins, least(sec + 3 * 86400, lead(sec) over (partition by user_id order by sec, event_id) - 1) as finishes from e)
select e.event_id, i.interval_id from e join i on i.user_id = e.user_id and e.sec between i.begins and i.finishes""")
def point_in_interval(t):
    """A stay lasts from an event to just before the user's next one, three days at most."""
    points = t.events.select("event_id", "user_id", S.epoch_seconds("ts").alias("sec"))
    following = ordered(points, ["user_id"], ["sec", "event_id"], {"following": Following("sec")})
    spans = following.select(F.col("event_id").alias("interval_id"), "user_id", F.col("sec").alias("begins"),
                             F.least(F.col("sec") + 3 * 86400, F.col("following") - 1).alias("finishes"))
    return I.points_in_intervals(points, spans, ["user_id"], "sec", "begins", "finishes", 86400).select("event_id", "interval_id")


@query("outer_merge_wide", "J14 A9", with_(EV_SQL, select=f"""
, a as (select user_id, sec, max(value) as click from ev where event_type = 'click' and value is not null group by 1, 2),
b as (select user_id, sec, max(value) as seen from ev where event_type = 'view' and value is not null group by 1, 2),
c as (select user_id, sec, max(1) as failed from ev where event_type = 'error' group by 1, 2)
select user_id, sec, {r6('click', 'click')}, {r6('seen', 'seen')}, {n8('failed', 'failed')}
from a full join b using (user_id, sec) full join c using (user_id, sec)"""))
def outer_merge_wide(t):
    e = ev(t)
    keys = ["user_id", "sec"]
    known = e.filter(F.col("value").isNotNull())
    a = known.filter("event_type = 'click'").groupBy(*keys).agg(F.max("value").alias("click"))
    b = known.filter("event_type = 'view'").groupBy(*keys).agg(F.max("value").alias("seen"))
    c = e.filter("event_type = 'error'").groupBy(*keys).agg(F.max(F.lit(1)).alias("failed"))
    return J.full_merge([a, b, c], keys)


@query("precedence_union", "J15 U3 A54", f"""
with p as (select user_id, cast(ts as date) as d, max(case when value > 30 then 1 else 0 end) as high, max(case when value > 80 then 1 else 0 end) as top
    from events where event_type = 'click' group by 1, 2),
s as (select user_id, cast(ts as date) as d, max(case when value > 30 then 1 else 0 end) as high, max(case when value > 80 then 1 else 0 end) as top
    from events where event_type = 'view' group by 1, 2)
select user_id, strftime(d, '%Y-%m-%d') as day, {n8('high', 'high')}, {n8('top', 'top')}, src from (
  select *, 'first' as src from p
  union all select s.*, 'second' from s where not exists (select 1 from p where p.user_id = s.user_id and p.d = s.d))""")
def precedence_union(t):
    def flags(kind):
        rows = t.events.filter(F.col("event_type") == kind).select("user_id", F.to_date("ts").alias("day"), "value")
        return A.flags_by_group(rows, ["user_id", "day"], {"high": F.col("value") > 30, "top": F.col("value") > 80})
    first = flags("click").withColumn("src", F.lit("first"))
    return J.precedence_union(first, flags("view").withColumn("src", F.lit("second")), ["user_id", "day"])


@query("without_outlier_episodes", "J16 U2 U4", f"""
select o_orderkey, o_custkey from orders where o_orderkey not in (
  select l_orderkey from lineitem where l_extendedprice > 90000 or l_discount > 0.09 or l_tax > 0.07)""")
def without_outlier_episodes(t):
    from episodia.operators.cleaning import outlier_keys
    bad = outlier_keys(t.lineitem, ["l_orderkey"], {"l_extendedprice": 90000, "l_discount": 0.09, "l_tax": 0.07})
    return J.without_keys(t.orders.select("o_orderkey", "o_custkey"), bad.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


@query("only_cohort_rows", "J17 J18 P3", """
select l_orderkey, l_partkey, l_suppkey from lineitem
where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT') and l_linenumber in (1, 3, 5)""")
def only_cohort_rows(t):
    cohort = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = t.lineitem.filter(F.col("l_linenumber").isin(1, 3, 5)).select("l_orderkey", "l_partkey", "l_suppkey")
    return J.only_keys(rows, cohort, ["l_orderkey"])


@query("dimension_filter", "P3 J17", """
select l_orderkey, l_partkey from lineitem where l_partkey in (select p_partkey from part where p_brand in ('Brand#1', 'Brand#7', 'Brand#12'))""")
def dimension_filter(t):
    items = t.part.filter(F.col("p_brand").isin("Brand#1", "Brand#7", "Brand#12")).select(F.col("p_partkey").alias("l_partkey"))
    return J.only_keys(t.lineitem.select("l_orderkey", "l_partkey"), items, ["l_partkey"])


@query("bag_union_tagged", "U1", """
select user_id, value, 'a' as model from events where event_type = 'click'
union all select user_id, value, 'b' from events where event_type = 'view'""")
def bag_union_tagged(t):
    def part(kind, tag):
        return t.events.filter(F.col("event_type") == kind).select("user_id", "value", F.lit(tag).alias("model"))
    return part("click", "a").unionByName(part("view", "b"))


@query("union_of_id_sets", "U2", """
select user_id from events where value > 150 union select user_id from events where event_type = 'error' and value > 100""")
def union_of_id_sets(t):
    return t.events.filter("value > 150 or (event_type = 'error' and value > 100)").select("user_id").distinct()


@query("difference_of_id_sets", "U4", """
select distinct user_id from events where event_type = 'click' except select user_id from events where event_type = 'error' and value > 100""")
def difference_of_id_sets(t):
    a = t.events.filter("event_type = 'click'").select("user_id").distinct()
    return J.without_keys(a, t.events.filter("event_type = 'error' and value > 100").select("user_id"), ["user_id"])


@query("attributes_on_bins", "J22", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
select user_id, {n8('bin', 'bin')}, {r6('hb', 'hb')}, c_mktsegment as segment, {r6('c_acctbal', 'balance', 2)}
from panel left join customer on c_custkey = user_id"""))
def attributes_on_bins(t):
    people = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return panel(t).select("user_id", "bin", "hb").join(people, "user_id", "left")


@query("three_way_episode", "J21", f"""
select o_orderkey as episode, {r6('price', 'price', 2)}, {n8('n', 'n_lines')}, {r6('disc', 'mean_discount')}
from (select o_orderkey, o_totalprice as price from orders) a
join (select l_orderkey as o_orderkey, count(*) as n from lineitem group by 1) b using (o_orderkey)
join (select l_orderkey as o_orderkey, avg(l_discount) as disc from lineitem where l_returnflag = 'A' group by 1) c using (o_orderkey)""")
def three_way_episode(t):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "episode")
    b = lines.groupBy("episode").agg(F.count(F.lit(1)).alias("n_lines"))
    c = lines.filter("l_returnflag = 'A'").groupBy("episode").agg(F.avg("l_discount").alias("mean_discount"))
    base = t.orders.select(F.col("o_orderkey").alias("episode"), F.col("o_totalprice").alias("price"))
    return J.episode_frame(base, (b, ["episode"]), (c, ["episode"]))


@query("realign_by_key", "J24", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
select p.user_id, {n8('p.bin', 'bin')}, {r6('p.hb', 'hb')}, {r6('q.bun', 'next_bun')}
from panel p join panel q on q.user_id = p.user_id and q.bin = p.bin + 1"""))
def realign_by_key(t):
    p = panel(t)
    following = p.select("user_id", (F.col("bin") - 1).alias("bin"), F.col("bun").alias("next_bun"))
    return J.realigned(p.select("user_id", "bin", "hb"), following, ["user_id", "bin"], ["next_bun"])


@query("late_patch", "J25", """
select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then null else o_orderstatus end, c_mktsegment) as disposition
from orders left join customer on c_custkey = o_custkey""")
def late_patch(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("disposition"))
    source = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.patched(rows, source, ["o_custkey"], "disposition", "c_mktsegment").select("o_orderkey", "disposition")


def cohort_tests():
    return {
        "short": F.col("los_days") < 1, "closed": F.col("status") == "F", "dear": F.col("price") > 400000,
        "urgent": F.col("kind") == "1-URGENT", "missing": F.col("late_price") > 450000,
    }
COHORT_SQL = ADM_SQL + """,
cohort as (select *, date_diff('day', starts, ends) as los_days, case when episode % 7 = 0 then null else price end as late_price from adm)"""


def cohort_base(t):
    adm = admissions(t)
    return adm.withColumns({
        "los_days": F.datediff("ends", "starts"), "late_price": F.when(F.col("episode") % 7 != 0, F.col("price")),
    })


@query("exclusion_waterfall", "A25", with_(COHORT_SQL, select="select criterion, cast(excluded as bigint) as excluded from (" + " union all ".join(
    f"select '{n}' as criterion, sum(case when {c} then 1 else 0 end) as excluded from cohort"
    for n, c in {"short": "los_days < 1", "closed": "status = 'F'", "dear": "price > 400000", "urgent": "kind = '1-URGENT'", "missing": "late_price > 450000"}.items()) + ")"))
def exclusion_waterfall(t):
    return A.exclusion_waterfall(cohort_base(t), cohort_tests())


@query("cohort_after_exclusion", "P5 P4", with_(COHORT_SQL, select="""
select episode, subject from cohort where not (coalesce(los_days < 1, false) or coalesce(status = 'F', false)
  or coalesce(price > 400000, false) or coalesce(kind = '1-URGENT', false) or coalesce(late_price > 450000, false))"""))
def cohort_after_exclusion(t):
    return cohort_base(t).filter(~A.excluded(list(cohort_tests().values()))).select("episode", "subject")


@query("complete_rows", "P6", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
select user_id, {n8('bin', 'bin')} from panel where hb is not null and bun is not null"""))
def complete_rows(t):
    return panel(t).dropna(subset=["hb", "bun"]).select("user_id", "bin")


@query("not_all_missing_rows", "P6", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
select user_id, {n8('bin', 'bin')} from panel where hb is not null or bun is not null or cr is not null"""))
def not_all_missing_rows(t):
    return panel(t).dropna(how="all", subset=["hb", "bun", "cr"]).select("user_id", "bin")


@query("status_filter", "P4", """
select l_orderkey, l_quantity from lineitem where l_returnflag <> 'N' and l_quantity is not null and l_quantity > 5 and (l_tax > 0.02 or l_discount > 0.02)""")
def status_filter(t):
    return t.lineitem.filter("l_returnflag != 'N' and l_quantity is not null and l_quantity > 5 and (l_tax > 0.02 or l_discount > 0.02)").select("l_orderkey", "l_quantity")


@query("item_remap", "P14", f"""
with dim as (select p_partkey, p_size + 100000 as grp from part where p_size <= 25)
select l_orderkey, {n8('coalesce(dim.grp, l_partkey)', 'item')} from lineitem left join dim on p_partkey = l_partkey""")
def item_remap(t):
    dim = t.part.filter("p_size <= 25").select("p_partkey", (F.col("p_size") + 100000).cast("long").alias("grp"))
    rows = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("item"))
    return J.remapped_item(rows, dim, "item", "p_partkey", "grp")


@query("text_code_map", "P8", f"""
select p_partkey, {n8("case when lower(p_name) like '%red%' then null when lower(p_type) = 'promo' then 0 when lower(p_type) in ('small', 'medium') then 1 when lower(p_type) = 'large' then 2 else p_size end", 'code')}
from part""")
def text_code_map(t):
    code = S.text_code("p_type", [(0, ["promo"]), (1, ["small", "medium"]), (2, ["large"])], "p_size")
    return t.part.select("p_partkey", F.when(~F.lower("p_name").contains("red"), code).alias("code"))


@query("numeric_coercion", "P7", f"""
select event_id, {n8("try_cast(case when event_id % 4 = 0 then event_type else regexp_extract(props, '[0-9]+') end as double)", 'k')}
from events""")
def numeric_coercion(t):
    text = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(F.regexp_extract("props", "[0-9]+", 0))
    return t.events.select("event_id", S.number_or_null(text).cast("long").alias("k"))


@query("time_parts", "F1 F2 F3 F4", with_(ADM_SQL, select=f"""
select episode, {n8('epoch(starts)', 'start_sec')}, strftime(starts, '%Y-%m-%d') as start_day,
  {n8('30 + year(starts) - 1995', 'age')}, {n8('epoch(ends) - epoch(starts)', 'stay_seconds')},
  {n8("case when ends > starts and epoch(ends) - epoch(starts) <= 5 * 86400 then 1 else 0 end", 'within_5d')},
  epoch_us(starts - interval 6 month) as six_months_before from adm"""))
def time_parts(t):
    return admissions(t).select(
        "episode", S.epoch_seconds("starts").alias("start_sec"), S.day_of("starts").alias("start_day"),
        S.age_at(F.lit(30), F.lit(1995), "starts").alias("age"), S.seconds_between("starts", "ends").alias("stay_seconds"),
        S.within_days("starts", "ends", 5).cast("int").alias("within_5d"), S.months_before("starts", 6).alias("six_months_before"),
    )


@query("text_functions", "F6 F27 F38 F7", """
select p_partkey, coalesce(nullif(trim(case when p_size % 5 = 0 then '  ' else p_type end), ''), 'none') as kind,
  cast(p_partkey as varchar) || '_' || p_brand as item_key,
  cast(case when substr(p_brand, 1, 7) in ('Brand#1', 'Brand#2') or substr(p_brand, 1, 8) in ('Brand#31') then 1 else 0 end as bigint) as hit,
  case p_type when 'PROMO' then 'Mean Promo' when 'LARGE' then 'Mean Large' else 'Other' end as label
from part""")
def text_functions(t):
    kind = S.blank_to_null(F.when(F.col("p_size") % 5 == 0, F.lit("  ")).otherwise(F.col("p_type")))
    raw = F.when(F.col("p_type").isin("PROMO", "LARGE"), F.concat(F.lit("s_mean_"), F.lower("p_type"))).otherwise(F.lit("s_other"))
    return t.part.select(
        "p_partkey", F.coalesce(kind, F.lit("none")).alias("kind"), S.composite_key("p_partkey", "p_brand").alias("item_key"),
        S.starts_with_any("p_brand", ["Brand#1", "Brand#2", "Brand#31"]).cast("int").alias("hit"), S.pretty_name(raw).alias("label"),
    )


PREFIXES = [("Brand#1", "a", 1), ("Brand#12", "b", 2), ("Brand#13", "c", 3), ("Brand#2", "d", 6), ("Brand#21", "d", 2), ("Brand#5", "a", 4)]


@query("prefix_score", "A3 F7", "with dim(prefix, category, weight) as (values " + ", ".join(str(p) for p in PREFIXES) + f"""),
codes as (select distinct l_orderkey as episode, p_brand as code from lineitem join part on p_partkey = l_partkey),
m as (select episode, code, category, weight, row_number() over (partition by episode, code order by length(prefix) desc) as rn
  from codes join dim on starts_with(code, prefix)),
c as (select episode, category, max(weight) as w from m where rn = 1 group by 1, 2)
select e.episode, {n8('coalesce(sum(w), 0)', 'score')} from (select distinct episode from codes) e left join c using (episode) group by 1""")
def prefix_score(t):
    dim = t.spark.createDataFrame(PREFIXES, "prefix string, category string, weight int")
    codes = t.lineitem.select(F.col("l_orderkey").alias("episode"), "l_partkey").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("code")), "l_partkey").select("episode", "code")
    return A.prefix_score(codes, dim, ["episode"], "code")


@query("conditional_flags_score", "A1 A2 F7", f"""
with f as (select l_orderkey as episode,
  max(case when l_returnflag = 'R' then 1 else 0 end) as mi, max(case when substr(l_returnflag, 1, 1) in ('A') and l_tax > 0.05 then 1 else 0 end) as chf,
  max(case when l_discount > 0.08 then 1 else 0 end) as renal, max(case when l_quantity > 48 then 1 else 0 end) as metastatic
  from lineitem group by 1)
select episode, {n8('mi', 'mi')}, {n8('chf', 'chf')}, {n8('renal', 'renal')}, {n8('metastatic', 'metastatic')}, {n8('mi + chf + renal * 2 + metastatic * 6', 'score')} from f""")
def conditional_flags_score(t):
    from episodia.functions.fixed_values import COMORBIDITY_WEIGHTS
    tests = {
        "mi": F.col("l_returnflag") == "R", "chf": S.starts_with_any("l_returnflag", ["A"]) & (F.col("l_tax") > 0.05),
        "renal": F.col("l_discount") > 0.08, "metastatic": F.col("l_quantity") > 48,
    }
    flags = A.flags_by_group(t.lineitem.withColumnRenamed("l_orderkey", "episode"), ["episode"], tests)
    return A.weighted_flags(flags, {c: COMORBIDITY_WEIGHTS[c] for c in tests}, "score")


@query("sum_with_units", "A4 F11", f"""
select l_suppkey, {r6("sum(case when l_linestatus = 'F' then l_quantity * 1000 else l_quantity end)", 'volume', 3)} from lineitem where l_returnflag <> 'R' group by 1""", digits=3)
def sum_with_units(t):
    volume = S.to_millilitres("l_quantity", "unit")
    rows = t.lineitem.filter("l_returnflag != 'R'").withColumn("unit", F.when(F.col("l_linestatus") == "F", "L"))
    return rows.groupBy("l_suppkey").agg(F.sum(volume).alias("volume"))


@query("max_per_key", "A5", f"""
select l_orderkey, {r6('max(l_discount)', 'top_discount')}, {r6('max(l_tax)', 'top_tax')} from lineitem where l_linestatus = 'O' group by 1""")
def max_per_key(t):
    return t.lineitem.filter("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.max("l_discount").alias("top_discount"), F.max("l_tax").alias("top_tax"))


@query("distinct_rows", "A6", "select distinct l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_returnflag from lineitem")
def distinct_rows(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag").distinct()


@query("bounds_per_episode", "A16", f"""
select user_id, {n8('min(epoch_us(ts)) // 1000000', 'first_sec')}, {n8('max(epoch_us(ts)) // 1000000', 'last_sec')} from events group by 1""")
def bounds_per_episode(t):
    rows = t.events.select("user_id", S.epoch_seconds("ts").alias("sec"))
    return rows.groupBy("user_id").agg(F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))


@query("split_initial_terminal", "P10 P11 P12", with_(ADM_SQL, select="""
, o as (select *, row_number() over (partition by subject order by starts, episode) as k, count(*) over (partition by subject) as n from adm)
select episode, case when k = 1 then 'initial' else 'terminal' end as part from o where k = 1 or k = n"""))
def split_initial_terminal(t):
    from episodia.operators.scan import RowIndex, Total, ordered
    rows = require_columns(admissions(t).select("episode", "subject", "starts"), ["episode", "starts"])
    out = ordered(rows, ["subject"], ["starts", "episode"], {"k": RowIndex(), "n": Total(F.lit(1), "count")})
    return out.filter("k = 0 or k = n - 1").select("episode", F.when(F.col("k") == 0, "initial").otherwise("terminal").alias("part"))
