"""Interval and time-bin queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodia.catalog.registry import query
from episodia.catalog.roles import (
    BINS_SQL, EV_SQL, IV_SQL, LATE_SQL, PANEL_SQL, WIDTH, ev, intervals, late_stays, n8, panel, r6, with_,
)
from episodia.functions import scalars as S
from episodia.operators import aggregates as A
from episodia.operators import intervals as I
from episodia.operators import sweeps as W
from episodia.operators.joins import enrich

KEY = ["user_id"]
FRAME = ("start_sec", "end_sec", WIDTH)
HITS_SQL = """hits as (select b.user_id, b.bin, i.*exclude(user_id), least(i.finishes, b.t1) - greatest(i.begins, b.t0) as overlap
    from bins b join iv i on i.user_id = b.user_id and i.begins < b.t1 and i.finishes > b.t0 and i.finishes > i.begins)"""


@query("bin_spine", "W20", with_(LATE_SQL, BINS_SQL, select=f"select user_id, {n8('bin', 'bin')}, {n8('t0', 'bin_start')}, {n8('t1', 'bin_end')} from bins"))
def bin_spine(t):
    return I.bin_spine(late_stays(t), *FRAME).select("user_id", "bin", "bin_start", "bin_end")


@query("bin_means", "A11", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"select user_id, {n8('bin', 'bin')}, {r6('hb', 'hb')}, {r6('bun', 'bun')}, {r6('cr', 'cr')} from panel"))
def bin_means(t):
    return panel(t).select("user_id", "bin", "hb", "bun", "cr")


@query("interval_volume_per_bin", "J8 A12", with_(EV_SQL, IV_SQL, LATE_SQL, BINS_SQL, HITS_SQL, select=f"""
select user_id, {n8('bin', 'bin')}, {r6('sum(rate * overlap / 3600.0)', 'volume')} from hits group by 1, bin"""))
def interval_volume_per_bin(t):
    return I.volume_per_bin(intervals(t), late_stays(t), KEY, "begins", "finishes", "rate", *FRAME)


@query("any_overlap_flag", "J10", with_(EV_SQL, IV_SQL, LATE_SQL, BINS_SQL, select=f"""
select b.user_id, {n8('b.bin', 'bin')}, {n8("max(case when event_type = 'click' then 1 else 0 end)", 'click_active')},
  {n8("max(case when event_type = 'error' then 1 else 0 end)", 'error_active')}
from bins b join iv i on i.user_id = b.user_id and event_type in ('click', 'error')
  and ((i.begins < b.t1 and i.finishes > b.t0) or (i.begins >= b.t0 and i.begins < b.t1)) group by b.user_id, b.bin"""))
def any_overlap_flag(t):
    names = {"click": "click_active", "error": "error_active"}
    return I.active_flags_per_bin(intervals(t), late_stays(t), KEY, "begins", "finishes", "event_type", names, *FRAME)


@query("active_rate_median_max", "J9 A14 A21", with_(EV_SQL, IV_SQL, LATE_SQL, BINS_SQL, select=f"""
select b.user_id, {n8('b.bin', 'bin')}, {r6('median(rate::double)', 'median_rate')}, {r6('max(rate)', 'max_rate')}
from bins b join iv i on i.user_id = b.user_id and rate is not null
  and ((i.begins < b.t1 and i.finishes > b.t0) or (i.begins >= b.t0 and i.begins < b.t1)) group by b.user_id, b.bin"""))
def active_rate_median_max(t):
    rates = I.active_rates_per_bin(intervals(t), late_stays(t), KEY, "begins", "finishes", "rate", *FRAME)
    return A.exact_quantiles(rates, ["user_id", "bin"], "rate", {"median_rate": 0.5, "max_rate": 1.0})


# intervals of up to thirty days, which touch up to 180 bins each
LONG_SQL = """li as (select * replace (begins + (event_id % 31) * 86400 as finishes) from iv),
lh as (select b.user_id, b.bin, i.*exclude(user_id), least(i.finishes, b.t1) - greatest(i.begins, b.t0) as overlap
    from bins b join li i on i.user_id = b.user_id and i.begins < b.t1 and i.finishes > b.t0 and i.finishes > i.begins),
la as (select b.user_id, b.bin, i.rate, i.event_type from bins b join li i on i.user_id = b.user_id
    and ((i.begins < b.t1 and i.finishes > b.t0) or (i.begins >= b.t0 and i.begins < b.t1)))"""


def long_intervals(t):
    return intervals(t).withColumn("finishes", F.col("begins") + (F.col("event_id") % 31) * 86400)


def spine_bins(t):
    return I.bin_spine(late_stays(t), *FRAME).select("user_id", "bin")


@query("swept_volume", "J8 A12", with_(EV_SQL, IV_SQL, LATE_SQL, BINS_SQL, LONG_SQL, select=f"""
select user_id, {n8('bin', 'bin')}, {r6('sum(rate * overlap / 3600.0)', 'volume', 4)} from lh group by 1, bin"""), digits=4)
def swept_volume(t):
    return W.volume_at(long_intervals(t), spine_bins(t), late_stays(t), KEY, "begins", "finishes", "rate", "start_sec", WIDTH)


@query("swept_flags", "J10", with_(EV_SQL, IV_SQL, LATE_SQL, BINS_SQL, LONG_SQL, select=f"""
select user_id, {n8('bin', 'bin')}, {n8("max(case when event_type = 'click' then 1 else 0 end)", 'click_active')}, {n8("max(case when event_type = 'error' then 1 else 0 end)", 'error_active')}
from la where event_type in ('click', 'error') group by 1, bin"""))
def swept_flags(t):
    names = {"click": "click_active", "error": "error_active"}
    return W.flags_at(long_intervals(t), spine_bins(t), late_stays(t), KEY, "begins", "finishes", "event_type", names, "start_sec", WIDTH)


@query("swept_rates", "J9 A14 A21", with_(EV_SQL, IV_SQL, LATE_SQL, BINS_SQL, LONG_SQL, select=f"""
select user_id, {n8('bin', 'bin')}, {r6('median(rate::double)', 'median_rate')}, {r6('max(rate)', 'max_rate')} from la where rate is not null group by 1, bin"""))
def swept_rates(t):
    return W.rates_at(long_intervals(t), spine_bins(t), late_stays(t), KEY, "begins", "finishes", "rate", "start_sec", WIDTH, "median_rate", "max_rate")


@query("point_sums", "A13", with_(EV_SQL, IV_SQL, LATE_SQL, select=f"""
select e.user_id, {n8('(e.begins - l.start_sec) // 14400', 'bin')}, {r6('sum(e.amount)', 'bolus')}
from iv e join late l using (user_id) where e.rate is null and e.begins >= l.start_sec
  and (e.begins - l.start_sec) // 14400 < cast(ceil((l.end_sec - l.start_sec) / 14400.0) as bigint) group by 1, 2"""))
def point_sums(t):
    placed = I.points_to_bins(intervals(t).filter("rate is null"), late_stays(t), KEY, "begins", *FRAME)
    return placed.groupBy("user_id", "bin").agg(F.sum("amount").alias("bolus"))


@query("opening_balance", "A15", with_(EV_SQL, IV_SQL, LATE_SQL, select=f"""
select l.user_id, {r6('coalesce((select sum(amount) from iv where iv.user_id = l.user_id and rate is null and begins < l.start_sec), 0)', 'opening_points')},
  {r6('coalesce((select sum(rate * (least(finishes, l.start_sec) - begins) / 3600.0) from iv where iv.user_id = l.user_id and least(finishes, l.start_sec) > begins), 0)', 'opening_volume')}
from late l"""))
def opening_balance(t):
    stays, iv = late_stays(t), intervals(t)
    a = I.totals_before(iv.filter("rate is null"), stays, KEY, "begins", "amount", "start_sec", "opening_points")
    b = I.volume_before(iv, stays, KEY, "begins", "finishes", "rate", "start_sec", "opening_volume")
    return a.select("user_id", "opening_points").join(b.select("user_id", "opening_volume"), "user_id")


@query("running_balance", "W9 J8 A12 A13 A15", with_(EV_SQL, IV_SQL, LATE_SQL, BINS_SQL, HITS_SQL, PANEL_SQL, select=f"""
, vol as (select user_id, bin, sum(rate * overlap / 3600.0) as v from hits group by 1, 2),
uo as (select e.user_id, (e.begins - l.start_sec) // 14400 as bin, sum(e.amount) as u from iv e join late l using (user_id)
   where e.rate is null and e.begins >= l.start_sec group by 1, 2),
op as (select l.user_id, coalesce(sum(case when rate is null and begins < l.start_sec then amount end), 0) as o from late l left join iv using (user_id) group by 1)
select p.user_id, {n8('p.bin', 'bin')}, {r6('sum(coalesce(v, 0)) over w', 'gain_total', 4)}, {r6('o + sum(coalesce(u, 0)) over w', 'loss_total', 4)},
  {r6('sum(coalesce(v, 0)) over w - (o + sum(coalesce(u, 0)) over w)', 'balance', 4)}
from panel p left join vol on vol.user_id = p.user_id and vol.bin = p.bin left join uo on uo.user_id = p.user_id and uo.bin = p.bin
join op on op.user_id = p.user_id window w as (partition by p.user_id order by p.bin rows unbounded preceding)"""), digits=4)
def running_balance(t):
    return balance(t, False)


@query("running_balance_carried", "W9 J8 A12 A13 A15", with_(EV_SQL, IV_SQL, LATE_SQL, BINS_SQL, HITS_SQL, PANEL_SQL, select=f"""
, vol as (select user_id, bin, sum(rate * overlap / 3600.0) as v, 0 as u, 0 as p from hits group by 1, 2),
uo as (select e.user_id, (e.begins - l.start_sec) // 14400 as bin, 0 as v, sum(e.amount) as u, 0 as p from iv e join late l using (user_id)
   where e.rate is null and e.begins >= l.start_sec and (e.begins - l.start_sec) // 14400 < cast(ceil((l.end_sec - l.start_sec) / 14400.0) as bigint) group by 1, 2),
op as (select l.user_id, coalesce(sum(case when rate is null and begins < l.start_sec then amount end), 0) as o from late l left join iv using (user_id) group by 1),
every as (select user_id, bin, sum(coalesce(v, 0)) as v, sum(coalesce(u, 0)) as u, max(p) as p from (from vol union all from uo union all select user_id, bin, 0, 0, 1 from panel) group by 1, 2),
tot as (select user_id, bin, p, sum(v) over w as g, sum(u) over w as l from every window w as (partition by user_id order by bin rows unbounded preceding))
select user_id, {n8('bin', 'bin')}, {r6('g', 'gain_total', 4)}, {r6('o + l', 'loss_total', 4)}, {r6('g - (o + l)', 'balance', 4)} from tot join op using (user_id) where p = 1"""), digits=4)
def running_balance_carried(t):
    """Volumes in bins without a reading are carried to the next bin that has one."""
    return balance(t, True)


def balance(t, carried):
    stays, iv = late_stays(t), intervals(t)
    volume = I.volume_per_bin(iv, stays, KEY, "begins", "finishes", "rate", *FRAME)
    points = I.points_to_bins(iv.filter("rate is null"), stays, KEY, "begins", *FRAME)
    loss = points.groupBy("user_id", "bin").agg(F.sum("amount").alias("loss"))
    opening = I.totals_before(iv.filter("rate is null"), stays, KEY, "begins", "amount", "start_sec", "opening").select("user_id", "opening")
    bins = enrich(panel(t).select("user_id", "bin"), [
        (volume, ["user_id", "bin"], {"volume": 0.0}), (loss, ["user_id", "bin"], {"loss": 0.0}), (opening, ["user_id"], {"opening": 0.0})])
    out = I.running_balance(bins.withColumn("zero", F.lit(0.0)), KEY, "bin", "volume", "loss", "zero", "opening", [volume, loss] if carried else [])
    return out.select("user_id", "bin", "gain_total", "loss_total", "balance")


@query("infusion_rates", "F12 F11 F28", with_(EV_SQL, IV_SQL, select=f"""
select event_id, {r6('amount * rate / nullif(amount, 0)', 'norm_rate')}, {n8('case when coalesce(rate, 0) > 0 then 1 else 0 end', 'given')},
  {n8('case when coalesce(rate, 0) > 0 or amount > 8 then 1 else 0 end', 'either')}, {r6('amount * 1.8 + 32', 'f')}, {r6('(amount - 32) / 1.8', 'c')} from iv"""))
def infusion_rates(t):
    return intervals(t).select(
        "event_id", S.infusion_rate("amount", "rate", "amount").alias("norm_rate"), S.dose_flag("rate").alias("given"),
        S.any_flag("rate", F.col("amount") - 8).alias("either"), S.fahrenheit("amount").alias("f"), S.celsius("amount").alias("c"),
    )
