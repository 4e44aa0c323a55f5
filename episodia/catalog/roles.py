"""Roles the star-schema tables play, as DataFrames and as SQL text.

Every role exists twice: a function that derives it with Spark and a SQL
fragment for the comparison run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodia.functions.scalars import epoch_seconds

ITEMS = ["click", "view", "purchase", "signup", "error"]

# events with nulls on every seventh row and whole seconds
EV_SQL = """ev as (
    select event_id, ts, user_id, event_type, cast(ts as date) as day,
           case when event_id % 7 = 0 then null else value end as value,
           epoch_us(ts) // 1000000 as sec
    from events)"""


def ev(t) -> DataFrame:
    e = t.events
    return e.select(
        "event_id", "ts", "user_id", "event_type", F.to_date("ts").alias("day"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        epoch_seconds("ts").alias("sec"),
    )


# one stay per user, from the first to the last event
STAY_SQL = """stay as (
    select user_id, min(ts) as intime, max(ts) as outtime,
           min(epoch_us(ts) // 1000000) as start_sec, max(epoch_us(ts) // 1000000) as end_sec
    from events group by user_id)"""


def stays(t) -> DataFrame:
    return t.events.groupBy("user_id").agg(
        F.min("ts").alias("intime"), F.max("ts").alias("outtime"),
        F.min(epoch_seconds("ts")).alias("start_sec"), F.max(epoch_seconds("ts")).alias("end_sec"),
    )


# orders as admissions of a customer
ADM_SQL = """adm as (
    select o_orderkey as episode, o_custkey as subject, o_orderdate as starts,
           o_orderdate + to_days(cast(o_orderkey % 9 as integer)) as ends,
           o_orderpriority as kind, o_totalprice as price, o_orderstatus as status
    from orders)"""


def admissions(t) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("episode"), F.col("o_custkey").alias("subject"),
        F.col("o_orderdate").alias("starts"),
        F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 9 as int))").alias("ends"),
        F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
    )


# events as intervals in epoch seconds: up to 30 hours, some without duration
IV_SQL = """iv as (
    select event_id, user_id, event_type, sec as begins, sec + (event_id % 31) * 3600 as finishes,
           case when event_id % 5 = 0 then null else 1 + event_id % 13 end as rate,
           cast(event_id % 17 as double) as amount
    from ev)"""


def intervals(t) -> DataFrame:
    return ev(t).select(
        "event_id", "user_id", "event_type", F.col("sec").alias("begins"),
        (F.col("sec") + (F.col("event_id") % 31) * 3600).alias("finishes"),
        F.when(F.col("event_id") % 5 != 0, 1 + F.col("event_id") % 13).alias("rate"),
        (F.col("event_id") % 17).cast("double").alias("amount"),
    )


# user stays that begin a day after the first event, so some events come early
LATE_SQL = """late as (
    select user_id, min(epoch_us(ts) // 1000000) + 86400 as start_sec,
           max(epoch_us(ts) // 1000000) as end_sec
    from events group by user_id
    having max(epoch_us(ts) // 1000000) > min(epoch_us(ts) // 1000000) + 86400)"""


def late_stays(t) -> DataFrame:
    s = t.events.groupBy("user_id").agg(
        (F.min(epoch_seconds("ts")) + 86400).alias("start_sec"), F.max(epoch_seconds("ts")).alias("end_sec")
    )
    return s.filter("end_sec > start_sec")


BINS_SQL = """bins as (
    select user_id, start_sec, end_sec, b as bin, start_sec + b * 14400 as t0, start_sec + (b + 1) * 14400 as t1
    from (select *, unnest(generate_series(0, cast(ceil((end_sec - start_sec) / 14400.0) as bigint) - 1)) as b from late))"""
WIDTH = 14400

# binned user panel: means of three items per occupied 4-hour bin
PANEL_SQL = """panel as (
    select e.user_id, (e.sec - l.start_sec) // 14400 as bin,
           avg(case when event_type = 'click' then value end) as hb,
           avg(case when event_type in ('view', 'error') then value end) as bun,
           avg(case when event_type in ('purchase', 'signup') then value end) as cr,
           max(case when event_type = 'error' then 1 else 0 end) as vaso,
           max(case when event_type = 'purchase' then 1 else 0 end) as fluid,
           max(case when event_type = 'signup' then 1 else 0 end) as vent
    from ev e join late l using (user_id)
    where e.sec >= l.start_sec
      and (e.sec - l.start_sec) // 14400 < cast(ceil((l.end_sec - l.start_sec) / 14400.0) as bigint)
    group by 1, 2)"""


def panel(t) -> DataFrame:
    from episodia.operators.intervals import points_to_bins

    placed = points_to_bins(ev(t), late_stays(t), ["user_id"], "sec", "start_sec", "end_sec", WIDTH)
    kind = F.col("event_type")
    return placed.groupBy("user_id", "bin").agg(
        F.avg(F.when(kind == "click", F.col("value"))).alias("hb"),
        F.avg(F.when(kind.isin("view", "error"), F.col("value"))).alias("bun"),
        F.avg(F.when(kind.isin("purchase", "signup"), F.col("value"))).alias("cr"),
        F.max((kind == "error").cast("int")).alias("vaso"),
        F.max((kind == "purchase").cast("int")).alias("fluid"),
        F.max((kind == "signup").cast("int")).alias("vent"),
    )


def uniform_sql(*parts: str) -> str:
    """SQL for the hash number of :func:`episodia.functions.scalars.uniform`."""
    key = " || ':' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"(cast(cast('0x' || substr(sha256({key}), 1, 16) as uhugeint) as double) / 18446744073709551616.0)"


def split_sql(subject: str, seed: int = 42, names=("train", "valid", "test")) -> str:
    u = uniform_sql("'split'", str(seed), subject)
    return f"case when {u} < 0.7 then '{names[0]}' when {u} < 0.85 then '{names[1]}' else '{names[2]}' end"


def with_(*ctes: str, select: str) -> str:
    """CTEs and a final select; a select that starts with a comma adds CTEs."""
    text = select.strip()
    return "with " + ",\n".join(ctes) + ("" if text.startswith(",") else "\n") + text


def r6(expr: str, name: str, digits: int = 6) -> str:
    """Rounded double; the small shift decides ties the same way in both engines."""
    return f"round(cast({expr} as double) + 1e-{digits + 3}, {digits}) + 0.0 as {name}"


def n8(expr: str, name: str) -> str:
    return f"cast({expr} as bigint) as {name}"
