"""Transition, replay and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodia.catalog.registry import query
from episodia.catalog.roles import EV_SQL, LATE_SQL, PANEL_SQL, ev, n8, panel, r6, uniform_sql, with_
from episodia.functions import fixed_values as fixed
from episodia.functions import scalars as S
from episodia.operators import aggregates as A
from episodia.operators import sampling as T
from episodia.operators import sequences as W

K, O = ["user_id"], ["ts", "event_id"]
WIN = "(partition by user_id order by ts, event_id)"


@query("next_state_transitions", "W2 W3 W5 W10 F27 P2", with_(EV_SQL, select=f"""
select event_id, {n8(f'row_number() over {WIN} - 1', 'episode_step')}, {r6(f'lead(value) over {WIN}', 'next_value')},
  lead(event_type) over {WIN} as next_type, {n8(f'case when lead(event_id) over {WIN} is null then 1 else 0 end', 'done')},
  cast(user_id as varchar) || '_' || cast(event_id as varchar) as transition_id from ev"""))
def next_state_transitions(t):
    out = W.next_state(ev(t), K, O, ["value", "event_type"], index="episode_step")
    return out.withColumnsRenamed({"next_event_type": "next_type"}).select(
        "event_id", "episode_step", "next_value", "next_type", "done", S.composite_key("user_id", "event_id").alias("transition_id"))


@query("jump_label", "W4", with_(EV_SQL, select=f"""
select event_id, {n8(f'coalesce(case when lead(value) over {WIN} - value >= 20 then 1 else 0 end, 0)', 'y_next')} from ev"""))
def jump_label(t):
    out = W.next_state(ev(t).select("user_id", "ts", "event_id", "value"), K, O, ["value"])
    return out.select("event_id", W.jump_label("value", "next_value", 20).alias("y_next"))


@query("done_flag", "W5", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
select user_id, {n8('bin', 'bin')}, {n8('case when bin = max(bin) over (partition by user_id) then 1 else 0 end', 'done')} from panel"""))
def done_flag(t):
    out = W.next_state(panel(t).select("user_id", "bin"), K, ["bin"], ["bin"])
    return out.select("user_id", "bin", "done")


@query("row_index", "W10", f"select event_id, {n8(f'row_number() over {WIN} - 1', 'step')} from events")
def row_index(t):
    return W.row_number_in(t.events.select("user_id", "ts", "event_id"), K, O, "step", 0).select("event_id", "step")


@query("episode_bounds", "W11", with_(EV_SQL, select=f"""
select event_id, {n8('min(sec) over (partition by user_id)', 'first_start')}, {n8('max(sec) over (partition by user_id)', 'last_end')} from ev"""))
def episode_bounds(t):
    rows = ev(t).select("user_id", "ts", "event_id", "sec")
    return W.episode_bounds(rows, K, O, "sec", "sec").select("event_id", "first_start", "last_end")


@query("latched_rows", "W8", with_(EV_SQL, select=f"""
select event_id, {n8(f'max(case when value > 150 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding)', 'seen_high')} from ev"""))
def latched_rows(t):
    rows = ev(t).select("user_id", "ts", "event_id", F.coalesce((F.col("value") > 150).cast("int"), F.lit(0)).alias("high"))
    return W.latched_rows(rows, K, O, "high", "seen_high").select("event_id", "seen_high")


@query("running_totals", "W9", with_(EV_SQL, select=f"""
select event_id, {r6('sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding)', 'total', 4)} from ev"""), digits=4)
def running_totals(t):
    rows = ev(t).select("user_id", "ts", "event_id", "value")
    return W.running_totals(rows, K, O, {"value": "total"}).select("event_id", "total")


REPLAY_SQL = PANEL_SQL + f""",
full_panel as (select *, case when user_id % 5 = 0 then 1 else 0 end as bad_end, coalesce(hb, 0) as sofa from panel),
ids as (select user_id, row_number() over (order by user_id) - 1 as i, count(*) over () as n from (select distinct user_id from full_panel)),
sp as (select user_id, case when i < floor(n * 0.7) then 'train' when i < floor(n * 0.7) + floor(n * 0.15) then 'val' else 'test' end as split from ids),
pre as (select p.*, sp.split, case when hb is not null then least(greatest(hb, 1), 150) end as c_hb, case when bun is not null then ln(1 + least(greatest(bun, 1), 200)) end as c_bun
   from full_panel p join sp using (user_id)),
k as (select avg(c_hb) as mh, stddev_samp(c_hb) as sh, avg(c_bun) as mb, stddev_samp(c_bun) as sb from pre where split = 'train'),
z as (select pre.*, case when c_hb is not null then least(greatest((c_hb - mh) / sh, -5), 5) end as s_hb, case when c_bun is not null then least(greatest((c_bun - mb) / sb, -5), 5) end as s_bun from pre, k),
rp as (select *, vaso + 2 * fluid + 4 * vent as a, lead(bin) over w is null as last_row, coalesce(lead(s_hb) over w, 0) as s_next_hb, coalesce(lead(s_bun) over w, 0) as s_next_bun,
   lead(sofa) over w as sofa_next from z window w as (partition by user_id order by bin))"""


def replay_rows(t):
    """Replay table of the binned panel: split, scaled states, actions, rewards."""
    from episodia.plans.replay import replay_table

    rows = panel(t).withColumns({
        "bad_end": (F.col("user_id") % 5 == 0).cast("int"), "sofa": F.coalesce("hb", F.lit(0.0)),
    })
    return replay_table(
        rows, entity="user_id", step="bin", dynamic={"hb": (1, 150), "bun": (1, 200)}, static={}, logged=["bun"],
        actions=["vaso", "fluid", "vent"], severity="sofa", bad_end="bad_end",
    )


@query("replay_table", "F24 F28 F35 F43 W2 W5 T8 A22 F14 F15 F16 P1", with_(EV_SQL, LATE_SQL, REPLAY_SQL, select=f"""
select user_id, {n8('bin', 'bin')}, split, {n8('case when last_row then 1 else 0 end', 'done')}, {n8('a', 'a')}, {r6('s_hb', 's_hb', 5)}, {r6('s_bun', 's_bun', 5)},
  {r6('s_next_hb', 's_next_hb', 5)}, {r6('s_next_bun', 's_next_bun', 5)},
  {r6('case when not last_row then sofa - sofa_next when bad_end = 0 then 15 else -15 end', 'r', 5)} from rp"""), digits=5)
def replay_table_query(t):
    return replay_rows(t).select("user_id", "bin", "split", "done", "a", "s_hb", "s_bun", "s_next_hb", "s_next_bun", "r")


@query("action_decode", "F25 F24", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
select user_id, {n8('bin', 'bin')}, {n8('vaso + 2 * fluid + 4 * vent', 'a')}, {n8('vaso', 'b0')}, {n8('fluid', 'b1')}, {n8('vent', 'b2')} from panel"""))
def action_decode(t):
    rows = panel(t).select("user_id", "bin", S.encode_bits(["vaso", "fluid", "vent"]).alias("a"))
    return rows.select("*", *[S.decode_bit("a", i).alias(f"b{i}") for i in range(3)])


LABELS = {
    (0, 0, 0): "A_NONE", (1, 0, 0): "A_VASO", (0, 1, 0): "A_VENT", (0, 0, 1): "A_CRRT", (1, 1, 0): "A_VASO_VENT",
    (1, 0, 1): "A_VASO_CRRT", (0, 1, 1): "A_VENT_CRRT", (1, 1, 1): "A_VASO_VENT_CRRT",
}


@query("action_label", "F26", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
select user_id, {n8('bin', 'bin')}, case when vaso + fluid + vent = 0 then 'A_NONE' else 'A' || case when vaso = 1 then '_VASO' else '' end
  || case when fluid = 1 then '_VENT' else '' end || case when vent = 1 then '_CRRT' else '' end end as label from panel"""))
def action_label(t):
    return panel(t).select("user_id", "bin", S.label_of_flags(["vaso", "fluid", "vent"], LABELS).alias("label"))


@query("category_codes", "F30", f"""
with c as (select *, case when c_custkey % 6 = 0 then null else c_mktsegment end as seg from customer),
k as (select seg, row_number() over (order by seg) - 1 as code from (select distinct seg from c where seg is not null))
select c_custkey, {n8('coalesce(k.code, -1)', 'code')} from c left join k on k.seg = c.seg""")
def category_codes(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("seg"))
    return T.category_codes(rows, "seg", "code").select("c_custkey", "code")


def _vector_sql(shift: int) -> str:
    cells = []
    for back in (3, 2, 1, 0):
        k = back - shift
        for c in ("coalesce(value, 0)", "cast(flag as double)"):
            f = f"lag({c}, {k}) over w" if k > 0 else (f"lead({c}, {-k}) over w" if k < 0 else c)
            cells.append(f"coalesce({f}, 0)")
    return "[" + ", ".join(cells) + "]"


def _vec_text(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: cast(cast(round(x * 100) as bigint) as varchar)), ',')"


@query("history_vector", "W13", with_(EV_SQL, select=f"""
, v as (select *, case when event_type = 'error' then 1 else 0 end as flag from ev),
h as (select event_id, {_vector_sql(0)} as history, lead(event_id) over w as nxt, {_vector_sql(1)} as nh from v window w as (partition by user_id order by ts, event_id))
select event_id, {_vec_text('history')} as history, {_vec_text('case when nxt is null then [0.0,0,0,0,0,0,0,0] else nh end')} as next_history from h"""))
def history_vector(t):
    rows = ev(t).select("user_id", "ts", "event_id", "value", (F.col("event_type") == "error").cast("int").alias("flag"))
    out = W.history_vectors(rows, K, O, ["value", "flag"], 4)

    def text(c):
        return F.array_join(F.transform(c, lambda x: F.round(x * 100).cast("long").cast("string")), ",")

    return out.select("event_id", text("history").alias("history"), text("next_history").alias("next_history"))


@query("last_n_rows", "W14", "select event_id, user_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 5")
def last_n_rows(t):
    return W.last_rows(t.events.select("user_id", "ts", "event_id"), K, O, 5).select("event_id", "user_id")


@query("random_window", "W15", f"""
with r as (select event_id, user_id, row_number() over {WIN} - 1 as i, count(*) over (partition by user_id) as n from events)
select event_id, user_id from (select *, floor({uniform_sql("'window'", '7', 'user_id')} * (greatest(n - 8, 0) + 1)) as b from r) where i >= b and i < b + 8""")
def random_window(t):
    return W.random_window(t.events.select("user_id", "ts", "event_id"), K, O, 8, 7).select("event_id", "user_id")


@query("seed_history", "W21", f"""
select event_id, user_id from (select *, row_number() over {WIN} as i, count(*) over (partition by user_id) as n from events) where n >= 12 and i <= 5""")
def seed_history(t):
    return W.seed_rows(t.events.select("user_id", "ts", "event_id"), K, O, 5, 7).select("event_id", "user_id")


@query("transition_pairs", "W22", with_(EV_SQL, select=f"""
select event_id, {r6('value', 'value')}, {r6('nv', 'next_value')} from (select *, lead(value) over {WIN} as nv from ev) where nv is not null"""))
def transition_pairs(t):
    rows = ev(t).select("user_id", "ts", "event_id", "value")
    return W.transition_pairs(rows, K, O, "value").select("event_id", "value", "next_value")


@query("padded_sequences", "W16", with_(EV_SQL, select=f"""
, r as (select *, row_number() over {WIN} - 1 as i from ev),
p as (select user_id, i // 16 as part, count(*) as n, string_agg(cast(cast(round(coalesce(value, 0) * 100) as bigint) as varchar), ',' order by i) as s from r group by 1, 2)
select user_id, {n8('part', 'part')}, {n8('n', 'n_steps')}, s || repeat(',0', 16 - n) as steps, repeat('1', n) || repeat('0', 16 - n) as mask from p""").replace("repeat(',0', 16 - n)", "repeat(',0', cast(16 - n as integer))").replace("repeat('1', n) || repeat('0', 16 - n)", "repeat('1', cast(n as integer)) || repeat('0', cast(16 - n as integer))"))
def padded_sequences(t):
    rows = ev(t).select("user_id", "ts", "event_id", "value")
    out = W.padded_sequences(rows, K, O, ["value"], 16)
    return out.select(
        "user_id", "part", "n_steps",
        F.array_join(F.transform("steps", lambda x: F.round(x[0] * 100).cast("long").cast("string")), ",").alias("steps"),
        F.array_join(F.transform("mask", lambda x: x.cast("string")), "").alias("mask"),
    )


@query("metric_rank", "W18", f"""
with m as (select l_suppkey as name, sum(l_quantity) as metric from lineitem group by 1)
select name, {n8('row_number() over (order by metric desc, name)', 'rank')} from m""")
def metric_rank(t):
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("name")).agg(F.sum("l_quantity").alias("metric"))
    return T.rank_of(rows, "metric", "name").select("name", "rank")


@query("column_groups", "P17 P10 P2", with_(EV_SQL, LATE_SQL, REPLAY_SQL, select=f"""
select user_id, {n8('bin', 'bin')}, {_vec_text('[coalesce(s_hb, 0), coalesce(s_bun, 0)]')} as states, {n8('a', 'action')}, {_vec_text('[s_next_hb, s_next_bun]')} as next_states
from rp where split = 'train'"""))
def column_groups(t):
    def text(c):
        return F.array_join(F.transform(c, lambda x: F.round(x * 100).cast("long").cast("string")), ",")

    rows = replay_rows(t).filter("split = 'train'")
    zero = F.lit(0.0)
    return rows.select(
        "user_id", "bin", text(F.array(F.coalesce("s_hb", zero), F.coalesce("s_bun", zero))).alias("states"),
        F.col("a").alias("action"), text(F.array("s_next_hb", "s_next_bun")).alias("next_states"),
    )


@query("hourly_transitions", "W2 W4 W5 W10 W11 F26 F27 P1 P2 P7 P15 Q1", with_(EV_SQL, select=f"""
, h as (select user_id as stay, sec // 3600 as hr, min(sec) as st, max(sec) as en, avg(value) as sofa, max(case when event_type = 'error' then 1 else 0 end) as vaso,
   max(case when event_type = 'view' then 1 else 0 end) as vent, max(case when event_type = 'signup' then 1 else 0 end) as crrt from ev group by 1, 2)
select cast(stay as varchar) as episode_id, {n8('row_number() over w - 1', 'episode_step')}, cast(stay as varchar) || '_' || cast(hr as varchar) as transition_id, {n8('hr', 't')},
  {n8('coalesce(case when lead(sofa) over w - sofa >= 2 then 1 else 0 end, 0)', 'y_t1')}, {n8('case when lead(hr) over w is null then 1 else 0 end', 'done')},
  case when vaso + vent + crrt = 0 then 'A_NONE' else 'A' || case when vaso = 1 then '_VASO' else '' end || case when vent = 1 then '_VENT' else '' end || case when crrt = 1 then '_CRRT' else '' end end as a_t,
  {r6('sofa', 's_t_sofa')}, {r6('lead(sofa) over w', 's_t1_sofa')}, {n8('min(st) over (partition by stay)', 'index_start')}, {n8('max(en) over (partition by stay)', 'index_end')}, 'events' as source_dataset
from h window w as (partition by stay order by hr)"""))
def hourly_transitions(t):
    from episodia.plans.hourly import hourly_transitions as build

    kind = F.col("event_type")
    hourly = ev(t).groupBy(F.col("user_id").alias("stay_id"), F.floor(F.col("sec") / 3600).cast("long").alias("hr")).agg(
        F.min("sec").alias("starttime"), F.max("sec").alias("endtime"), F.avg("value").alias("s_t_sofa"),
        F.max((kind == "error").cast("int")).alias("a_t_vaso"), F.max((kind == "view").cast("int")).alias("a_t_vent"),
        F.max((kind == "signup").cast("int")).alias("a_t_crrt"),
    ).withColumns({"subject_id": F.col("stay_id"), "hadm_id": F.col("stay_id")})
    out = build(hourly, states=["sofa"], labels=LABELS, threshold=2, provenance={"source_dataset": "events"})
    return out.select("episode_id", "episode_step", "transition_id", "t", "y_t1", "done", "a_t", "s_t_sofa", "s_t1_sofa",
                      F.col("index_admittime").alias("index_start"), F.col("index_dischtime").alias("index_end"), "source_dataset")
