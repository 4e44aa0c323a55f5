"""Edge, agreement and stability queries on edges derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodia.catalog.registry import query
from episodia.catalog.roles import n8, r6
from episodia.operators import graphs as G

# a matrix of end marks per day: event types as nodes, marks from counts
MARK_SQL = """nodes as (select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2),
mark as (select a.day, a.event_type as i, b.event_type as j, case (a.n * 3 + b.n * 5 + length(a.event_type)) % 5 when 0 then 0 when 1 then -1 when 2 then -1 when 3 then 1 else 2 end as m
  from nodes a join nodes b on a.day = b.day and a.event_type <> b.event_type)"""
KINDS = ["click", "view", "purchase", "signup", "error"]


def marks(t):
    """One row per day and ordered node pair, from one row per day."""
    counts = t.events.groupBy(F.to_date("ts").alias("day")).agg(*[F.sum((F.col("event_type") == k).cast("long")).alias(k) for k in KINDS])
    cells = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(i).alias("a"), F.col(j).alias("b"), F.lit(len(i)).alias("n"))
        for i in KINDS for j in KINDS if i != j
    ]
    rows = counts.select("day", F.inline(F.array(*cells))).filter("a > 0 and b > 0")
    k = (F.col("a") * 3 + F.col("b") * 5 + F.col("n")) % 5
    mark = F.when(k == 0, 0).when(k <= 2, -1).when(k == 3, 1).otherwise(2)
    return rows.select("day", "i", "j", mark.alias("m"))


EDGE_SQL = MARK_SQL + """,
pair as (select x.day, x.i, x.j, x.m as ab, y.m as ba from mark x join mark y on x.day = y.day and x.i = y.j and x.j = y.i),
edge as (select day, i as source, j as target, case when ba = 1 then 'definite' when ba = 2 then 'possible' else 'bidirected' end as edge_type
  from pair where ab = -1 and (ba in (1, 2) or (ba = -1 and i < j)))"""
CPDAG_SQL = MARK_SQL + """,
pair as (select x.day, x.i, x.j, x.m as ab, y.m as ba from mark x join mark y on x.day = y.day and x.i = y.j and x.j = y.i),
edge as (select day, i as source, j as target, case when ba = -1 then 'directed' else 'undirected' end as edge_type from pair where ab = 1 and (ba = -1 or (ba = 1 and i < j)))"""


def edges(t):
    return G.typed_edges(marks(t), ["day"], "i", "j", "m")


@query("adjacency_edges", "A55", "with " + EDGE_SQL + " select strftime(day, '%Y-%m-%d') as day, source, target, edge_type from edge")
def adjacency_edges(t):
    return edges(t)


@query("pattern_edges", "A55", "with " + CPDAG_SQL + " select strftime(day, '%Y-%m-%d') as day, source, target, edge_type from edge")
def pattern_edges(t):
    return G.typed_edges(marks(t), ["day"], "i", "j", "m", ancestral=False)


@query("weighted_edges", "A55", f"""
with w as (select 'f' || cast(l_linenumber as varchar) as i, 'r' || l_returnflag as j, avg(l_discount) - 0.05 as weight from lineitem group by 1, 2)
select j as source, i as target, 'directed' as edge_type, {r6('round(weight, 4)', 'weight')} from w where abs(weight) >= 0.0002""")
def weighted_edges(t):
    w = t.lineitem.groupBy(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("i"), F.concat(F.lit("r"), "l_returnflag").alias("j")).agg(
        (F.avg("l_discount") - 0.05).alias("weight"))
    return G.weighted_edges(w, [], "i", "j", "weight", 0.0002)


TIERS = [("click", 0), ("view", 0), ("purchase", 1), ("signup", 1), ("error", 2)]
TIER_SQL = "tier(v, k) as (values " + ", ".join(str(x) for x in TIERS) + ")"


@query("temporal_edge_filter", "P16", "with " + TIER_SQL + ", " + EDGE_SQL + """
select strftime(day, '%Y-%m-%d') as day, source, target, edge_type from edge join tier s on s.v = source join tier g on g.v = target where edge_type not in ('definite', 'possible') or s.k <= g.k""")
def temporal_edge_filter(t):
    return G.respecting_time(edges(t), t.spark.createDataFrame(TIERS, "variable string, tier int"))


@query("edge_agreement", "A48", "with " + EDGE_SQL + f"""
select edge_type, source, target, {n8('count(distinct alg)', 'n_algorithms')}, string_agg(distinct alg, ',' order by alg) as algorithms
from (select *, 'm' || cast(dayofmonth(day) % 4 as varchar) as alg from edge) group by 1, 2, 3""")
def edge_agreement(t):
    tagged = edges(t).withColumn("algorithm", F.concat(F.lit("m"), (F.dayofmonth("day") % 4).cast("string")))
    return G.edge_agreement(tagged, ["edge_type"])


STAB_SQL = EDGE_SQL + """,
runs as (select day, i as drug, j as state, e.edge_type from mark left join edge e on e.day = mark.day and e.source = mark.i and e.target = mark.j),
st as (select drug, state, count(*) as n, sum(case when edge_type = 'definite' then 1 else 0 end) as nd, sum(case when edge_type = 'possible' then 1 else 0 end) as np from runs group by 1, 2)"""
STAB_SQL = STAB_SQL.replace("select day, i as drug", "select mark.day, mark.i as drug").replace("j as state", "mark.j as state")


def stability_table(t):
    found = edges(t).withColumnsRenamed({"source": "drug", "target": "state"})
    included = marks(t).select("day", F.col("i").alias("drug"), F.col("j").alias("state"))
    return G.stability(included.join(found, ["day", "drug", "state"], "left"), ["drug", "state"])


@query("stability_freq", "A49 W18 T1", "with " + STAB_SQL + f""", fr as (select *, round(nd / n, 4) as fd, round((nd + np) / n, 4) as fa from st)
select drug, state, {n8('n', 'n_runs_included')}, {n8('nd', 'n_definite')}, {n8('np', 'n_possible')}, {n8('nd + np', 'n_any')}, {r6('fd', 'freq_definite')}, {r6('fa', 'freq_any')},
  {n8('row_number() over (order by fd desc, fa desc, drug, state)', 'rank')} from fr""")
def stability_freq(t):
    return stability_table(t)


@query("stability_matrix", "A50", "with " + STAB_SQL + " select drug, " + ", ".join(
    r6(f"coalesce(max(case when state = '{k}' then round(nd / n, 4) end), 0)", f"f_{k}") for k in KINDS) + " from st group by 1")
def stability_matrix(t):
    return G.matrix_view(stability_table(t), "drug", "state", "freq_definite", {k: f"f_{k}" for k in KINDS})
