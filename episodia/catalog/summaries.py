"""Episode summaries, profiles and frequency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodia.catalog.registry import query
from episodia.catalog.roles import EV_SQL, LATE_SQL, PANEL_SQL, ev, n8, panel, r6, split_sql, with_
from episodia.functions import scalars as S
from episodia.operators import aggregates as A
from episodia.operators import quality as Q
from episodia.operators.sampling import hash_split

K = ["user_id"]


@query("episode_first_last_delta", "A17 A18 A19 A24", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
select user_id, {r6('arg_min(hb, case when hb is not null then bin end)', 'first_hb')}, {r6('arg_max(hb, case when hb is not null then bin end)', 'last_hb')},
  {r6('avg(bun)', 'mean_bun')}, {r6('min(bun)', 'min_bun')}, {r6('max(cr)', 'max_cr')},
  {r6('arg_max(bun, case when bun is not null then bin end) - arg_min(bun, case when bun is not null then bin end)', 'delta_bun')}, {n8('count(*)', 'n_bins')}
from panel group by user_id"""))
def episode_first_last_delta(t):
    return A.episode_summary(panel(t), K, ["bin"], first=["hb"], last=["hb"], mean=["bun"], low=["bun"], high=["cr"], delta=["bun"], count="n_bins")


@query("exposure_fractions", "A23", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
select user_id, {r6('avg(vaso)', 'frac_vaso')}, {r6('avg(fluid)', 'frac_fluid')}, {n8('max(vaso)', 'any_vaso')}, {n8('max(vent)', 'any_vent')}, {r6('avg(cr)', 'mean_cr')}, {r6('max(cr)', 'max_cr')}
from panel group by user_id"""))
def exposure_fractions(t):
    return A.episode_summary(panel(t), K, ["bin"], fraction=["vaso", "fluid"], ever=["vaso", "vent"], mean=["cr"], high=["cr"])


PROFILE = ["event_type", "value", "user_id"]


@query("coverage_profile", "A20", with_(EV_SQL, select=" union all ".join(
    f"select '{c}' as column_name, count(*)::bigint as n_rows, count({c})::bigint as n_present, count(distinct {c})::bigint as n_distinct, {r6(f'count({c})::double / count(*)', 'coverage')} from ev"
    for c in PROFILE)))
def coverage_profile(t):
    return A.column_profile(ev(t), PROFILE)


@query("variance_screen", "P13 A20", with_(EV_SQL, select="""
select column_name from (select 'one' as column_name, count(distinct 1) as d, 1.0 as c from ev union all select 'value', count(distinct value), count(value) * 1.0 / count(*) from ev
  union all select 'rare', count(distinct case when event_id % 50 = 0 then value end), count(case when event_id % 50 = 0 then value end) * 1.0 / count(*) from ev
  union all select 'copy', 0, 0 from (select 1)) where d < 2 or c < 0.1"""))
def variance_screen(t):
    rows = ev(t).select("value", F.lit(1).alias("one"), F.when(F.col("event_id") % 50 == 0, F.col("value")).alias("rare"), F.col("value").alias("copy"))
    columns = ["one", "value", "rare", "copy"]
    dropped = set(A.zero_variance_columns(rows, columns, 0.1)) | set(A.duplicate_columns(rows, columns))
    kept = rows.drop(*dropped)
    return A.column_profile(rows, columns).filter(~F.col("column_name").isin(kept.columns)).select("column_name")


@query("frequency_table", "A26", f"select event_type, {n8('user_id % 5', 'bucket')}, {n8('count(*)', 'n')} from events group by event_type, user_id % 5")
def frequency_table(t):
    return A.frequency(t.events.withColumn("bucket", F.col("user_id") % 5), ["event_type", "bucket"])


@query("first_action_counts", "A26", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
select {n8('a', 'a')}, {n8('count(*)', 'n')} from (select user_id, arg_min(vaso + 2 * fluid + 4 * vent, bin) as a from panel group by 1) group by a"""))
def first_action_counts(t):
    from episodia.operators.policy_value import first_action_counts as run
    return run(panel(t).withColumn("a", S.encode_bits(["vaso", "fluid", "vent"])), K, "bin", "a")


@query("manifest", "A27 T7", f"""
with s as (select *, {split_sql('o_custkey')} as split from orders)
select {n8('count(*)', 'row_count')}, {n8('count(distinct o_orderkey)', 'episode_count')}, {n8('count(distinct o_custkey)', 'subject_count')},
  {n8("sum(case when split = 'train' then 1 else 0 end)", 'train_rows')}, {n8("sum(case when split = 'valid' then 1 else 0 end)", 'valid_rows')}, {n8("sum(case when split = 'test' then 1 else 0 end)", 'test_rows')} from s""")
def manifest(t):
    return A.manifest(hash_split(t.orders, "o_custkey"), "o_custkey", "o_orderkey", "split")


@query("split_rates", "A52", f"""
with s as (select o_custkey, o_orderkey, {split_sql('o_custkey')} as split, case when o_orderstatus = 'F' then 1 else 0 end as label from orders),
e as (select split, o_custkey, max(label) as label, count(*) as n from s group by 1, 2)
select split, {n8('count(*)', 'n_episodes')}, {n8('sum(n)', 'n_rows')}, {r6('avg(label)', 'label_rate')} from e group by 1""")
def split_rates(t):
    rows = hash_split(t.orders, "o_custkey").withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    return A.split_rates(rows, "o_custkey", "split", "label")


@query("cohort_summary", "A53 A16", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
select user_id, {n8('arg_min(case when vaso = 1 then 1 else 0 end, bin)', 'first_label')}, {r6('max(hb)', 'max_hb')}, {r6('max(bun)', 'max_bun')}, {n8('count(*)', 'n_bins')} from panel group by 1"""))
def cohort_summary(t):
    rows = panel(t)
    return rows.groupBy("user_id").agg(
        A.first_value("vaso", ["bin"]).alias("first_label"), F.max("hb").alias("max_hb"), F.max("bun").alias("max_bun"), F.count(F.lit(1)).alias("n_bins"))


@query("importance_share", "A51 T3", f"""
with imp as (select l_returnflag as target, l_shipmode as feature, importance from (
   select l_returnflag, 'f' || cast(l_linenumber as varchar) as l_shipmode, sum(l_quantity) as importance from lineitem group by 1, 2)),
top as (select target, feature, row_number() over (partition by target order by importance desc, feature) as place from imp where feature in ('f1', 'f2', 'f3', 'f4', 'f5'))
select i.target, {r6("sum(case when feature in ('f1', 'f2', 'f3', 'f4', 'f5') then importance else 0 end) / sum(importance)", 'group_share')},
  (select string_agg(feature, ',' order by place) from top where top.target = i.target and place <= 3) as top_features from imp i group by i.target""")
def importance_share(t):
    rows = t.lineitem.groupBy(F.col("l_returnflag").alias("target"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature")).agg(
        F.sum("l_quantity").alias("importance"))
    return A.importance_share(rows, "target", "feature", "importance", ["f1", "f2", "f3", "f4", "f5"])


@query("episode_features", "A17 A18 A23 A24 A19", with_(EV_SQL, LATE_SQL, PANEL_SQL, select=f"""
select user_id, {n8('count(*)', 'episode_hours')}, {r6('arg_max(cr, case when cr is not null then bin end)', 'last_cr')}, {r6('avg(hb)', 'mean_hb')},
  {r6('avg(vent)', 'frac_vent')}, {n8('max(fluid)', 'any_fluid')} from panel group by 1"""))
def episode_features(t):
    return A.episode_summary(panel(t), K, ["bin"], last=["cr"], mean=["hb"], fraction=["vent"], ever=["fluid"], count="episode_hours")


@query("quality_report", "Q2 A20", with_(EV_SQL, select=f"""
select 'value' as column_name, {n8('sum(case when value is null then 1 else 0 end)', 'n_null')}, {n8('sum(case when value < 1 then 1 else 0 end)', 'n_infinite')} from ev
union all select 'sec', 0, 0"""))
def quality_report(t):
    rows = ev(t).withColumn("value", F.when(F.col("value") < 1, F.lit(float("inf"))).otherwise(F.col("value")))
    return Q.bad_value_counts(rows, ["value", "sec"])


@query("repair_nonfinite", "Q3 A22", with_(EV_SQL, select=f"""
, r as (select *, {split_sql('user_id')} as split, case when value < 1 then null else value end as x, case when event_id % 3 = 0 then null else event_id % 2 end as flag from ev)
select event_id, {r6("coalesce(x, (select avg(x) from r where split = 'train'))", 'value')}, {n8('coalesce(flag, 0)', 'flag')} from r"""))
def repair_nonfinite(t):
    rows = hash_split(ev(t), "user_id").withColumns({
        "value": F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("value")),
        "flag": F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2),
    })
    return Q.repaired(rows, ["value"], ["flag"]).select("event_id", "value", "flag")


@query("transition_contract", "Q6", with_(EV_SQL, LATE_SQL, PANEL_SQL, select="""
, b as (select user_id, bin, row_number() over w as rn, case when lead(bin) over w is null then 1 else 0 end as done from panel window w as (partition by user_id order by bin)),
p as (select user_id, bin, case when user_id % 11 = 0 then 0 when user_id % 13 = 0 then case when rn = 1 then 1 else 0 end else done end as done from b
  union all select user_id, bin, 0 from b where user_id % 7 = 1 and rn = 1),
k as (select user_id, bin, count(*) as n, max(done) as d from p group by 1, 2),
e as (select user_id, sum(n - 1) as dup, sum(d) as ends, arg_max(d, bin) as last from k group by 1)
select unnest(['duplicate_keys', 'episodes_without_one_end', 'end_not_last']) as "check",
  unnest([sum(dup), sum(case when ends <> 1 then 1 else 0 end), sum(case when last <> 1 then 1 else 0 end)])::bigint as violations from e"""))
def transition_contract(t):
    """Planted faults: a repeated first step, an end that is missing, an end at the first step."""
    from episodia.operators.sequences import next_state
    moved = next_state(panel(t).select("user_id", "bin", "hb"), K, ["bin"], ["hb"])
    firsts = panel(t).groupBy("user_id").agg(F.min("bin").alias("_first"))
    rows = moved.join(firsts, "user_id").withColumn("_starts", F.col("bin") == F.col("_first"))
    wrong = F.when(F.col("user_id") % 11 == 0, F.lit(0)).when(F.col("user_id") % 13 == 0, F.col("_starts").cast("int")).otherwise(F.col("done"))
    again = rows.filter((F.col("user_id") % 7 == 1) & F.col("_starts")).withColumn("done", F.lit(0))
    return Q.transition_checks(rows.withColumn("done", wrong).unionByName(again), "user_id", "bin")


@query("schema_coverage", "Q7", """
with have as (select column_name from (describe events)), want as (select unnest(['event_id', 'user_id', 'ts', 'value', 'unit', 'schema_version']) as column_name)
select 'absent' as kind, column_name, null::bigint as n_known from want where column_name not in (from have)
union all select 'extra', column_name, case column_name when 'event_type' then (select count(event_type) from events) when 'props' then (select count(props) from events) end
  from have where column_name not in (from want)""")
def schema_coverage(t):
    """Columns of a declared schema that the events lack, and those it does not name with their known values."""
    report = Q.coverage_report(t.events, ["event_id", "user_id", "ts", "value", "unit", "schema_version"])
    known = t.events.agg(*[F.count(c).alias(c) for c in report["extra"]]).unpivot([], report["extra"], "column_name", "n_known")
    absent = t.spark.createDataFrame([(c,) for c in report["absent"]], "column_name string").withColumn("n_known", F.lit(None).cast("long"))
    return known.select(F.lit("extra").alias("kind"), "*").unionByName(absent.select(F.lit("absent").alias("kind"), "*"))


@query("conformed_rows", "P1 P2 Q1 Q5 Q7 P15", """
select event_id as id, cast(user_id as varchar) as subject, value, cast(null as double) as absent, 'v1' as schema_version from events""")
def conformed_rows(t):
    from pyspark.sql import types as T
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("subject", T.StringType()), T.StructField("value", T.DoubleType()),
        T.StructField("absent", T.DoubleType()), T.StructField("schema_version", T.StringType())])
    rows = Q.require_columns(t.events, ["event_id", "user_id", "value"]).withColumnsRenamed({"event_id": "id", "user_id": "subject"})
    rows = Q.with_provenance(Q.forbid_columns(rows, ["schema_version"]), {"schema_version": "v1"})
    return Q.conform(rows, schema)
