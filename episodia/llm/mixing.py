"""Mix sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodia.session import durable, written

#: most copies of a document that a mix takes
REPEATS = 3
#: weights of sources in the order of their names, repeating
WEIGHTS = (5, 2, 1)
LEVEL_BITS, LEVELS = 10, 6
#: plans up to so many sources are sent to all executors; beyond, they are shuffled
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_hash(key: Column) -> Column:
    """60 bits of the key's digest; null counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row for each source: size, target, whole copies and what is left over.

    Shares of the total follow the weights; a target stops at ``repeats`` times
    the source's size and the excess goes to the others by weight.  That is one
    common level ``(total - full sources) / their weights`` at which sources are
    filled, found by sorting the sources by the level at which each is full.
    """
    by_source = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    named = Window.orderBy(F.col("_source").asc_nulls_last())  # windows here hold one row for each source
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = by_source.withColumns({"_w": pick, "_cap": (F.col("source_size") * repeats).cast("double")})
    filled = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "_left": F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("_cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("_w").over(filled.rowsBetween(0, Window.unboundedFollowing)),
        "_k": F.row_number().over(filled),
    })
    open_ = F.when(F.col("_left") / F.col("_rest") <= F.col("_cap") / F.col("_w"), F.struct("_k", (F.col("_left") / F.col("_rest")).alias("level")))
    rows = rows.withColumn("_level", F.min(open_).over(whole)["level"])
    rows = rows.withColumn("target", F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    copies = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeats))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("_copies", copies)
    return rows.select("_source", "source_size", "target", "_copies", F.greatest(F.col("target") - F.col("_copies") * F.col("source_size"), F.lit(0.0)).alias("_budget"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``_below``: documents with a smaller hash get one copy more.

    Each level sums sizes by source and the next ten bits of the hash.  Buckets
    under the budget are taken whole; only the one that crosses it is refined,
    until it holds one document (or one hash).  That last one is taken if it
    brings the sum nearer to the budget.
    """
    bits = LEVEL_BITS * LEVELS
    state = targets.withColumns({"_prefix": F.lit(0).cast("long"), "_below": F.lit(0).cast("long"), "_open": (F.col("_budget") > 0)})
    state = durable(state)
    for level in range(LEVELS):
        shift = bits - LEVEL_BITS * (level + 1)
        going = state.filter("_open").select("_source", "_prefix", "_budget")
        if going.isEmpty():
            break
        inside = sizes
        if level:
            inside = sizes.withColumn("_prefix", F.shiftright("_hash", shift + LEVEL_BITS))
            inside = inside.join(going.select(F.col("_source").alias("_s"), "_prefix"), (F.col("_source").eqNullSafe(F.col("_s"))) & (inside["_prefix"] == going["_prefix"]), "left_semi")
        histogram = inside.groupBy("_source", F.shiftright("_hash", shift).alias("_bucket")).agg(F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_n"))
        order = Window.partitionBy("_source").orderBy("_bucket")  # at most 1024 rows for each source
        histogram = histogram.withColumn("_to", F.sum("_sum").over(order))
        budget = state.filter("_open").select(F.col("_source").alias("_s"), "_budget")
        crossing = (
            histogram.join(budget, F.col("_source").eqNullSafe(F.col("_s"))).filter("_to > _budget")
            .groupBy("_s").agg(F.min(F.struct("_bucket", "_sum", "_n", "_to")).alias("_x"))
        )
        before = F.col("_x._to") - F.col("_x._sum")
        last = (F.col("_x._n") == 1) | F.lit(level == LEVELS - 1)
        nearer = (F.col("_x._to") - F.col("_budget")) < (F.col("_budget") - before)
        bucket = F.col("_x._bucket")
        joined = state.join(crossing, F.col("_source").eqNullSafe(F.col("_s")), "left")
        # no crossing: the budget takes all that is inside
        after = F.when(F.col("_x").isNull(), F.shiftleft(F.col("_prefix") + 1, shift + LEVEL_BITS)).otherwise(F.shiftleft(F.when(last & nearer, bucket + 1).otherwise(bucket), shift))
        state = durable(joined.select(
            "_source", "source_size", "target", "_copies",
            F.when(F.col("_open") & F.col("_x").isNotNull(), F.col("_budget") - before).otherwise(F.col("_budget")).alias("_budget"),
            F.when(F.col("_open") & F.col("_x").isNotNull(), bucket).otherwise(F.col("_prefix")).alias("_prefix"),
            F.when(F.col("_open"), after).otherwise(F.col("_below")).alias("_below"),
            (F.col("_open") & F.col("_x").isNotNull() & ~last).alias("_open"),
        ))
    return state.select("_source", "source_size", "target", "_copies", "_below")


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows of ``docs`` with the number of copies that the mix takes.

    Adds ``_mix``, a struct of ``size``, ``source_size``, ``target``, ``copies``
    and ``taken``; other column names may be any but that one.  Documents are chosen by the hash of their id, so
    reruns agree and a larger budget keeps what a smaller one took; rows with
    the same id are taken together.  Null text has size 0, a null source is a
    source of its own, sorted last.  An empty table gives an empty one.
    """
    sizes = written(docs.select(F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"), place_hash(F.col(id_col)).alias("_hash")), "mix")
    plan = durable(thresholds(sizes, source_targets(sizes, weights, repeats))).withColumnRenamed("_source", "_s")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    # the row is packed, so that its column names cannot meet those of the plan
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), word_count(docs[text_col]).alias("_size"), place_hash(docs[id_col]).alias("_hash"), docs[source_col].alias("_source"))
    joined = rows.join(plan, F.col("_source").eqNullSafe(F.col("_s")))
    copies = F.col("_copies") + (F.col("_hash") < F.col("_below")).cast("long")
    return joined.select("_row.*", F.struct(
        F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken")).alias("_mix"))


def mixed_rows(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies."""
    return mix(docs, weights, repeats).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_mix.copies").cast("int")))).select(*docs.columns)


def op4_hash_thresholds(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken")


OP4_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by 1),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w, (3 * source_size)::double as cap from s),
f as (select *, sum(source_size) over ()::double - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as lft,
             sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as rst,
             row_number() over (order by cap / w, source nulls last) as k from w),
l as (select arg_min(lft / rst, k) as level from f where lft / rst <= cap / w),
t as (select source, source_size, least(cap, level * w) as target from f, l),
c as (select *, case when source_size > 0 then least(floor(target / source_size), 3) else 0 end as copies from t),
b as (select *, greatest(target - copies * source_size, 0) as budget from c),
x as (select d.*, b.source_size, b.target, b.copies, b.budget, sum(size) over (partition by d.source order by h) as upto, sum(size) over (partition by d.source, h) as grp
      from d join b on d.source is not distinct from b.source)
select doc_id, size, source_size, target,
       (size * (copies + case when budget > 0 and (upto <= budget or (upto - grp <= budget and upto - budget < budget - (upto - grp))) then 1 else 0 end))::bigint as taken
from x"""
