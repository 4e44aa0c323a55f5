"""Grouped summaries: pivots, profiles, quantiles, scalers and code scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodia.functions import fixed_values as fixed
from episodia.operators.scan import RunningSum, Total, ordered


# --- flags and code scores -----------------------------------------------------

def flags_by_group(df: DataFrame, keys: list[str], tests: Mapping[str, Column]) -> DataFrame:
    """1 per group where any row passes the test."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(t, 1).otherwise(0)).alias(n) for n, t in tests.items()]
    )


def weighted_flags(df: DataFrame, weights: Mapping[str, int], name: str) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) * w for c, w in weights.items()])
    return df.withColumn(name, total)


def prefix_score(codes: DataFrame, dimension: DataFrame, keys: list[str], code: str,
                 name: str = "score", shortest: int = fixed.SHORTEST_PREFIX) -> DataFrame:
    """Longest matching prefix per code, largest weight per category, summed.

    ``dimension`` has (prefix, category, weight).  Each code is tried at every
    prefix length from ``shortest`` on that occurs in the dimension, so the join
    is by equality.
    A code's category does not depend on the group, so each distinct code is looked up once.
    """
    lengths = F.array_sort(F.collect_set(F.length("prefix")))
    dimension = dimension.filter(F.length("prefix") >= shortest)
    sizes = dimension.agg(lengths.alias("n")).first()["n"] or []
    tries = F.explode(F.array(*[F.substring(F.trim(code), 1, n) for n in sizes])) if sizes else F.lit(None).cast("string")
    parts = codes.select(code).distinct().select(code, tries.alias("prefix")).distinct()
    best = parts.join(dimension, "prefix", "inner").groupBy(code).agg(
        F.max_by(F.struct("category", "weight"), F.length("prefix")).alias("_b")
    ).select(code, "_b.category", F.col("_b.weight").alias("_w"))
    per_category = codes.select(*keys, code).join(best, code, "left").groupBy(*keys, "category").agg(F.max("_w").alias("_w"))
    # a null key equals no other, so its codes count for nothing
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return per_category.groupBy(*keys).agg(F.sum(F.when(known, F.col("_w"))).alias(name)).withColumn(
        name, F.coalesce(name, F.lit(0))
    )


# --- long to wide ---------------------------------------------------------------

def first_value_wide(df: DataFrame, keys: list[str], item: str, value: str, items: Sequence,
                     priority: Sequence[str]) -> DataFrame:
    """Long to wide; of several values the first by ``priority`` wins."""
    order = F.struct(*[F.col(c) for c in priority])
    cells = [
        F.min_by(value, F.when((F.col(item) == i) & F.col(value).isNotNull(), order)).alias(str(i))
        for i in items
    ]
    return df.filter(F.col(item).isin(list(items))).groupBy(*keys).agg(*cells)


def mean_wide(df: DataFrame, keys: list[str], item: str, value: str, items: Mapping[object, str]) -> DataFrame:
    """Long to wide with means, from one aggregation.

    Sums and counts per column combine on the map side, so a key with very many
    raw rows sends one row per input task.
    """
    return df.filter(F.col(item).isin(list(items))).groupBy(*keys).agg(
        *[F.avg(F.when(F.col(item) == i, F.col(value))).alias(n) for i, n in items.items()]
    )


def item_means(df: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """Mean and count per key and item, nulls skipped."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, item).agg(
        F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n_values")
    )


def means(df: DataFrame, keys: list[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


# --- episodes --------------------------------------------------------------------

def first_value(value: str, at: Sequence[str]) -> Column:
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*at)))


def last_value(value: str, at: Sequence[str]) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*at)))


def episode_summary(df: DataFrame, keys: list[str], at: Sequence[str], *, first=(), last=(), mean=(),
                    low=(), high=(), delta=(), fraction=(), ever=(), count: str | None = None) -> DataFrame:
    """One row per episode; first/last skip nulls, ``delta`` is last minus first."""
    cells = [first_value(c, at).alias(f"first_{c}") for c in first]
    cells += [last_value(c, at).alias(f"last_{c}") for c in last]
    cells += [F.avg(c).alias(f"mean_{c}") for c in mean]
    cells += [F.min(c).alias(f"min_{c}") for c in low]
    cells += [F.max(c).alias(f"max_{c}") for c in high]
    cells += [(last_value(c, at) - first_value(c, at)).alias(f"delta_{c}") for c in delta]
    cells += [F.avg((F.coalesce(c, F.lit(0)) > 0).cast("double")).alias(f"frac_{c}") for c in fraction]
    cells += [F.max((F.coalesce(c, F.lit(0)) > 0).cast("int")).alias(f"any_{c}") for c in ever]
    if count:
        cells.append(F.count(F.lit(1)).alias(count))
    return df.groupBy(*keys).agg(*cells)


# --- quantiles and scalers -------------------------------------------------------

def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: Mapping[str, float],
                    rows_per_task: int | None = None) -> DataFrame:
    """Quantiles with linear interpolation, exact and without gathering a group.

    Equal values are counted first; running counts then give the position of
    each distinct value, and the two neighbours of every quantile are picked by
    a conditional minimum.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n")
    )
    placed = ordered(
        counts, keys, [value],
        {"_cum": RunningSum("_n"), "_total": Total("_n")}, rows_per_task=rows_per_task,
    )
    cells = []
    for name, p in probs.items():
        place = (F.col("_total") - 1) * F.lit(float(p))
        lower = F.min(F.when(F.col("_cum") > F.floor(place), F.col(value)))
        upper = F.min(F.when(F.col("_cum") > F.ceil(place), F.col(value)))
        share = F.max(place - F.floor(place))
        cells.append((lower + (upper - lower) * share).alias(name))
    return placed.groupBy(*keys).agg(*cells)


def train_scaler(df: DataFrame, columns: Sequence[str], split: str = "split", train: str = "train") -> DataFrame:
    """One row with ``<c>_mean`` and ``<c>_std`` (sample) over the train rows."""
    rows = df.filter(F.col(split) == train)
    return rows.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_samp(c).alias(f"{c}_std") for c in columns],
    )


def with_single_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table to every row.

    Each column becomes a scalar subquery, so nothing is joined.
    """
    packed = one.select(F.struct(*[F.col(c) for c in one.columns]).alias("s")).scalar()
    names = one.columns
    return df.withColumn("_one", packed).select(
        "*", *[F.col(f"_one.{c}").alias(c) for c in names]
    ).drop("_one")


# --- profiles ---------------------------------------------------------------------

def unpivoted(df: DataFrame, ids: list[str], columns: Sequence[str], names: tuple[str, str]) -> DataFrame:
    return df.unpivot(ids, list(columns), *names)


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, non-null count, coverage and distinct count per column.

    Non-null counts take one pass.  Distinct values are counted on the
    unpivoted (column, value) pairs, which are reduced before the shuffle.
    """
    long = df.select(
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"))
            for c in columns
        ]))
    )
    pairs = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n_present"),
        F.count("v").alias("n_distinct"),
    ).withColumn("coverage", F.col("n_present") / F.col("n_rows"))


def null_counts(df: DataFrame, columns: Sequence[str], value: str = "n_null") -> DataFrame:
    """Nulls per column in one pass, one row per column."""
    one = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column_name", value)


def fill_gain(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of nulls that a fill step removed, per column."""
    a = null_counts(before, columns, "nulls_before")
    b = null_counts(after, columns, "nulls_after")
    share = 1 - F.col("nulls_after") / F.greatest(F.col("nulls_before"), F.lit(1))
    return a.join(b, "column_name").withColumn("share_removed", share)


def exclusion_waterfall(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """Rows hit by each criterion on its own, in one pass."""
    one = df.agg(*[F.sum(F.when(t, 1).otherwise(0)).alias(n) for n, t in tests.items()])
    return one.unpivot([], list(tests), "criterion", "excluded")


def excluded(tests: Sequence[Column]) -> Column:
    """True where any criterion holds; unknown counts as not excluded."""
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def manifest(df: DataFrame, subject: str, episode: str, split: str) -> DataFrame:
    """Rows, episodes, subjects and rows per split, as one row."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct(episode).alias("episode_count"),
        F.countDistinct(subject).alias("subject_count"),
        *[F.sum((F.col(split) == s).cast("long")).alias(f"{s}_rows") for s in ("train", "valid", "test")],
    )


def zero_variance_columns(df: DataFrame, columns: Sequence[str], min_coverage: float = 0.0) -> list[str]:
    """Columns with fewer than two values or too little coverage (one small job)."""
    seen = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.struct(F.count(c).alias("n"), F.min(F.col(c).cast("string")).alias("low"), F.max(F.col(c).cast("string")).alias("high")).alias(c) for c in columns]).first()
    return sorted(c for c in columns if seen[c]["low"] == seen[c]["high"] or seen[c]["n"] < min_coverage * seen["_n"])


def duplicate_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Later columns that equal an earlier one on every row (one small job)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    if not pairs:
        return []
    row = df.agg(*[
        F.min(F.col(a).eqNullSafe(F.col(b)).cast("int")).alias(f"p{i}")
        for i, (a, b) in enumerate(pairs)
    ]).first()
    return sorted({b for i, (a, b) in enumerate(pairs) if row[f"p{i}"] == 1})


def importance_share(importances: DataFrame, target: str, feature: str, value: str,
                     group: Sequence[str], n_top: int = 3) -> DataFrame:
    """Share of a column group in the total importance and its top features."""
    from episodia.operators.sampling import top_per_group

    is_in = F.col(feature).isin(list(group))
    share = importances.groupBy(target).agg(
        (F.sum(F.when(is_in, F.col(value)).otherwise(0.0)) / F.nullif(F.sum(value), F.lit(0.0)))
        .alias("group_share")
    )
    top = top_per_group(importances.filter(is_in), [target], [F.desc(value), F.asc(feature)], n_top, "place")
    listed = top.groupBy(target).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", feature))),
                                 lambda r: r.getField(feature)), ",").alias("top_features")
    )
    return share.join(listed, target, "left")


# --- calendar and split summaries ---------------------------------------------------

def split_rates(df: DataFrame, episode: str, split: str, label: str) -> DataFrame:
    """Episodes, rows and label rate per split, each episode counted once."""
    per_episode = df.groupBy(split, episode).agg(
        F.max(label).alias(label), F.count(F.lit(1)).alias("n_rows")
    )
    return per_episode.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_episodes"), F.sum("n_rows").alias("n_rows"),
        F.avg(F.col(label).cast("double")).alias("label_rate"),
    )
