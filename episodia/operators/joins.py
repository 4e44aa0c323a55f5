"""Joins between episodes, events and dimensions.

Equality joins are plain joins: Spark broadcasts a side only when its measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` and splits skewed
partitions at run time.  Time-based lookups never form all pairs of a key; they
are either running columns (:mod:`episodia.operators.scan`) or equality joins on
(key, time bucket).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodia.operators.scan import HotKeys, LastSeen, NextSeen, RunningSum, ordered


def episode_frame(episodes: DataFrame, *parents: tuple[DataFrame, list[str]]) -> DataFrame:
    """Inner join of an episode table with its parent tables."""
    return reduce(lambda a, p: a.join(p[0], p[1], "inner"), parents, episodes)


def enrich(base: DataFrame, additions: Sequence[tuple[DataFrame, list[str], Mapping[str, object]]]) -> DataFrame:
    """Left-join pre-aggregated tables; misses take the given defaults."""
    out = base
    for extra, keys, defaults in additions:
        out = out.join(extra, keys, "left")
        if defaults:
            out = out.withColumns(
                {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
            )
    return out


def stacked(base: DataFrame, facts: Mapping[str, DataFrame], keys: list[str], packed: str = "_base", asked: str = "_asked") -> DataFrame:
    """Base rows and the rows of all tables of ``facts`` under each other.

    What a row has beside ``keys`` is one struct: ``packed`` for the base, the table's
    name otherwise; ``asked`` marks base rows.  Windows over the keys then look up every
    table at once.  As in an equality join, facts with a null key match nothing and are left out.
    """
    struct = lambda df: F.struct(*[F.col(c) for c in df.columns if c not in keys])
    rows = base.select(*keys, F.lit(True).alias(asked), struct(base).alias(packed))
    for name, table in facts.items():
        rows = rows.unionByName(table.dropna(subset=keys).select(*keys, F.lit(False).alias(asked), struct(table).alias(name)), allowMissingColumns=True)
    return rows


def with_key_maximum(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Attach the largest non-null ``value`` of the key; keys without one drop out."""
    top = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(value).alias(name))
    return df.join(top, keys, "inner")


def full_merge(tables: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge of wide tables that are unique on ``keys``."""
    return reduce(lambda a, b: a.join(b, keys, "full"), tables)


def precedence_union(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """All primary rows, and secondary rows whose key the primary lacks."""
    missing = secondary.join(primary.select(*keys).distinct(), keys, "left_anti")
    return primary.unionByName(missing, allowMissingColumns=True)


def without_keys(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(ids.select(*keys).distinct(), keys, "left_anti")


def only_keys(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Semi join; with runtime filters Spark also prunes the scan of ``df``."""
    return df.join(ids.select(*keys), keys, "left_semi")


def presence_flag(df: DataFrame, hits: DataFrame, keys: list[str], name: str) -> DataFrame:
    """1 where the key occurs in ``hits``, 0 otherwise."""
    marks = hits.select(*keys).distinct().withColumn(name, F.lit(1))
    return df.join(marks, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def presence_flags(df: DataFrame, hits: DataFrame, keys: list[str], item: str,
                   names: Mapping[object, str]) -> DataFrame:
    """One 0/1 column per item, from one aggregation and one join."""
    marks = hits.filter(F.col(item).isin(list(names))).groupBy(*keys).agg(
        *[F.max((F.col(item) == i).cast("int")).alias(n) for i, n in names.items()]
    )
    joined = df.join(marks, keys, "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names.values()})


def all_items_flag(df: DataFrame, hits: DataFrame, keys: list[str], item: str,
                   needed: Sequence, name: str) -> DataFrame:
    """1 where every needed item occurs for the key."""
    found = (
        hits.filter(F.col(item).isin(list(needed)))
        .groupBy(*keys)
        .agg(F.countDistinct(item).alias("_n"))
        .filter(F.col("_n") == len(set(needed)))
    )
    return presence_flag(df, found, keys, name)


def patched(df: DataFrame, source: DataFrame, keys: list[str], name: str, source_name: str) -> DataFrame:
    """Fill a missing attribute from another table under another name."""
    fix = source.select(*keys, F.col(source_name).alias("_patch"))
    return (
        df.join(fix, keys, "left")
        .withColumn(name, F.coalesce(F.col(name), F.col("_patch")))
        .drop("_patch")
    )


def realigned(df: DataFrame, values: DataFrame, keys: list[str], names: Sequence[str]) -> DataFrame:
    """Columns of another table matched by key, never by position."""
    return df.join(values.select(*keys, *names), keys, "inner")


def effect_comparison(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Two effect tables side by side with the sign agreement."""
    keys = ["treatment", "outcome"]
    pair = left.select(*keys, F.col("effect").alias(left_name)).join(
        right.select(*keys, F.col("effect").alias(right_name)), keys, "left"
    )
    agree = (F.signum(left_name) == F.signum(right_name)).cast("int")
    return pair.withColumn("same_sign", F.coalesce(agree, F.lit(0)))


def remapped_item(df: DataFrame, dimension: DataFrame, item: str, source: str, target: str) -> DataFrame:
    """Item id to group id; ids missing from the dimension pass through."""
    dim = dimension.select(F.col(source).alias(item), F.col(target).alias("_target"))
    return (
        df.join(dim, item, "left")
        .withColumn(item, F.coalesce(F.col("_target"), F.col(item)))
        .drop("_target")
    )


# --- lookups along time -------------------------------------------------------

def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
    tie: Sequence[str], prefix: str = "", direction: str = "backward", allow_equal: bool = True,
    rows_per_task: int | None = None,
) -> DataFrame:
    """For each left row the nearest right row of the same key in time.

    ``backward`` takes the last right row at or before the left time (strictly
    before unless ``allow_equal``); ``forward`` the first one after (or at).
    Among right rows at the same time the last by ``tie`` wins backward, the
    first forward.  Right columns come back with ``prefix``; unmatched are null.

    Both sides are stacked and read in time order, so the cost is one sort of
    the two inputs, whatever the number of matches per key.  As in an equality
    join a null key matches nothing; such left rows are spread over tasks.
    """
    absent = F.lit(False)
    for k in keys:
        absent = absent | F.col(k).isNull()
    right = right.filter(~absent)
    brought = [c for c in right.columns if c not in keys]
    # at equal times, right rows sort first when they may match backward and
    # last when they may match forward
    right_first = allow_equal if direction == "backward" else not allow_equal
    payload = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in brought])
    l_rows = left.select(
        *keys, F.col(left_time).alias("_at"), F.lit(1 if right_first else 0).alias("_side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
        F.when(absent, F.xxhash64(*left.columns)).otherwise(F.lit(0)).alias("_apart"),
    )
    r_rows = right.select(
        *keys, F.col(right_time).alias("_at"), F.lit(0 if right_first else 1).alias("_side"),
        payload.alias("_right"), F.struct(*[F.col(c) for c in tie]).alias("_tie"), F.lit(0).cast("long").alias("_apart"),
    )
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    cell = LastSeen("_right") if direction == "backward" else NextSeen("_right")
    found = ordered(both, [*keys, "_apart"], ["_at", "_side", "_tie"], {"_found": cell}, rows_per_task=rows_per_task)
    return found.filter(F.col("_left").isNotNull()).select(
        "_left.*", *[F.col(f"_found.{prefix}{c}").alias(f"{prefix}{c}") for c in brought]
    )


def next_start(
    episodes: DataFrame, subject: str, episode: str, start: str, end: str,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Earliest start of the subject strictly after the episode's end."""
    starts = episodes.select(subject, F.col(start).alias("next_start"))
    return as_of(
        episodes, starts, [subject], end, "next_start", ["next_start"],
        direction="forward", allow_equal=False, rows_per_task=rows_per_task,
    )


def returned_within(
    episodes: DataFrame, subject: str, episode: str, start: str, end: str, days: int,
    name: str = "readmit_30d", rows_per_task: int | None = None, exclude_same_day: bool = False, counted: Column | None = None,
) -> DataFrame:
    """1 if the subject starts another episode at most ``days`` after the end.

    The earliest later start decides, so no pair of episodes is formed.  Starts on the
    day of the end may be left out, and so may episodes that are not ``counted``
    (say, observation); both count by default.
    """
    if exclude_same_day or counted is not None:
        starts = (episodes if counted is None else episodes.filter(counted)).select(subject, F.col(start).alias("next_start"))
        after = F.col(end)
        if exclude_same_day:
            # nothing before the next midnight
            after = F.greatest(after, F.date_trunc("day", end).cast(episodes.schema[end].dataType) + F.expr("interval '23:59:59.999999' hour to second"))
        nxt = as_of(episodes.withColumn("_after", after), starts, [subject], "_after", "next_start", ["next_start"], direction="forward", allow_equal=False,
                    rows_per_task=rows_per_task).drop("_after")
    else:
        nxt = next_start(episodes, subject, episode, start, end, rows_per_task)
    gap = F.unix_micros(F.col("next_start").cast("timestamp")) - F.unix_micros(F.col(end).cast("timestamp"))
    return nxt.withColumn(name, F.coalesce((gap <= days * 86400 * 1_000_000).cast("int"), F.lit(0)))


def prior_count(
    probes: DataFrame, visits: DataFrame, keys: list[str], at: str, since: str, visit_time: str,
    name: str, cap: int | None = None, rows_per_task: int | None = None, exclude_current: tuple[str, str] | None = None,
) -> DataFrame:
    """Visits of the key with ``since <= time < at``, optionally capped.

    Two running counts (visits before ``at`` and before ``since``) and their
    difference, once for each distinct (key, at, since) and joined back, so equal
    probes stay apart.  ``visits`` must hold one row per visit.  A null key or
    time counts nothing.  ``exclude_current`` names two columns of ``probes``, the time of
    the probe's own visit and whether it is in ``visits``; then that one does not count.
    """
    asked = list(dict.fromkeys([*keys, at, since]))
    points = probes.select(*asked).dropna().distinct()
    edges = points.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*asked).alias("_point"), F.inline(F.array(
            F.struct(F.col(at).alias("_at"), F.lit(1).alias("_sign")),
            F.struct(F.col(since).alias("_at"), F.lit(-1).alias("_sign")),
        )),
    ).withColumn("_one", F.lit(0))
    seen = visits.dropna(subset=[*keys, visit_time]).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(visit_time).alias("_at"), F.lit(0).alias("_sign"), F.lit(1).alias("_one"))
    # probes sort before visits at the same time, so the counts are strict
    both = edges.unionByName(seen, allowMissingColumns=True).withColumn("_side", F.col("_one"))
    counted = ordered(both, [f"_k{i}" for i in range(len(keys))], ["_at", "_side"], {"_n": RunningSum("_one")}, rows_per_task=rows_per_task)
    per_point = counted.filter(F.col("_sign") != 0).groupBy("_point").agg(F.sum(F.col("_sign") * F.col("_n")).alias("_count"))
    out = probes.join(per_point.select("_point.*", "_count"), asked, "left").select(*[probes[c] for c in probes.columns], F.coalesce("_count", F.lit(0)).alias("_count"))
    count = F.col("_count")
    if exclude_current is not None:
        time, listed = map(F.col, exclude_current)
        count = count - F.coalesce(((listed.cast("int") == 1) & (time >= F.col(since)) & (time < F.col(at))).cast("int"), F.lit(0))
    count = count if cap is None else F.least(count, F.lit(cap))
    return out.select(*probes.columns, count.alias(name))


def action_grid(n_flags: int) -> Column:
    """Array of all flag combinations as integers 0 .. 2^n - 1."""
    return F.sequence(F.lit(0), F.lit((1 << n_flags) - 1))


def with_action_grid(df: DataFrame, n_flags: int, name: str = "action") -> DataFrame:
    """Every row once per flag combination; a narrow generator, no shuffle."""
    return df.withColumn(name, F.explode(action_grid(n_flags)))
