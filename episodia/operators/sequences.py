"""Next-state columns, holds, gaps, histories and padded sequences.

Functions that take ``keys`` and ``order`` of raw rows go through
:func:`episodia.operators.scan.ordered` and tolerate a key of any size.  Those
that say *panel* expect at most one row per key and calendar step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodia.functions.scalars import uniform
from episodia.operators.scan import (
    Following, History, HotKeys, LastSeen, NextSeen, Preceding, RowIndex, RunningMax,
    RunningSum, Total, ordered, panel_window,
)




def next_state(df: DataFrame, keys: list[str], order: list[str], columns: Sequence[str],
               prefix: str = "next_", done: str = "done", index: str | None = None,
               rows_per_task: int | None = None) -> DataFrame:
    """Columns of the next row and ``done`` = 1 on the last row."""
    cells = {"_next": Following(F.struct(F.lit(1).alias("_there"), *[F.col(c) for c in columns]))}
    if index:
        cells[index] = RowIndex()
    out = ordered(df, keys, order, cells, rows_per_task=rows_per_task)
    return out.select(
        *df.columns, *([index] if index else []),
        *[F.col(f"_next.{c}").alias(f"{prefix}{c}") for c in columns],
        F.col("_next").isNull().cast("int").alias(done),
    )


def jump_label(now: str, following: str, threshold: float) -> Column:
    """1 if the next value is at least ``threshold`` higher; unknown is 0."""
    return F.coalesce(((F.col(following) - F.col(now)) >= threshold).cast("int"), F.lit(0))


def held_values(df: DataFrame, keys: list[str], at: str, tie: Sequence[str], hours: Mapping[str, float],
                suffix: str = "", rows_per_task: int | None = None) -> DataFrame:
    """Own value, else the last one if it is at most ``hours`` old, else null.

    Own definition of a time-limited hold; ``at`` is in epoch seconds and the
    limit is inclusive.
    """
    cells = {
        f"_h_{c}": LastSeen(F.when(F.col(c).isNotNull(), F.struct(F.col(at).alias("t"), F.col(c).alias("v"))))
        for c in hours
    }
    out = ordered(df, keys, [at, *tie], cells, rows_per_task=rows_per_task)
    held = {
        f"{c}{suffix}": F.when(F.col(at) - F.col(f"_h_{c}.t") <= h * 3600, F.col(f"_h_{c}.v"))
        for c, h in hours.items()
    }
    return out.withColumns(held).drop(*cells)


def filled_forward(panel: DataFrame, keys: list[str], index: str, limits: Mapping[str, int],
                   suffix: str = "") -> DataFrame:
    """Panel forward fill over at most ``limit`` rows.

    All columns share one running frame that remembers the last value and its
    row; sliding frames would be evaluated again for every row and column.
    """
    w = panel_window(keys, [index])
    rows = panel.withColumn("_row", F.row_number().over(w))
    seen = {c: last_known(c, "_row").over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in limits}
    out = rows.withColumns({f"_seen_{c}": v for c, v in seen.items()})
    return out.withColumns({
        f"{c}{suffix}": within_rows(f"_seen_{c}", "_row", n) for c, n in limits.items()
    }).drop("_row", *[f"_seen_{c}" for c in limits])


def last_known(column: str, row: str) -> Column:
    """Aggregate: last non-null value together with its row number."""
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(row).alias("at"), F.col(column).alias("v")))
    return F.last(known, ignorenulls=True)


def within_rows(seen: str, row: str, limit: int) -> Column:
    """The remembered value if it is at most ``limit`` rows old."""
    return F.when(F.col(row) - F.col(f"{seen}.at") <= limit, F.col(f"{seen}.v"))


def latched(panel: DataFrame, keys: list[str], index: str, flags: Mapping[str, str]) -> DataFrame:
    """Panel flags that stay 1 once they were 1."""
    w = panel_window(keys, [index]).rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumns({new: F.max(old).over(w) for old, new in flags.items()})


def latched_rows(df: DataFrame, keys: list[str], order: list[str], flag: str, name: str,
                 rows_per_task: int | None = None) -> DataFrame:
    return ordered(df, keys, order, {name: RunningMax(flag)}, rows_per_task=rows_per_task)


def interpolated(df: DataFrame, keys: list[str], index: str, columns: Sequence[str], suffix: str = "",
                 rows_per_task: int | None = None) -> DataFrame:
    """Linear fill in the row index between neighbours of the same key.

    Leading and trailing gaps stay null.
    """
    mark = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(index).alias("i"), F.col(c).alias("v"))) for c in columns}
    cells = {}
    for c in columns:
        cells[f"_a_{c}"] = LastSeen(mark[c])
        cells[f"_b_{c}"] = NextSeen(mark[c])
    out = ordered(df, keys, [index], cells, rows_per_task=rows_per_task)
    filled = {}
    for c in columns:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        share = (F.col(index) - a.getField("i")) / (b.getField("i") - a.getField("i"))
        filled[f"{c}{suffix}"] = F.coalesce(
            F.col(c), a.getField("v") + (b.getField("v") - a.getField("v")) * share
        )
    return out.withColumns(filled).drop(*cells)


def entries_and_exits(df: DataFrame, keys: list[str], order: list[str], inside: str,
                      entered: str = "entered", left: str = "left_unit",
                      rows_per_task: int | None = None) -> DataFrame:
    """Flags where a 0/1 state changes between consecutive rows."""
    out = ordered(df, keys, order, {"_before": Preceding(inside)}, rows_per_task=rows_per_task)
    return out.withColumns({
        entered: F.coalesce(((F.col("_before") == 0) & (F.col(inside) == 1)).cast("int"), F.lit(0)),
        left: F.coalesce(((F.col("_before") == 1) & (F.col(inside) == 0)).cast("int"), F.lit(0)),
    }).drop("_before")


def history_vectors(df: DataFrame, keys: list[str], order: list[str], columns: Sequence[str], n: int,
                    name: str = "history", with_next: bool = True,
                    rows_per_task: int | None = None) -> DataFrame:
    """The last ``n`` rows as one flat vector, zeros on the left.

    ``next_<name>`` is the vector of the next row, all zeros on the last row.
    """
    width = len(columns)
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    out = ordered(df, keys, order, {"_h": History(values, n)}, rows_per_task=rows_per_task)
    zeros = F.array_repeat(F.lit(0.0), (F.lit(n) - F.size("_h")) * width)
    out = out.withColumn(name, F.concat(zeros, F.flatten("_h"))).drop("_h")
    if with_next:
        out = ordered(out, keys, order, {"_n": Following(name)}, rows_per_task=rows_per_task)
        out = out.withColumn(
            f"next_{name}", F.coalesce("_n", F.array_repeat(F.lit(0.0), n * width))
        ).drop("_n")
    return out


def last_rows(df: DataFrame, keys: list[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows per key; the limit applies before the shuffle."""
    from episodia.operators.sampling import top_per_group

    return top_per_group(df, keys, [F.col(c).desc() for c in order], n, "_back").drop("_back")


def random_window(df: DataFrame, keys: list[str], order: list[str], n: int, seed: int,
                  rows_per_task: int | None = None) -> DataFrame:
    """A contiguous run of ``n`` rows per key; shorter keys are kept whole."""
    out = ordered(df, keys, order, {"_i": RowIndex(), "_n": Total(F.lit(1), "count")}, rows_per_task=rows_per_task)
    room = F.greatest(F.col("_n") - n, F.lit(0)) + 1
    begin = F.floor(uniform(F.lit("window"), F.lit(seed), *keys) * room)
    return out.filter((F.col("_i") >= begin) & (F.col("_i") < begin + n)).drop("_i", "_n")


def seed_rows(df: DataFrame, keys: list[str], order: list[str], n: int, horizon: int = 0,
              rows_per_task: int | None = None) -> DataFrame:
    """First ``n`` rows of the keys that have at least ``n + horizon`` rows."""
    out = ordered(df, keys, order, {"_i": RowIndex(), "_n": Total(F.lit(1), "count")}, rows_per_task=rows_per_task)
    return out.filter((F.col("_n") >= n + horizon) & (F.col("_i") < n)).drop("_i", "_n")


def transition_pairs(df: DataFrame, keys: list[str], order: list[str], target: str,
                     rows_per_task: int | None = None) -> DataFrame:
    """Rows with a known next value of ``target``."""
    out = ordered(df, keys, order, {f"next_{target}": Following(target)}, rows_per_task=rows_per_task)
    return out.filter(F.col(f"next_{target}").isNotNull())


def padded_sequences(df: DataFrame, keys: list[str], order: list[str], columns: Sequence[str],
                     length: int, rows_per_task: int | None = None) -> DataFrame:
    """Arrays of exactly ``length`` steps with a mask.

    Episodes longer than ``length`` continue in further ``part`` rows, so no
    step is dropped and no array grows with the data.
    """
    placed = ordered(df, keys, order, {"_i": RowIndex()}, rows_per_task=rows_per_task)
    step = F.struct(F.col("_i"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x"))
    packed = (
        placed.withColumn("part", F.floor(F.col("_i") / length).cast("long"))
        .groupBy(*keys, "part").agg(F.sort_array(F.collect_list(step)).alias("_s"))
    )
    n = F.size("_s")
    blank = F.array_repeat(F.array(*[F.lit(0.0) for _ in columns]), F.lit(length) - n)
    return packed.select(
        *keys, "part", n.alias("n_steps"),
        F.concat(F.col("_s.x"), blank).alias("steps"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n)).alias("mask"),
    )


def running_totals(df: DataFrame, keys: list[str], order: list[str], sums: Mapping[str, str],
                   rows_per_task: int | None = None) -> DataFrame:
    return ordered(df, keys, order, {new: RunningSum(old) for old, new in sums.items()}, rows_per_task=rows_per_task)


def episode_bounds(df: DataFrame, keys: list[str], order: list[str], start: str, end: str,
                   rows_per_task: int | None = None) -> DataFrame:
    """Smallest start and largest end of the key on every row."""
    return ordered(df, keys, order, {"first_start": Total(start, "min"), "last_end": Total(end, "max")},
                   rows_per_task=rows_per_task)


def row_number_in(df: DataFrame, keys: list[str], order: list[str], name: str, first: int = 1,
                  rows_per_task: int | None = None) -> DataFrame:
    out = ordered(df, keys, order, {name: RowIndex()}, rows_per_task=rows_per_task)
    return out.withColumn(name, F.col(name) + first)
