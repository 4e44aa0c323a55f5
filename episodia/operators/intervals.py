"""Interval and bin algebra.

Intervals and bins are half-open: ``[start, end)``.  An interval is expanded to
the indexes of the bins it touches, cut to the episode's window first, and then
meets its bin by equality on (episode, bin).  One long episode therefore spreads
over as many hash partitions as it has bins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodia.operators.scan import panel_window


def day_spine(episodes: DataFrame, start: str, end: str, day: str = "calendar_date",
              index: str = "day_of_stay", last: str = "is_last_day") -> DataFrame:
    """One row per episode and calendar day, both ends included.

    Episodes that end on the day they start are dropped.
    """
    first, final = F.to_date(start), F.to_date(end)
    days = F.when(final > first, F.sequence(first, final))
    return (
        episodes.select("*", F.posexplode(days).alias(index, day))
        .withColumn(last, (F.col(day) == F.to_date(end)).cast("int"))
    )


def bin_count(start, end, width: int) -> Column:
    """Number of bins of ``width`` seconds that cover ``[start, end)``."""
    return F.ceil((F.col(end) - F.col(start)) / F.lit(width)).cast("long")


def bin_spine(episodes: DataFrame, start: str, end: str, width: int, index: str = "bin") -> DataFrame:
    """One row per episode and time bin; ``start``/``end`` are epoch seconds."""
    n = bin_count(start, end, width)
    bins = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))
    return (
        episodes.withColumn(index, F.explode(bins))
        .withColumn("bin_start", F.col(start) + F.col(index) * width)
        .withColumn("bin_end", F.col(start) + (F.col(index) + 1) * width)
    )


def bin_index(ts, start, width: int) -> Column:
    return F.floor((F.col(ts) - F.col(start)) / F.lit(width)).cast("long")


def points_to_bins(points: DataFrame, episodes: DataFrame, keys: list[str], at: str, start: str,
                   end: str, width: int, index: str = "bin") -> DataFrame:
    """Points with the index of their bin; points outside the bins drop out."""
    frame = episodes.select(*keys, start, end)
    joined = points.join(frame, keys, "inner")
    i = bin_index(at, start, width)
    return (
        joined.withColumn(index, i)
        .filter((F.col(index) >= 0) & (F.col(index) < bin_count(start, end, width)))
        .drop(start, end)
    )


def intervals_to_bins(intervals: DataFrame, episodes: DataFrame, keys: list[str], begin: str,
                      finish: str, start: str, end: str, width: int, index: str = "bin") -> DataFrame:
    """Each interval once per bin it overlaps, with ``overlap`` in seconds.

    The interval is cut to the bins of its episode before it is expanded.
    """
    joined = intervals.join(episodes.select(*keys, start, end), keys, "inner")
    limit = F.col(start) + bin_count(start, end, width) * width
    low = F.greatest(F.col(begin), F.col(start))
    high = F.least(F.col(finish), limit)
    first = F.floor((low - F.col(start)) / F.lit(width)).cast("long")
    final = F.ceil((high - F.col(start)) / F.lit(width)).cast("long") - 1
    touched = F.when(high > low, F.sequence(first, final))
    spread = joined.withColumn(index, F.explode(touched))
    t0 = F.col(start) + F.col(index) * width
    part = F.least(F.col(finish), t0 + width) - F.greatest(F.col(begin), t0)
    return spread.withColumn("overlap", part).drop(start, end)


def volume_per_bin(intervals: DataFrame, episodes: DataFrame, keys: list[str], begin: str, finish: str,
                   rate: str, start: str, end: str, width: int, name: str = "volume") -> DataFrame:
    """Hourly ``rate`` times the overlapping hours, summed per bin."""
    cut = intervals_to_bins(intervals, episodes, keys, begin, finish, start, end, width)
    return cut.groupBy(*keys, "bin").agg(
        F.sum(F.col(rate) * F.col("overlap") / 3600.0).alias(name)
    )


def _with_duration(intervals: DataFrame, begin: str, finish: str) -> DataFrame:
    """``_finish`` is one second after the start where there is no duration."""
    return intervals.withColumn(
        "_finish", F.when(F.col(finish) > F.col(begin), F.col(finish)).otherwise(F.col(begin) + 1)
    )


def active_flags_per_bin(intervals: DataFrame, episodes: DataFrame, keys: list[str], begin: str,
                         finish: str, item: str, names: Mapping[object, str], start: str, end: str,
                         width: int) -> DataFrame:
    """Per bin and item class: 1 if any interval overlaps.

    An interval without duration counts in the bin that holds its start.
    """
    listed = intervals.filter(F.col(item).isin(list(names)))
    cut = intervals_to_bins(_with_duration(listed, begin, finish), episodes, keys, begin, "_finish", start, end, width)
    return cut.groupBy(*keys, "bin").agg(
        *[F.max((F.col(item) == i).cast("int")).alias(n) for i, n in names.items()]
    )


def active_rates_per_bin(intervals: DataFrame, episodes: DataFrame, keys: list[str], begin: str,
                         finish: str, rate: str, start: str, end: str, width: int) -> DataFrame:
    """Rows (key, bin, rate) of every interval active in a bin.

    An interval without duration counts in the bin that holds its start.
    """
    live = _with_duration(intervals.filter(F.col(rate).isNotNull()), begin, finish)
    return intervals_to_bins(live, episodes, keys, begin, "_finish", start, end, width).select(
        *keys, "bin", rate
    )


def totals_before(points: DataFrame, episodes: DataFrame, keys: list[str], at: str, value: str,
                  start: str, name: str) -> DataFrame:
    """Sum of point values before the first bin, 0 where there are none."""
    early = points.join(episodes.select(*keys, start), keys, "inner").filter(F.col(at) < F.col(start))
    sums = early.groupBy(*keys).agg(F.sum(value).alias(name))
    return episodes.join(sums, keys, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def volume_before(intervals: DataFrame, episodes: DataFrame, keys: list[str], begin: str, finish: str,
                  rate: str, start: str, name: str) -> DataFrame:
    """Infused volume up to the first bin, 0 where there is none."""
    joined = intervals.join(episodes.select(*keys, start), keys, "inner")
    seconds = F.least(F.col(finish), F.col(start)) - F.col(begin)
    sums = (
        joined.filter(seconds > 0)
        .groupBy(*keys).agg(F.sum(F.col(rate) * seconds / 3600.0).alias(name))
    )
    return episodes.join(sums, keys, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def running_balance(panel: DataFrame, keys: list[str], index: str, gain: str, loss: str,
                    opening_gain: str, opening_loss: str, carry_unoccupied: Sequence[DataFrame] = ()) -> DataFrame:
    """Running totals over the panel's bins on top of the opening totals.

    What falls into bins that the panel lacks is lost, unless tables with the gains and
    losses of all bins (keys, ``index`` and ``gain`` or ``loss``) are given: then it
    is carried to the next bin of the panel.
    """
    if carry_unoccupied:
        known = [t.select(*keys, index, *[(F.col(c) if c in t.columns else F.lit(None)).cast("double").alias(c) for c in (gain, loss)]) for t in carry_unoccupied]
        parts = known[0]
        for t in known[1:]:
            parts = parts.unionByName(t)
        empty = parts.groupBy(*keys, index).agg(F.sum(gain).alias(gain), F.sum(loss).alias(loss)).join(panel.select(*keys, index), [*keys, index], "left_anti")
        # openings belong to the panel's rows, which alone stay
        out = running_balance(panel.withColumn("_occupied", F.lit(1)).unionByName(empty, allowMissingColumns=True), keys, index, gain, loss, opening_gain, opening_loss)
        return out.filter("_occupied = 1").drop("_occupied")
    w = panel_window(keys, [index]).rowsBetween(Window.unboundedPreceding, 0)
    out = panel.withColumns({
        "gain_total": F.col(opening_gain) + F.sum(F.coalesce(gain, F.lit(0.0))).over(w),
        "loss_total": F.col(opening_loss) + F.sum(F.coalesce(loss, F.lit(0.0))).over(w),
    })
    return out.withColumn("balance", F.col("gain_total") - F.col("loss_total"))


def interval_days(intervals: DataFrame, begin: str, finish: str, day: str = "calendar_date") -> DataFrame:
    """One row per interval and day, the last day excluded.

    A missing end counts as one day; an interval without a full day yields no
    rows (``sequence`` would otherwise run backwards).
    """
    first = F.to_date(begin)
    final = F.coalesce(F.to_date(finish), F.date_add(first, 1))
    days = F.when(final > first, F.sequence(first, F.date_sub(final, 1)))
    return intervals.withColumn(day, F.explode(days))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, begin: str,
                        finish: str, bucket: int) -> DataFrame:
    """Pairs of points and intervals of the same key with ``begin <= at <= finish``.

    Times are epoch seconds.  Both sides get a time bucket of ``bucket``
    seconds; an interval is repeated for the buckets it spans, a point has
    one.  The join is on (key, bucket), so a key with very many points is
    spread over its buckets and each pair is found exactly once.
    """
    spans = F.when(
        F.col(finish) >= F.col(begin),
        F.sequence(F.floor(F.col(begin) / F.lit(bucket)), F.floor(F.col(finish) / F.lit(bucket))),
    )
    right = intervals.withColumn("_bucket", F.explode(spans))
    left = points.withColumn("_bucket", F.floor(F.col(at) / F.lit(bucket)))
    return (
        left.join(right, [*keys, "_bucket"], "inner")
        .filter(F.col(at).between(F.col(begin), F.col(finish)))
        .drop("_bucket")
    )


def containing_interval(days: DataFrame, intervals: DataFrame, keys: list[str], day: str, begin: str,
                        finish: str, tie: Sequence[str], brought: Sequence[str]) -> DataFrame:
    """The interval that contains each day, else the last one that began before.

    Days are dates and ``begin <= day < finish``; of several containing
    intervals the latest start wins, then ``tie``.  Intervals are expanded to
    days, reduced to the winner per (key, day) and matched by equality; the
    fallback is an as-of lookup, used where nothing contains the day.
    """
    from episodia.operators.joins import as_of

    rank = F.struct(*[F.col(c) for c in [begin, *tie]])
    picked = F.struct(*[F.col(c) for c in dict.fromkeys([begin, *brought])])
    winners = (
        interval_days(intervals, begin, finish, "_day")
        .groupBy(*keys, F.col("_day").alias(day))
        .agg(F.max_by(picked, rank).alias("_inside"))
    )
    matched = days.join(winners, [*keys, day], "left")
    earlier = intervals.select(*keys, F.to_date(begin).alias("_from"), rank.alias("_rank"),
                               picked.alias("_before"))
    both = as_of(matched, earlier, keys, day, "_from", ["_rank"])
    best = F.coalesce(F.col("_inside"), F.col("_before"))
    out = both.withColumn("_best", best)
    return out.select(
        *days.columns,
        F.col(f"_best.{begin}").alias("matched_start"),
        *[F.col(f"_best.{c}").alias(c) for c in brought if c != begin],
        F.col("_inside").isNotNull().cast("int").alias("contained"),
    )
