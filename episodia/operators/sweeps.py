"""Intervals against time bins by a sweep over starts, ends and bin edges.

An interval is two events whatever its length.  Running sums over events and edges in
time order give, at every edge, how many intervals have begun and ended and the
integral of their rates so far; a bin is the difference between its edges.  Medians
need the rates themselves: a task passes over the starts and ends of a stretch of bins and keeps the
rates that are active, in order.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodia.operators.scan import RunningSum, ordered

#: bins in one stretch of the median sweep
STRETCH = 1024


def edged(bins: DataFrame, episodes: DataFrame, keys: list[str], start: str, width: int) -> DataFrame:
    """``bins`` (keys and ``bin``) of ``episodes`` with ``_t0`` and ``_t1``, seconds since the episode's start.

    Bins are often expanded from few episodes in one task, which must not gather them; so they are dealt anew.
    """
    return edges_of(bins.select(*keys, "bin").repartition(*keys, "bin").join(episodes.select(*keys), keys), keys, width)


def edges_of(bins: DataFrame, keys: list[str], width: int) -> DataFrame:
    t0 = F.col("bin") * width
    return bins.select(*keys, "bin", t0.alias("_t0"), (t0 + width).alias("_t1"))


def swept(intervals: DataFrame, bins: DataFrame, episodes: DataFrame, keys: list[str], begin: str, finish: str, start: str, width: int,
          rates: Mapping[str, Column], flags: Mapping[str, Column], rows_per_task: int | None = None) -> DataFrame:
    """For each of ``bins`` the integral of ``rates`` (per second) and whether any interval of ``flags`` overlaps.

    Adds ``_live``: whether any interval overlaps at all.  Intervals are half-open and cut to the
    episode's start; those without duration overlap nothing.  A bin without an interval has zeros.
    """
    at, end = F.col(begin) - F.col(start), F.col(finish) - F.col(start)
    rows = intervals.join(episodes.select(*keys, start), keys).select(
        *keys, F.greatest(at, F.lit(0)).cast("long").alias("_b"), end.cast("long").alias("_f"),
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_r{i}") for i, c in enumerate(rates.values())],
        *[F.coalesce(c, F.lit(False)).cast("long").alias(f"_g{i}") for i, c in enumerate(flags.values())],
        F.lit(1).cast("long").alias(f"_g{len(flags)}"),
    ).filter(F.col("_f") > F.col("_b"))
    n_r, n_g = len(rates), len(flags) + 1
    # at one time ends come first and starts last, so an edge sees what overlaps its own bin
    events = [F.struct(
        F.col(t).alias("_t"), F.lit(order).alias("_o"), F.lit(None).cast("long").alias("bin"), *[(F.col(f"_r{i}") * sign).alias(f"_r{i}") for i in range(n_r)],
        *[(F.col(f"_r{i}") * F.col(t) * sign).alias(f"_c{i}") for i in range(n_r)],
        *[F.when(F.lit(sign > 0), F.col(f"_g{i}")).otherwise(0).alias(f"_b{i}") for i in range(n_g)],
        *[F.when(F.lit(sign < 0), F.col(f"_g{i}")).otherwise(0).alias(f"_e{i}") for i in range(n_g)])
        for t, order, sign in (("_b", 3, 1.0), ("_f", 0, -1.0))]
    changes = rows.select(*keys, F.inline(F.array(*events)))
    zero = [F.lit(0.0).alias(f"_{x}{i}") for x in "rc" for i in range(n_r)] + [F.lit(0).cast("long").alias(f"_{x}{i}") for x in "be" for i in range(n_g)]
    edges = [F.struct(F.col(t).cast("long").alias("_t"), F.lit(order).alias("_o"), F.col("bin").cast("long").alias("bin"), *zero) for t, order in (("_t0", 1), ("_t1", 2))]
    stacked = changes.unionByName(edged(bins, episodes, keys, start, width).select(*keys, F.inline(F.array(*edges))))
    stacked = stacked.withColumn("_row", F.monotonically_increasing_id())
    sums = {f"_s{c}": RunningSum(c) for c in [f"_{x}{i}" for x in "rc" for i in range(n_r)] + [f"_{x}{i}" for x in "be" for i in range(n_g)]}
    seen = ordered(stacked, keys, ["_t", "_o", "_row"], sums, rows_per_task=rows_per_task).filter(F.col("bin").isNotNull())
    left, right = F.col("_o") == 1, F.col("_o") == 2
    whole = [F.col(f"_s_r{i}") * F.col("_t") - F.col(f"_s_c{i}") for i in range(n_r)]
    per_bin = seen.groupBy(*keys, "bin").agg(
        *[(F.max(F.when(right, w)) - F.max(F.when(left, w))).alias(f"_w{i}") for i, w in enumerate(whole)],
        *[(F.max(F.when(right, F.col(f"_s_b{i}"))) - F.max(F.when(left, F.col(f"_s_e{i}")))).alias(f"_n{i}") for i in range(n_g)])
    live = F.col(f"_n{n_g - 1}") > 0
    # without an interval the sums may differ from zero in their last digits
    return per_bin.select(
        *keys, "bin", *[F.when(live, F.col(f"_w{i}")).otherwise(0.0).alias(n) for i, n in enumerate(rates)],
        *[(F.col(f"_n{i}") > 0).cast("int").alias(n) for i, n in enumerate(flags)], live.alias("_live"))


def volume_at(intervals: DataFrame, bins: DataFrame, episodes: DataFrame, keys: list[str], begin: str, finish: str, rate: str, start: str,
              width: int, name: str = "volume", rows_per_task: int | None = None) -> DataFrame:
    """Hourly ``rate`` times the overlapping hours in the bins that any interval overlaps; null where no rate is known."""
    out = swept(intervals, bins, episodes, keys, begin, finish, start, width, {name: F.col(rate) / 3600.0}, {"_known": F.col(rate).isNotNull()}, rows_per_task)
    return out.filter("_live").withColumn(name, F.when(F.col("_known") == 1, F.col(name))).drop("_live", "_known")


def with_instant(intervals: DataFrame, begin: str, finish: str) -> DataFrame:
    """An interval without duration lasts one second."""
    return intervals.withColumn(finish, F.when(F.col(finish) > F.col(begin), F.col(finish)).otherwise(F.col(begin) + 1))


def flags_at(intervals: DataFrame, bins: DataFrame, episodes: DataFrame, keys: list[str], begin: str, finish: str, item: str,
             names: Mapping[object, str], start: str, width: int, rows_per_task: int | None = None) -> DataFrame:
    """Per bin and item class 1 if any interval overlaps; bins that no listed item overlaps are left out."""
    listed = with_instant(intervals.filter(F.col(item).isin(list(names))), begin, finish)
    out = swept(listed, bins, episodes, keys, begin, finish, start, width, {}, {n: F.col(item) == i for i, n in names.items()}, rows_per_task)
    return out.filter("_live").drop("_live")


def rates_at(intervals: DataFrame, bins: DataFrame, episodes: DataFrame, keys: list[str], begin: str, finish: str, rate: str, start: str,
             width: int, median: str = "median", largest: str = "max", stretch: int = STRETCH) -> DataFrame:
    """Median and largest ``rate`` of the intervals that overlap each of ``bins``, where there are any.

    Starts and ends are dealt by (keys, stretch of bins) and pass through a task in time order; an
    interval is there once for each stretch it touches.  A task holds the active rates alone.
    """
    live = with_instant(intervals.filter(F.col(rate).isNotNull()), begin, finish)
    seconds = stretch * width
    joined = live.join(episodes.select(*keys, start), keys)
    b, f = F.greatest(F.col(begin) - F.col(start), F.lit(0)).cast("long"), (F.col(finish) - F.col(start)).cast("long")
    cut = joined.select(*keys, b.alias("_b"), f.alias("_f"), F.col(rate).cast("double").alias("_v")).filter("_f > _b")
    stretches = F.sequence(F.floor(F.col("_b") / seconds), F.floor((F.col("_f") - 1) / seconds))
    cut = cut.withColumn("_s", F.explode(stretches)).select(*keys, "_s", F.inline(F.array(
        F.struct(F.col("_b").alias("_t"), F.lit(1).alias("_o"), "_f", "_v", F.lit(None).cast("long").alias("bin")))))
    # bins without an episode meet no interval, and repeated ones are skipped in the pass
    asked = edges_of(bins, keys, width).select(
        *keys, F.floor(F.col("_t0") / seconds).alias("_s"), F.col("_t1").alias("_t"), F.lit(0).alias("_o"), F.col("_t0").alias("_f"), F.lit(None).cast("double").alias("_v"),
        F.col("bin").cast("long").alias("bin"))
    stacked = cut.unionByName(asked)
    key_types = [stacked.schema[k].dataType.simpleString() for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rates, ends, last = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(k).to_pylist() for k in keys]
            rows = zip(*columns, *[batch.column(c).to_pylist() for c in ("_s", "_o", "_f", "_v", "bin")])
            for *key, _s, is_start, f, v, index in rows:
                if now != (*key, _s):
                    now, rates, ends, last = (*key, _s), [], [], None
                if is_start:
                    insort(rates, v)
                    insort(ends, (f, v))
                    continue
                if index == last:
                    continue
                last = index
                # what ended by the bin's start is over for all later bins
                over = bisect_left(ends, (f + 1,))
                for _, old in ends[:over]:
                    del rates[bisect_left(rates, old)]
                del ends[:over]
                if rates:
                    n = len(rates)
                    out.append((*key, index, (rates[(n - 1) // 2] + rates[n // 2]) / 2, rates[-1]))
            names = [*keys, "bin", median, largest]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], batch.schema.field(k).type) for i, k in enumerate(keys)] + [
                pa.array([r[len(keys) + i] for r in out], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64()))], names)

    # an edge comes after the starts before it and before those at its own time
    sorted_rows = stacked.repartition(*keys, "_s").sortWithinPartitions(*keys, "_s", "_t", "_o", "bin")
    schema = ", ".join(f"`{k}` {t}" for k, t in zip(keys, key_types))
    return sorted_rows.mapInArrow(run, f"{schema}, bin long, `{median}` double, `{largest}` double")
