"""Range boundaries from a weighted sample, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: splitters that one step of the two-step look-up compares at most
FAN = 32


def unit_hash(*cols) -> Column:
    """A number in [0, 1) that depends only on the values of ``cols``."""
    return (F.shiftrightunsigned(F.xxhash64(*cols, F.lit("sample")), 11).cast("double")) / F.lit(float(1 << 53))


def sampled_splitters(rows: DataFrame, keys: list[str], weight: str, total: float, ranges: int, per_range: int = 32) -> list[tuple]:
    """At most ``ranges - 1`` keys that cut ``rows`` into ranges of about equal weight.

    A row is drawn with a probability in proportion to its weight, so about
    ``ranges * per_range`` rows are drawn whatever the table's size; only the
    boundaries reach the driver.
    """
    draws = float(ranges * per_range)
    total = max(float(total), 1.0)
    chance = F.col(weight) * F.lit(draws / total)
    drawn = rows.filter(unit_hash(*keys) < chance).select(*keys, F.greatest(F.col(weight).cast("double"), F.lit(total / draws)).alias("_w"))
    order = Window.orderBy(*keys)  # over the bounded sample only
    share = drawn.withColumn("_c", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = share.withColumn("_r", F.floor((F.col("_c") - F.col("_w")) * ranges / F.sum("_w").over(whole)))
    cuts = share.filter("_r > 0").groupBy("_r").agg(F.min(F.struct(*keys)).alias("_k")).orderBy("_r").collect()
    out: list[tuple] = []
    for row in cuts:
        key = tuple(row["_k"])
        if not out or key != out[-1]:
            out.append(key)
    return out


def range_of(keys: list[Column], splitters: list[tuple], types: list[str]) -> Column:
    """Number of the range that a key falls into: splitters at or below it."""
    if not splitters:
        return F.lit(0)

    def literal(some: list[tuple]) -> Column:
        return F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(s, types))]) for s in some])

    key = F.struct(*[k.cast(t).alias(f"k{i}") for i, (k, t) in enumerate(zip(keys, types))])
    coarse = F.size(F.filter(literal(splitters[::FAN]), lambda s: s <= key))
    if len(splitters) <= FAN:
        return F.size(F.filter(literal(splitters), lambda s: s <= key))
    start = F.greatest((coarse - 1) * FAN, F.lit(0))
    part = F.slice(literal(splitters), start + 1, FAN)
    return start + F.size(F.filter(part, lambda s: s <= key))
