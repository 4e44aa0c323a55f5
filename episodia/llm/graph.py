"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodia.session import durable


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node that has an edge: ``node``, ``root``.

    Alternating stars: each node sends its larger neighbours, then its smaller
    ones, to the smallest id it knows, until the edges form stars.  The number
    of rounds grows with the logarithm of the graph; edges never multiply.
    ``edges`` has columns ``a`` and ``b``.
    """
    now = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = durable(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            stars = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        seen = mark
    raise RuntimeError("components did not settle")
