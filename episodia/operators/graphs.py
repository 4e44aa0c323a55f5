"""Edge tables of learned graphs: typing, agreement and stability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodia.operators.scan import RowIndex, ordered

# End marks of an edge in the long matrix (fixed values).
ARROW, TAIL, CIRCLE = -1, 1, 2


def typed_edges(matrix: DataFrame, keys: list[str], i: str, j: str, mark: str, ancestral: bool = True) -> DataFrame:
    """Long matrix of end marks to typed edges.

    In an ancestral graph the mark of (i, j) is the one at the ``j`` end: arrow
    at j with a tail or circle at i is a definite or possible edge, two arrows
    are bidirected.  Otherwise the matrix is that of a completed partially
    directed graph, where the mark of (i, j) is the one at the ``i`` end: a
    tail at i with an arrow at j is directed, two tails are undirected.
    Both directions of a pair meet in one aggregation on the unordered pair.
    """
    forward = F.col(i) < F.col(j)
    pair = matrix.filter((F.col(mark) != 0) & (F.col(i) != F.col(j))).groupBy(
        *keys, F.least(i, j).alias("_a"), F.greatest(i, j).alias("_b")
    ).agg(
        F.max(F.when(forward, F.col(mark))).alias("_ab"),
        F.max(F.when(~forward, F.col(mark))).alias("_ba"),
    )

    def rule(ab, ba, kind, source="_a", target="_b"):
        edge = F.struct(F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("edge_type"))
        return F.when((F.col("_ab") == ab) & (F.col("_ba") == ba), edge)

    if ancestral:
        rules = [
            rule(ARROW, TAIL, "definite"), rule(TAIL, ARROW, "definite", "_b", "_a"),
            rule(ARROW, CIRCLE, "possible"), rule(CIRCLE, ARROW, "possible", "_b", "_a"),
            rule(ARROW, ARROW, "bidirected"),
        ]
    else:
        rules = [
            rule(TAIL, ARROW, "directed"), rule(ARROW, TAIL, "directed", "_b", "_a"),
            rule(TAIL, TAIL, "undirected"),
        ]
    return pair.withColumn("_e", F.coalesce(*rules)).filter(F.col("_e").isNotNull()).select(*keys, "_e.*")


def weighted_edges(matrix: DataFrame, keys: list[str], i: str, j: str, weight: str, at_least: float) -> DataFrame:
    """Edges of a weight matrix at or above a threshold; (i, j) points from j to i."""
    return matrix.filter((F.abs(weight) >= at_least) & (F.col(i) != F.col(j))).select(
        *keys, F.col(j).alias("source"), F.col(i).alias("target"), F.lit("directed").alias("edge_type"),
        F.round(F.col(weight), 4).alias("weight"),
    )


def respecting_time(edges: DataFrame, tiers: DataFrame, directed: Sequence[str] = ("directed", "definite", "possible")) -> DataFrame:
    """Drop directed edges that point to an earlier tier; keep all others.

    ``tiers`` has (variable, tier); an unknown source counts as the first tier
    and an unknown target as the last one.
    """
    s = tiers.select(F.col("variable").alias("source"), F.col("tier").alias("_s"))
    t = tiers.select(F.col("variable").alias("target"), F.col("tier").alias("_t"))
    joined = edges.join(s, "source", "left").join(t, "target", "left")
    fine = F.coalesce("_s", F.lit(0)) <= F.coalesce("_t", F.lit(2))
    return joined.filter(~F.col("edge_type").isin(list(directed)) | fine).select(*edges.columns)


def edge_agreement(edges: DataFrame, keys: list[str], algorithm: str = "algorithm") -> DataFrame:
    """How many algorithms found an edge, and which."""
    return edges.groupBy(*keys, "source", "target").agg(
        F.countDistinct(algorithm).alias("n_algorithms"),
        F.array_join(F.sort_array(F.collect_set(algorithm)), ",").alias("algorithms"),
    )


def stability(runs: DataFrame, keys: list[str], edge_type: str = "edge_type", rows_per_task: int | None = None) -> DataFrame:
    """Frequency of definite and of any edge over the runs that include a pair.

    ``runs`` has one row per run and included pair; ``edge_type`` may be null.
    """
    out = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs_included"),
        F.sum(F.when(F.col(edge_type) == "definite", 1).otherwise(0)).alias("n_definite"),
        F.sum(F.when(F.col(edge_type) == "possible", 1).otherwise(0)).alias("n_possible"),
    )
    out = out.withColumn("n_any", F.col("n_definite") + F.col("n_possible")).withColumns({
        "freq_definite": F.round(F.col("n_definite") / F.col("n_runs_included"), 4),
        "freq_any": F.round((F.col("n_definite") + F.col("n_possible")) / F.col("n_runs_included"), 4),
    })
    ranked = out.withColumns({"_d": -F.col("freq_definite"), "_a": -F.col("freq_any")})
    ranked = ordered(ranked, [], ["_d", "_a", *keys], {"rank": RowIndex()}, rows_per_task=rows_per_task)
    return ranked.withColumn("rank", F.col("rank") + 1).drop("_d", "_a")


def matrix_view(table: DataFrame, row: str, column: str, value: str, names: Mapping[str, str]) -> DataFrame:
    """Long table to a matrix with one column per listed name."""
    return table.groupBy(row).agg(
        *[F.coalesce(F.max(F.when(F.col(column) == c, F.col(value))), F.lit(0.0)).alias(n) for c, n in names.items()]
    )
