"""Prediction metrics and distribution tests.

Rank-based metrics count equal values first and read running counts along the
distinct values, so no global sort lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodia.operators.scan import RunningSum, Total, ordered


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean absolute error, root mean square error, R2 and both means in one pass."""
    rows = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    err = F.col(predicted) - F.col(actual)
    spread = F.var_pop(actual) * F.count(F.lit(1))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.sum(err * err) / F.nullif(spread, F.lit(0.0))).alias("r2"),
        F.avg(actual).alias("mean_actual"),
        F.avg(predicted).alias("mean_predicted"),
    )


def _average_rank(df: DataFrame, c: str, name: str, rows_per_task: int | None) -> DataFrame:
    counts = df.groupBy(c).agg(F.sum("_n").alias("_k"))
    placed = ordered(counts, [], [c], {"_cum": RunningSum("_k")}, rows_per_task=rows_per_task)
    return placed.select(c, (F.col("_cum") - (F.col("_k") - 1) / 2.0).alias(name))


def spearman(df: DataFrame, x: str, y: str, name: str = "spearman",
             rows_per_task: int | None = None) -> DataFrame:
    """Correlation of average ranks; equal pairs are counted before ranking."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(
        F.count(F.lit(1)).alias("_n")
    )
    rx = _average_rank(pairs, x, "_rx", rows_per_task)
    ry = _average_rank(pairs, y, "_ry", rows_per_task)
    both = pairs.join(rx, x).join(ry, y)
    n = F.sum("_n")
    mx, my = F.sum(F.col("_n") * F.col("_rx")) / n, F.sum(F.col("_n") * F.col("_ry")) / n
    sxy = F.sum(F.col("_n") * F.col("_rx") * F.col("_ry")) / n - mx * my
    sxx = F.sum(F.col("_n") * F.col("_rx") * F.col("_rx")) / n - mx * mx
    syy = F.sum(F.col("_n") * F.col("_ry") * F.col("_ry")) / n - my * my
    return both.agg((sxy / F.nullif(F.sqrt(sxx * syy), F.lit(0.0))).alias(name))


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5,
                   rows_per_task: int | None = None) -> DataFrame:
    """AUC, average precision, Brier score, log loss and accuracy."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    counts = (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(score).agg(
            F.sum((F.col(label) == 1).cast("long")).alias("_pos"),
            F.sum((F.col(label) == 0).cast("long")).alias("_neg"),
        )
    )
    placed = ordered(
        counts, [], [score],
        {"_cp": RunningSum("_pos"), "_cn": RunningSum("_neg"), "_P": Total("_pos"), "_N": Total("_neg")},
        rows_per_task=rows_per_task,
    )
    below_n = F.col("_cn") - F.col("_neg")
    hits = F.col("_P") - F.col("_cp") + F.col("_pos")
    shown = hits + F.col("_N") - F.col("_cn") + F.col("_neg")
    said = (F.col(score) >= threshold).cast("int")
    n = F.sum(F.col("_pos") + F.col("_neg"))
    right = F.when(said == 1, F.col("_pos")).otherwise(F.col("_neg"))
    return placed.agg(
        n.alias("n"),
        (F.sum(F.col("_pos") * (below_n + F.col("_neg") / 2.0))
         / F.nullif(F.max("_P") * F.max("_N"), F.lit(0)).cast("double")).alias("auc"),
        (F.sum(F.col("_pos") * hits / shown) / F.nullif(F.max("_P"), F.lit(0))).alias("average_precision"),
        (F.sum(F.col("_pos") * F.pow(F.col(score) - 1, 2) + F.col("_neg") * F.pow(F.col(score), 2)) / n).alias("brier"),
        (-F.sum(F.col("_pos") * F.log(p) + F.col("_neg") * F.log(1 - p)) / n).alias("log_loss"),
        (F.sum(right) / n).alias("accuracy"),
    )


def feature_errors(df: DataFrame, pairs: Sequence[tuple[str, str]], flags: Sequence[str] = ()) -> DataFrame:
    """Mean squared difference per (actual, predicted) pair and rate per flag."""
    one = df.agg(
        *[F.avg(F.pow(F.col(p) - F.col(a), 2)).alias(f"mse_{a}") for a, p in pairs],
        *[F.avg(F.col(f).cast("double")).alias(f"rate_{f}") for f in flags],
    )
    return one.unpivot([], one.columns, "metric", "value")


def _ks_p_value(stat: Column, n: Column, m: Column) -> Column:
    """Asymptotic series of the two-sample test."""
    scaled = F.sqrt(n * m / (n + m)) * stat
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * scaled * scaled),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.when(scaled < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def two_sample_ks(df: DataFrame, value: str, is_first: Column, rows_per_task: int | None = None) -> DataFrame:
    """Largest gap between the two empirical distributions, means and spreads."""
    first = F.coalesce(is_first, F.lit(False))
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value), first.alias("_a"))
    counts = rows.groupBy(value).agg(
        F.sum(F.col("_a").cast("long")).alias("_n1"), F.sum((~F.col("_a")).cast("long")).alias("_n2")
    )
    placed = ordered(
        counts, [], [value],
        {"_c1": RunningSum("_n1"), "_c2": RunningSum("_n2"), "_t1": Total("_n1"), "_t2": Total("_n2")},
        rows_per_task=rows_per_task,
    )
    gap = F.abs(F.col("_c1") / F.nullif(F.col("_t1"), F.lit(0)) - F.col("_c2") / F.nullif(F.col("_t2"), F.lit(0)))

    def moments(c: str, tag: str) -> list[Column]:
        n, x = F.sum(c), F.col(value)
        mean = F.sum(F.col(c) * x) / F.nullif(n, F.lit(0))
        var = F.sum(F.col(c) * x * x) / F.nullif(n, F.lit(0)) - mean * mean
        return [mean.alias(f"mean_{tag}"), F.sqrt(F.greatest(var, F.lit(0.0))).alias(f"std_{tag}")]

    one = placed.agg(
        F.max("_t1").alias("n_first"), F.max("_t2").alias("n_second"), F.max(gap).alias("ks_stat"),
        *moments("_n1", "first"), *moments("_n2", "second"),
    )
    return one.withColumn(
        "ks_pvalue", _ks_p_value(F.col("ks_stat"), F.col("n_first").cast("double"), F.col("n_second").cast("double"))
    )
