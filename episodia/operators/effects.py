"""Treatment-effect estimates from given propensity and outcome columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodia.functions import fixed_values as fixed
from episodia.functions.scalars import verdict


def clipped(p: str | Column, bounds=fixed.PROPENSITY_CLIP) -> Column:
    c = F.col(p) if isinstance(p, str) else p
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(bounds[0])), F.lit(bounds[1])))


def _treated(t: str) -> Column:
    return F.coalesce(F.col(t).cast("int"), F.lit(0))


def _valid(df: DataFrame, treatment: str, outcome: str) -> DataFrame:
    return df.filter(F.col(treatment).isNotNull() & F.col(outcome).isNotNull())


def overlap_summary(df: DataFrame, treatment: str, p: str) -> DataFrame:
    """Arm sizes, propensity range per arm and the share outside the inner range."""
    t, low, high = _treated(treatment), *fixed.OVERLAP_RANGE
    one, zero = F.when(t == 1, F.col(p)), F.when(t == 0, F.col(p))
    outside = F.avg(((F.col(p) < low) | (F.col(p) > high)).cast("double"))
    return df.agg(
        F.lit(treatment).alias("treatment"),
        F.sum((t == 1).cast("long")).alias("n_treated"),
        F.sum((t == 0).cast("long")).alias("n_control"),
        F.avg(one).alias("mean_treated"), F.avg(zero).alias("mean_control"),
        F.min(one).alias("min_treated"), F.max(one).alias("max_treated"),
        F.min(zero).alias("min_control"), F.max(zero).alias("max_control"),
        outside.alias("share_outside"),
        (outside > fixed.POOR_OVERLAP_SHARE).cast("int").alias("poor_overlap"),
    )


def balance_table(df: DataFrame, treatment: str, p: str, confounders: Sequence[str]) -> DataFrame:
    """Raw and weighted standardised mean difference per confounder."""
    return balance_tables(df, {treatment: p}, confounders)


def balance_tables(df: DataFrame, scores: dict[str, str], confounders: Sequence[str]) -> DataFrame:
    """Balance of every treatment in ``scores`` (treatment to propensity column) from one pass.

    Rows are turned into (treatment, confounder, value) triples and reduced on the map
    side; each task sends one row per treatment and confounder.  A treatment is no confounder of its own.
    """
    triples = []
    for treatment, p in scores.items():
        t, pc = _treated(treatment), clipped(p)
        w = F.when(t == 1, 1 / pc).otherwise(1 / (1 - pc))
        triples += [
            F.struct(F.lit(treatment).alias("treatment"), F.lit(c).alias("confounder"), t.alias("t"), w.alias("w"), F.col(c).cast("double").alias("x"))
            for c in confounders if c != treatment]
    long = df.select(F.inline(F.array(*triples))).filter(F.col("x").isNotNull())
    arm = {a: (F.col("t") == a) for a in (1, 0)}
    cells = []
    for a, is_arm in arm.items():
        x, wx = F.when(is_arm, F.col("x")), F.when(is_arm, F.col("w"))
        cells += [
            F.count(x).alias(f"n{a}"), F.avg(x).alias(f"m{a}"), F.var_samp(x).alias(f"v{a}"),
            F.sum(wx).alias(f"sw{a}"), F.sum(wx * F.col("x")).alias(f"swx{a}"),
            F.sum(wx * F.col("x") * F.col("x")).alias(f"swxx{a}"),
        ]
    s = long.groupBy("treatment", "confounder").agg(*cells)
    enough = (F.col("n1") >= 2) & (F.col("n0") >= 2)
    raw = (F.col("m1") - F.col("m0")) / F.nullif(F.sqrt((F.col("v1") + F.col("v0")) / 2), F.lit(0.0))
    mu = {a: F.col(f"swx{a}") / F.col(f"sw{a}") for a in (1, 0)}
    var = {a: F.greatest(F.col(f"swxx{a}") / F.col(f"sw{a}") - mu[a] * mu[a], F.lit(0.0)) for a in (1, 0)}
    weighted = (mu[1] - mu[0]) / F.nullif(F.sqrt((var[1] + var[0]) / 2), F.lit(0.0))
    out = s.select("treatment", "confounder", F.when(enough, raw).alias("raw_smd"), F.when(enough, weighted).alias("weighted_smd"))
    return out.withColumn("well_balanced", (F.abs("weighted_smd") < 0.1).cast("int"))


def balance_summary(table: DataFrame, bad_above: float = 0.2) -> DataFrame:
    """Mean absolute difference before and after weighting, per treatment."""
    return table.groupBy("treatment").agg(
        F.avg(F.abs("raw_smd")).alias("mean_raw"),
        F.avg(F.abs("weighted_smd")).alias("mean_weighted"),
        F.sum((F.abs("raw_smd") > bad_above).cast("long")).alias("n_bad"),
        (F.avg(F.abs("weighted_smd")) < F.avg(F.abs("raw_smd"))).cast("int").alias("improved"),
    )


def worst_balanced(table: DataFrame, bad_above: float = 0.2) -> DataFrame:
    return table.filter(F.abs("raw_smd") > bad_above).orderBy(F.abs("raw_smd").desc(), "treatment", "confounder")


def naive_effect(df: DataFrame, treatment: str, outcome: str, name: str = "naive") -> DataFrame:
    t = F.col(treatment).cast("int")
    return _valid(df, treatment, outcome).agg(
        (F.avg(F.when(t == 1, F.col(outcome))) - F.avg(F.when(t == 0, F.col(outcome)))).alias(name)
    )


def weighted_effect(df: DataFrame, treatment: str, outcome: str, p: str, name: str = "ipw") -> DataFrame:
    """Self-normalised inverse-probability weighting."""
    t, pc = F.col(treatment).cast("int"), clipped(p)
    w1, w0 = t / pc, (1 - t) / (1 - pc)
    y = F.col(outcome)
    return _valid(df, treatment, outcome).agg(
        (F.sum(w1 * y) / F.sum(w1) - F.sum(w0 * y) / F.sum(w0)).alias(name)
    )


def pseudo_outcome(treatment: str, outcome: str, p: str, mu1: str, mu0: str) -> Column:
    """Doubly robust contribution of one row."""
    t, pc, y = F.col(treatment).cast("int"), clipped(p), F.col(outcome)
    return (
        F.col(mu1) - F.col(mu0) + (t / pc) * (y - F.col(mu1))
        - ((1 - t) / (1 - pc)) * (y - F.col(mu0))
    )


def doubly_robust_effect(df: DataFrame, treatment: str, outcome: str, p: str, mu1: str, mu0: str,
                         name: str = "aipw") -> DataFrame:
    return _valid(df, treatment, outcome).agg(
        F.avg(pseudo_outcome(treatment, outcome, p, mu1, mu0)).alias(name)
    )


# Cumulative Poisson(1) probabilities: a uniform number u gives the count of
# thresholds at or below it.  Fixed values.
POISSON_STEPS = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
    0.9999988747974149, 0.9999998885745217,
]
# steps and multipliers of the 32-bit mixing of resample weights; fixed values
GOLDEN, MIX_1, MIX_2 = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35
#: rows whose weights in all resamples are held at once
ROWS_AT_ONCE = 2048


def row_seed(key: str, seed: int) -> list[Column]:
    """Two 32-bit numbers, ``_lo`` and ``_hi``, from a hash of the seed and the key."""
    text = F.sha2(F.concat_ws(":", F.lit("boot"), F.lit(str(seed)), F.col(key).cast("string")), 256)
    return [F.conv(F.substring(text, at, 8), 16, 10).cast("long").alias(name) for name, at in (("_lo", 1), ("_hi", 9))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(MIX_1)
    x ^= x >> np.uint32(13)
    x *= np.uint32(MIX_2)
    x ^= x >> np.uint32(16)
    return x


def poisson_weights(lo: np.ndarray, hi: np.ndarray, runs: int) -> np.ndarray:
    """Weights of the rows (columns) in the resamples (rows); a first row of ones is the sample itself.

    A weight depends on the row's seed and the resample alone, so a lost task
    draws the same ones again.
    """
    marks = np.array([math.ceil(s * 2**32) for s in POISSON_STEPS], np.uint32)
    out = np.ones((runs + 1, len(lo)))
    with np.errstate(over="ignore"):
        for b in range(runs):
            u = _mixed(_mixed(lo.astype(np.uint32) + np.uint32(b * GOLDEN & 0xFFFFFFFF)) ^ hi.astype(np.uint32))
            out[b + 1] = np.searchsorted(marks, u, side="right")
    return out


def resampled_sums(df: DataFrame, key: str, values: Sequence[Column], expand, width: int, runs: int, seed: int) -> DataFrame:
    """``draw`` and ``s0 .. s{width - 1}``: weighted sums of ``expand(values)`` in each resample; draw -1 is the sample.

    A task multiplies its weights with its rows in blocks and sends one row a
    resample, however many rows it has.
    """
    rows = df.select(*row_seed(key, seed), *[v.cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    names = [f"s{i}" for i in range(width)]

    def run(batches):
        total = np.zeros((runs + 1, width))
        for batch in batches:
            lo, hi, *cells = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = slice(at, at + ROWS_AT_ONCE)
                total += poisson_weights(lo[some], hi[some], runs) @ expand(*[c[some] for c in cells])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, runs)), *[pa.array(c) for c in total.T]], ["draw", *names])

    parts = rows.mapInArrow(run, "draw long, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("draw").agg(*[F.sum(n).alias(n) for n in names])


def bootstrap_draws(df: DataFrame, key: str, psi: str, runs: int, seed: int) -> DataFrame:
    """``draw, estimate``: the weighted mean of ``psi`` in each resample; draw -1 is the sample."""
    rows = df.filter(F.col(psi).isNotNull())
    sums = resampled_sums(rows, key, [F.col(psi)], lambda v: np.stack([np.ones(len(v)), v], 1), 2, runs, seed)
    return sums.select("draw", (F.col("s1") / F.nullif(F.col("s0"), F.lit(0.0))).alias("estimate"))


def refitted_draws(df: DataFrame, key: str, treatment: str, outcome: str, p: str, confounders: Sequence[str], runs: int = 500, seed: int = 42) -> DataFrame:
    """``draw, estimate``: the doubly robust effect with an outcome model fitted anew in each resample.

    The model is linear in the confounders (medians of the sample for missing values) and the
    treatment.  Its cross products and those of the inverse propensities are sums
    over rows, so one pass has all that the fits and the estimates of all resamples need.
    Resamples without a unique fit take the one with the smallest coefficients.
    Rows without treatment, outcome or propensity are left out.
    """
    rows = _valid(df, treatment, outcome).filter(F.col(p).isNotNull())
    k = len(confounders)
    fill = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), F.lit(0.5), F.lit(100_000)).alias(f"m{i}") for i, c in enumerate(confounders)]).first() if k else []
    centre = [float(m or 0.0) for m in fill]
    features = [F.coalesce(F.col(c).cast("double") - F.lit(m), F.lit(0.0)) for c, m in zip(confounders, centre)]
    upper = np.triu_indices(k + 2)
    width = len(upper[0]) + 3 * (k + 2) + 2

    def expand(y, t, q, *x):
        z = np.stack([np.ones(len(y)), *x, t], 1)
        bare = z.copy()
        bare[:, -1] = 0.0
        on, off = t / q, (1 - t) / (1 - q)
        return np.concatenate([z[:, upper[0]] * z[:, upper[1]], z * y[:, None], z * on[:, None], bare * off[:, None], (on * y)[:, None], (off * y)[:, None]], 1)

    values = [F.col(outcome), F.col(treatment).cast("int"), clipped(p), *features]
    sums = resampled_sums(rows, key, values, expand, width, runs, seed)

    def solve(batches):
        for batch in batches:
            estimates = []
            for row in np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(width)], 1) if batch.num_rows else []:
                n, m = row[0], k + 2
                gram = np.zeros((m, m))
                gram[upper] = row[:len(upper[0])]
                gram = gram + np.triu(gram, 1).T
                target, on, off = row[len(upper[0]):-2].reshape(3, m)
                if not n:
                    estimates.append(None)
                    continue
                beta = np.linalg.lstsq(gram, target, rcond=None)[0]
                estimates.append(float(beta[-1] + (row[-2] - on @ beta - row[-1] + off @ beta) / n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(estimates, pa.float64())], ["draw", "estimate"])

    return sums.mapInArrow(solve, "draw long, estimate double")


def percentile_interval(draws: DataFrame) -> DataFrame:
    """The sample's estimate and the middle 95 % of the resamples', as ``effect, ci_lower, ci_upper``."""
    drawn = F.when(F.col("draw") >= 0, F.col("estimate"))
    return draws.agg(
        F.max(F.when(F.col("draw") < 0, F.col("estimate"))).alias("effect"),
        F.percentile(drawn, F.lit(0.025)).alias("ci_lower"), F.percentile(drawn, F.lit(0.975)).alias("ci_upper"),
    )


def bootstrap_interval(df: DataFrame, key: str, treatment: str, outcome: str, p: str, confounders: Sequence[str], runs: int = 500, seed: int = 42) -> DataFrame:
    """Doubly robust effect and percentile interval; the outcome model is refitted in every resample."""
    return percentile_interval(refitted_draws(df, key, treatment, outcome, p, confounders, runs, seed))


def fixed_model_interval(df: DataFrame, key: str, treatment: str, outcome: str, p: str, mu1: str, mu0: str, runs: int = 500, seed: int = 42) -> DataFrame:
    """The same with predictions that stay as they are."""
    rows = _valid(df, treatment, outcome).select(key, pseudo_outcome(treatment, outcome, p, mu1, mu0).alias("_psi"))
    return percentile_interval(bootstrap_draws(rows, key, "_psi", runs, seed))


def effect_row(df: DataFrame, key: str, treatment: str, outcome: str, p: str, confounders: Sequence[str],
               expected: str, runs: int = 500, seed: int = 42) -> DataFrame:
    """Arm sizes, naive and doubly robust effect, interval and verdict of a pair.

    One aggregation has all but the refitted effects, a second pass those.
    """
    t, low, high = _treated(treatment), *fixed.OVERLAP_RANGE
    y = F.when(F.col(treatment).isNotNull(), F.col(outcome))
    arms = df.agg(
        F.sum((t == 1).cast("long")).alias("n_treated"), F.sum((t == 0).cast("long")).alias("n_control"),
        F.avg(((F.col(p) < low) | (F.col(p) > high)).cast("double")).alias("share_outside"),
        (F.avg(F.when(t == 1, y)) - F.avg(F.when(t == 0, y))).alias("naive"),
    )
    robust = bootstrap_interval(df, key, treatment, outcome, p, confounders, runs, seed)
    out = arms.withColumn("_pair", F.lit(0)).join(robust.withColumn("_pair", F.lit(0)), "_pair").drop("_pair").select(
        F.lit(treatment).alias("treatment"), F.lit(outcome).alias("outcome"), "*", F.lit(expected).alias("expected"))
    return out.withColumn("verdict", verdict("effect", "expected"))


def effect_table(rows: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)
