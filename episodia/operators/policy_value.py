"""Off-policy evaluation over logged trajectories and policy comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodia.functions import fixed_values as fixed
from episodia.operators.aggregates import exact_quantiles

FAN = 1024


def discounted_returns(df: DataFrame, keys: list[str], step: str, reward: str,
                       gamma: float = fixed.DISCOUNT, name: str = "discounted_return") -> DataFrame:
    """``sum(gamma^t * r_t)`` per trajectory; a plain sum, combined map-side."""
    return df.groupBy(*keys).agg(
        F.sum(F.col(reward) * F.pow(F.lit(gamma), F.col(step))).alias(name)
    )


def return_summary(returns: DataFrame, value: str = "discounted_return") -> DataFrame:
    return returns.agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.count(F.lit(1)).alias("n_trajectories"),
    )


def backward_fold(df: DataFrame, keys: list[str], step: str, a: Column, b: Column,
                  name: str = "value") -> DataFrame:
    """First value of ``V_t = a_t + b_t * V_{t+1}`` with ``V = 0`` after the end.

    Such steps compose: a run of steps is again of the form ``A + B * V``.  Runs
    of up to 1024 steps are folded first, then runs of runs until one run is
    left, so no array holds more than 1024 elements however long a trajectory
    is.  ``step`` is the 0-based row index.
    """
    longest = (df.agg(F.max(F.col(step).cast("long"))).first()[0] or 0) + 1
    levels = 1
    while longest > FAN ** levels:
        levels += 1
    rows = df.select(*keys, F.col(step).cast("long").alias("_i"), a.cast("double").alias("_a"),
                     b.cast("double").alias("_b"))
    for _ in range(levels):
        here = F.struct("_i", "_a", "_b")
        run = F.floor(F.col("_i") / FAN).cast("long")
        start = F.struct(F.lit(0.0).alias("A"), F.lit(1.0).alias("B"))

        def join_step(acc, x):
            return F.when(x["_b"] == 0, F.struct(x["_a"].alias("A"), F.lit(0.0).alias("B"))).otherwise(
                F.struct((x["_a"] + x["_b"] * acc["A"]).alias("A"), (x["_b"] * acc["B"]).alias("B"))
            )

        rows = (
            rows.withColumn("_run", run)
            .groupBy(*keys, "_run")
            .agg(F.reverse(F.sort_array(F.collect_list(here))).alias("_s"))
            .withColumn("_f", F.aggregate("_s", start, join_step))
            .select(*keys, F.col("_run").alias("_i"), F.col("_f.A").alias("_a"), F.col("_f.B").alias("_b"))
        )
    return rows.select(*keys, F.col("_a").alias(name))


def doubly_robust_values(df: DataFrame, keys: list[str], step: str, logged: str, chosen: str, reward: str,
                         probability: str, q_value: str, reward_estimate: str,
                         gamma: float = fixed.DISCOUNT) -> DataFrame:
    """Sequential doubly robust value per trajectory.

    ``V <- r_hat + rho * (r + gamma * V - Q)`` from the last step back, with
    ``rho = 1 / pi(logged)`` where both policies agree and 0 elsewhere.
    """
    pi = F.greatest(F.col(probability), F.lit(fixed.MIN_PROBABILITY))
    rho = F.when(F.col(logged) == F.col(chosen), 1 / pi).otherwise(F.lit(0.0))
    a = F.col(reward_estimate) + rho * (F.col(reward) - F.col(q_value))
    return backward_fold(df, keys, step, a, rho * gamma)


def doubly_robust_summary(values: DataFrame, limit: float = fixed.VALUE_CLIP) -> DataFrame:
    """Mean and spread of the values within the limit, and both counts."""
    v = F.when(F.abs("value") <= limit, F.col("value"))
    return values.agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.count(F.lit(1)).alias("n_trajectories"), F.count(v).alias("n_valid"),
    )


def policy_summary(episodes: DataFrame, policy: str, value: str, rates: Sequence[str] = (),
                   rows_per_task: int | None = None) -> DataFrame:
    """Mean, spread and quartiles of the return, and mean rates, per policy."""
    base = episodes.groupBy(policy).agg(
        F.count(F.lit(1)).alias("episodes"), F.avg(value).alias("mean_return"),
        F.stddev_pop(value).alias("std_return"),
        *[F.avg(F.col(r).cast("double")).alias(f"mean_{r}") for r in rates],
    )
    q = exact_quantiles(episodes, [policy], value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, rows_per_task)
    return base.join(q, policy, "left")


def policy_pairwise(episodes: DataFrame, episode: str, policy: str, value: str, policies: Sequence[str]) -> DataFrame:
    """Mean difference, win rate and common episodes of every policy pair.

    One pivot with a given list of policies and one aggregation; no self join.
    """
    wide = episodes.groupBy(episode).agg(
        *[F.first(F.when(F.col(policy) == p, F.col(value)), ignorenulls=True).alias(f"_v{i}")
          for i, p in enumerate(policies)]
    )
    names = sorted(range(len(policies)), key=lambda i: policies[i])
    pairs = [(i, j) for k, i in enumerate(names) for j in names[k + 1:]]
    rows = wide.select(F.inline(F.array(*[
        F.struct(F.lit(policies[i]).alias("left_policy"), F.lit(policies[j]).alias("right_policy"),
                 (F.col(f"_v{i}") - F.col(f"_v{j}")).alias("diff"))
        for i, j in pairs
    ])))
    return rows.groupBy("left_policy", "right_policy").agg(
        F.coalesce(F.avg("diff"), F.lit(0.0)).alias("mean_diff"),
        F.coalesce(F.avg((F.col("diff") > 0).cast("double")), F.lit(0.0)).alias("win_rate"),
        F.count("diff").alias("n_common"),
    )


def strategy_comparison(df: DataFrame, policy: str, nothing: str, observed: str) -> DataFrame:
    """Mean risk under three strategies and the share where the policy is better."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(policy).alias("mean_policy"), F.avg(nothing).alias("mean_nothing"),
        F.avg(observed).alias("mean_observed"),
        F.avg((F.col(policy) < F.col(nothing)).cast("double")).alias("better_than_nothing"),
        F.avg((F.col(policy) < F.col(observed)).cast("double")).alias("better_than_observed"),
    )


def action_agreement(df: DataFrame, logged: str, chosen: str) -> DataFrame:
    return df.agg(
        (100.0 * F.avg((F.col(logged) == F.col(chosen)).cast("double"))).alias("agreement_percent"),
        F.countDistinct(chosen).alias("n_unique_actions"),
    )


def first_action_counts(df: DataFrame, keys: list[str], step: str, action: str) -> DataFrame:
    first = df.groupBy(*keys).agg(F.min_by(action, step).alias(action))
    return first.groupBy(action).agg(F.count(F.lit(1)).alias("n"))
