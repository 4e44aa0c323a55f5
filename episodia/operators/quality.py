"""Checks, repairs and conformity of panels and transition tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodia.functions.scalars import finite_or_null, is_finite


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def forbid_columns(df: DataFrame, derived: Sequence[str]) -> DataFrame:
    """Guard against deriving the same columns twice."""
    present = sorted(set(derived) & set(df.columns))
    if present:
        raise ValueError(f"columns already present: {present}")
    return df


def coverage_report(df: DataFrame, expected: Sequence[str]) -> dict[str, list[str]]:
    """Which expected columns are absent and which are extra."""
    return {
        "absent": [c for c in expected if c not in df.columns],
        "extra": [c for c in df.columns if c not in expected],
    }


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast and order the columns; absent ones become typed nulls, extras go."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def bad_value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls and non-finite values per column, from one pass."""
    one = df.agg(
        *[F.sum(F.col(c).isNull().cast("long")).alias(f"n_{c}") for c in columns],
        *[F.sum((F.col(c).isNotNull() & ~is_finite(c)).cast("long")).alias(f"i_{c}") for c in columns],
    )
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("n_null"), F.col(f"i_{c}").alias("n_infinite"))
        for c in columns
    ])))


def require_finite(df: DataFrame, columns: Sequence[str], label: str = "table") -> DataFrame:
    """Raise if any value is null or not finite (one job)."""
    bad = bad_value_counts(df, columns).filter("n_null > 0 or n_infinite > 0").collect()
    if bad:
        listed = ", ".join(f"{r.column_name} ({r.n_null} null, {r.n_infinite} infinite)" for r in bad[:10])
        raise ValueError(f"{label} has bad values: {listed}")
    return df


def repaired(df: DataFrame, mean_fill: Sequence[str], zero_fill: Sequence[str], split: str = "split",
             train: str = "train") -> DataFrame:
    """Non-finite to the train mean, else the overall mean, else 0; flags to 0.

    The means come from one aggregation read as a scalar subquery.
    """
    value = {c: finite_or_null(F.col(c).cast("double")) for c in mean_fill}
    packed = df.agg(F.struct(*[
        F.coalesce(F.avg(F.when(F.col(split) == train, v)), F.avg(v), F.lit(0.0)).alias(c)
        for c, v in value.items()
    ]).alias("m"))
    out = df.withColumn("_m", packed.scalar())
    out = out.withColumns({c: F.coalesce(value[c], F.col(f"_m.{c}")) for c in mean_fill}).drop("_m")
    return out.withColumns({c: F.coalesce(finite_or_null(F.col(c)), F.lit(0)) for c in zero_fill})


def transition_checks(df: DataFrame, episode: str, step: str, done: str = "done", label: str | None = None) -> DataFrame:
    """Contract counts of a transition table; every count should be 0.

    Duplicate keys, episodes without exactly one final row, and final rows that
    are not the last step.
    """
    per_key = df.groupBy(episode, step).agg(F.count(F.lit(1)).alias("n"), F.max(done).alias("d"))
    per_episode = per_key.groupBy(episode).agg(
        F.sum(F.col("n") - 1).alias("dup"), F.sum("d").alias("done"), F.max_by("d", step).alias("last_done"),
    )
    one = per_episode.agg(
        F.sum("dup").alias("duplicate_keys"),
        F.sum((F.col("done") != 1).cast("long")).alias("episodes_without_one_end"),
        F.sum((F.col("last_done") != 1).cast("long")).alias("end_not_last"),
    )
    return one.unpivot([], one.columns, "check", "violations")


def with_provenance(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """Constant source, version, sample and build-time columns; time is passed in."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})
