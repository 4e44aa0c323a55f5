"""Replay table: panel rows to states, actions, rewards and next states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodia.functions import fixed_values as fixed
from episodia.functions.scalars import clip, dose_flag, encode_bits, step_reward, zscore
from episodia.operators.aggregates import train_scaler, with_single_row
from episodia.operators.sampling import ordinal_split
from episodia.operators.sequences import next_state


def replay_table(
    panel: DataFrame, entity: str = "icustayid", step: str = "bloc",
    dynamic: Mapping[str, tuple] = fixed.REPLAY_DYNAMIC, static: Mapping[str, tuple] = fixed.REPLAY_STATIC,
    logged: Sequence[str] = fixed.REPLAY_LOG, actions: Sequence[str] = fixed.REPLAY_ACTIONS,
    sources: Mapping[str, str] | None = None, severity: str = "sofa", bad_end: str = "readmit_30d",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Ordinal split, train-only scaling, action id, reward and next state.

    Dynamic next states are 0 on the last row; static ones are carried over.
    The first action is the lowest bit of ``a``.
    """
    bounds = {**dynamic, **static}
    names = sources or {a: a for a in actions}
    rows = ordinal_split(panel, entity, fixed.SPLIT_SHARES)
    prepared = {f"_c_{c}": clip(F.col(c).cast("double"), *b) for c, b in bounds.items()}
    prepared = {k: F.log1p(v) if k[3:] in logged else v for k, v in prepared.items()}
    rows = rows.withColumns({
        **prepared, **{a: dose_flag(names[a]) if names[a] in panel.columns else F.lit(0) for a in actions},
    })
    scaler = train_scaler(rows, list(prepared))
    rows = with_single_row(rows, scaler).withColumns({
        **{f"s_{c}": zscore(f"_c_{c}", f"_c_{c}_mean", f"_c_{c}_std") for c in bounds}, "a": encode_bits(actions),
    }).drop(*prepared, *scaler.columns)
    moved = next_state(rows, [entity], [step], [*[f"s_{c}" for c in dynamic], severity], prefix="_n_")
    return moved.select(
        entity, step, *keep, "split", bad_end, "done", *[f"s_{c}" for c in bounds], "a", *actions,
        step_reward("done", severity, f"_n_{severity}", bad_end).alias("r"),
        *[F.coalesce(f"_n_s_{c}", F.lit(0.0)).alias(f"s_next_{c}") for c in dynamic],
        *[F.col(f"s_{c}").alias(f"s_next_{c}") for c in static],
    )
