"""One-step policy search over all drug combinations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodia.operators.forests import Forest
from episodia.operators.models import LinearScore, TreeScore, exhaustive_policy


def score_policies(rows: DataFrame, keys: list[str], drugs: Sequence[str],
                   next_state: Mapping[str, LinearScore | TreeScore | Forest], risk: LinearScore | TreeScore | Forest,
                   effects: Mapping[tuple[str, str], float], actions: Sequence[str] | None = None) -> DataFrame:
    """Lowest-risk combination per row, with doing nothing and the observed drugs.

    The next state without any drug is predicted once per row; the effects of
    active drugs are then added and the risk of the corrected state is scored.
    """
    none = {a: F.lit(0.0) for a in (actions or drugs)}
    out = rows
    for c, m in next_state.items():
        out = m.score(out, f"_base_{c}", none)

    return exhaustive_policy(out, keys, drugs, effects, {c: f"_base_{c}" for c in next_state}, risk)
