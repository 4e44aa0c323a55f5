"""Treatment-effect study: fit on train, estimate on the other rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from episodia.operators.effects import balance_tables, effect_row, effect_table
from episodia.operators.models import fit_propensities, score_propensities


def estimate_effects(train: DataFrame, test: DataFrame, key: str, pairs: Sequence[tuple[str, str, str]],
                     confounders: Sequence[str], runs: int = 500, seed: int = 42, prefix: str = "next_") -> DataFrame:
    """One row per (treatment, outcome, expected direction).

    Propensity models are fitted once per treatment on ``train``; the outcome
    model of each pair is fitted on ``test`` and again in each of its resamples.
    """
    models = fit_propensities(train, sorted({t for t, _, _ in pairs}), confounders)
    scored = score_propensities(test, models)
    rows = []
    for treatment, outcome, expected in pairs:
        others = [c for c in confounders if c != treatment]
        rows.append(effect_row(scored, key, treatment, f"{prefix}{outcome}", f"p_{treatment}", others, expected, runs, seed))
    return effect_table(rows)


def balance_study(train: DataFrame, test: DataFrame, treatments: Sequence[str], confounders: Sequence[str]) -> DataFrame:
    """Raw and weighted balance of every confounder for every treatment."""
    models = fit_propensities(train, treatments, confounders)
    scored = score_propensities(test, models)
    return balance_tables(scored, {t: f"p_{t}" for t in treatments}, confounders)
