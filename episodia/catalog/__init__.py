"""Queries that run every operator on the star-schema tables."""

from importlib import import_module

MODULES = ["panel", "daily_flow", "icu_flow", "episodes", "binning", "fills", "transitions", "summaries", "metrics_queries", "effect_queries",
           "policy_queries", "graph_queries", "sampling_queries", "source_queries", "model_queries", "given_models"]


def load_queries():
    from episodia.catalog.registry import QUERIES

    for m in MODULES:
        import_module(f"episodia.catalog.{m}")
    return QUERIES
