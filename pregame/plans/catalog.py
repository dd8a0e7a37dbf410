"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from importlib import import_module

from pregame.plans.registry import REGISTRY, Query

MODULES = [
    "feature_queries", "scan_queries", "projection_queries", "join_queries", "aggregate_queries", "scalar_queries",
    "rating_queries", "fixture_queries", "quality_queries", "recon_queries", "drift_queries", "stat_queries",
    "model_queries", "stream_queries",
]


def load() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"pregame.plans.{name}")
    return REGISTRY
