"""Queries over the given tables, one or more per inventory entry, with their SQL."""

from battery import (  # noqa: F401 - each module registers its queries
    q_aggregates, q_binning, q_encode, q_functions, q_generator, q_joins, q_metrics, q_models, q_prepare,
    q_profile, q_projections, q_sources, q_windows,
)
from battery.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
