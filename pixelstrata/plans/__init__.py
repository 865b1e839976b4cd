"""Registered queries over the given tables."""

from pixelstrata.plans.registry import ORACLES, QUERIES
from pixelstrata.plans import (  # noqa: F401
    queries_temporal, queries_pixels, queries_pairs, queries_spatial, queries_inference, queries_joins, queries_curation, queries_streaming,
)

__all__ = ["ORACLES", "QUERIES"]
