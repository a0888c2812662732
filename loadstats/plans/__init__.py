"""Registered queries (one per operator of the survey inventory) and their oracles."""

from . import catalog_a, catalog_b, catalog_wide  # noqa: F401  (each registers its queries)
from .registry import ORACLES, QUERIES

FLAGSHIP = "A15_anomaly_rate_by_city" if "A15_anomaly_rate_by_city" in QUERIES else next(iter(QUERIES))

__all__ = ["QUERIES", "ORACLES", "FLAGSHIP"]
