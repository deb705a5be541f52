"""All registered queries of the engine."""

from tessera.plans import code, graphs, retrieval, rollups, texts  # noqa: F401  (importing registers)
from tessera.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
