"""Registered queries and their SQL counterparts over the driver's tables."""

from levyscope.registry import operators, pipelines  # noqa: F401  (they fill ENTRIES)
from levyscope.registry.entries import ENTRIES

__all__ = ["ENTRIES"]
