"""Queries over the order tables."""

from . import basics, domain, spatial_models
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "basics", "domain", "spatial_models"]
