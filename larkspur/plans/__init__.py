"""The query catalogue."""

from larkspur.plans import more as more
from larkspur.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
