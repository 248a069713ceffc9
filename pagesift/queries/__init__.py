"""Registered queries over the driver's tables, and their SQL."""

from . import basic, reports  # noqa: F401
from .registry import ORACLES, QUERIES
from .reports import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
