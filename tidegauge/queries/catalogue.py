"""Imports every module of queries, which registers them."""

from . import extended, live, relational, research, windows  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
