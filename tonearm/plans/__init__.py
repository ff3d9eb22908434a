"""Registered queries of the catalogue operators."""

from . import albums, discs, identify, libraries, lookups, releases, sound, sources, strings, tagging  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
