"""Operators of a training-data pipeline, and their queries."""

from tidewright.llm import queries  # noqa: F401
from tidewright.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
