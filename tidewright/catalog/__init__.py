"""Every query, by name, with its SQL where one exists."""

from tidewright.catalog import learning, series, statistics, tables  # noqa: F401
from tidewright.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
