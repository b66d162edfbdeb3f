"""All registered queries; importing the modules registers them."""

from tallyline.catalog import checks, compare, files, runs, scans, steps, streams  # noqa: F401
from tallyline.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
