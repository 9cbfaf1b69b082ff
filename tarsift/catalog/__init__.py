"""All registered queries."""

from tarsift.catalog import content, package_rules, reports, sources  # noqa: F401
from tarsift.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
