"""All queries by name and the SQL that checks them."""

from __future__ import annotations

from krysalis.plans import analytics, linear, tables  # noqa: F401  they register their queries
from krysalis.plans.fixtures import ORACLES, QUERIES
from krysalis.plans.linear import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
