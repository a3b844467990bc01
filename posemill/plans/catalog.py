"""All queries of the library by name, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from posemill.plans import series, tables  # noqa: F401  they register their queries
from posemill.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
