"""All registered queries and their SQL counterparts."""

from armwatch.checks import (  # noqa: F401
    collection, dashboard, enrolment, intervals, power, preparation, profile, safety, volume)
from armwatch.checks.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
