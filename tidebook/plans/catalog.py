"""All registered queries."""

from tidebook.plans import (  # noqa: F401
    book_queries,
    lake_queries,
    risk_queries,
    stream_queries,
    ta_queries,
    written_queries,
)
from tidebook.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
