"""The registered queries and the SQL they are checked against."""

from shelfmark.plans import (  # noqa: F401
    describe_queries,
    export_queries,
    job_queries,
    observe_queries,
    scope_queries,
    store_queries,
    stream_queries,
)
from shelfmark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
