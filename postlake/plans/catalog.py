"""All registered queries."""

from postlake.plans import (  # noqa: F401
    flow_queries,
    merge_queries,
    page_queries,
    payload_queries,
    signal_queries,
    text_queries,
    url_queries,
)
from postlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
