"""Every query by its key, and the SQL that checks it."""

from __future__ import annotations

from newsdesk.plans import flow_queries, handler_queries, packet_queries, portal_queries, snapshot_queries, text_queries  # noqa: F401  they register themselves
from newsdesk.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
