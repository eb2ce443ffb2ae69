"""All named queries."""

from __future__ import annotations

from keepsake.plans import (  # noqa: F401
    history_queries,
    report_queries,
    scan_queries,
    seal_queries,
    source_queries,
    stream_queries,
)
from keepsake.plans.registry import all_queries, all_sql  # noqa: F401
