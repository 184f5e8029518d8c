"""All registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from lodegraph.plans import graph_queries, risk_queries, source_queries, store_queries, text_queries  # noqa: F401  (registers their queries)
from lodegraph.plans.register import ORACLES, QUERIES  # noqa: F401
