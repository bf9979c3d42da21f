"""All queries of the catalog engine, and their SQL."""

from __future__ import annotations

from factloom.plans import analytics_queries, chain_queries, fact_queries, page_queries, record_queries, review_queries, schema_queries  # noqa: F401
from factloom.plans.register import ORACLES, QUERIES  # noqa: F401
