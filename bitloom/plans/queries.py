"""All demo queries of the library and their SQL oracles."""

from __future__ import annotations

from bitloom.plans import agg_queries, bit_queries, decode_queries, graph_queries, interval_queries, layout_queries, match_queries, quality_queries, ref_queries, run_queries, runner_queries, source_queries, stream_queries, text_queries  # noqa: F401
from bitloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
