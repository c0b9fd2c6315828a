"""All registered queries."""

from lodestone.plans import chunk_queries, classify_queries, evaluation_queries, job_queries, layout_queries, retrieval_queries, section_queries, session_queries, sink_queries, stream_queries, text_queries, web_queries  # noqa: F401
from lodestone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
