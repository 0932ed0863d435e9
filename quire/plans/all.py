"""All registered queries."""

from quire.plans import audit_queries, catalog_queries, merge_queries, page_queries, queries, reading_queries, reply_queries, report_queries, search_queries, stream_queries, text_queries, validation_queries
from quire.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audit_queries", "catalog_queries", "merge_queries", "page_queries", "queries", "reading_queries", "reply_queries", "report_queries", "search_queries", "stream_queries", "text_queries", "validation_queries"]
