"""One query per operator over the test tables, with the SQL it is checked against."""

from gleaner.catalog import ranking_queries, record_queries, relation_queries, vector_queries  # noqa: F401
from gleaner.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
