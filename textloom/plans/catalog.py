"""Every registered query of the library with its SQL twin for DuckDB."""

from . import (  # noqa: F401  importing registers
    answer_queries,
    cache_queries,
    chunk_queries,
    evaluation_queries,
    ingest_queries,
    lexical_queries,
    page_queries,
    reliability_queries,
    rule_queries,
    structured_queries,
    vector_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
