"""The registered queries and their SQL twins, gathered from the query modules."""

from __future__ import annotations

from facetmill.plans import catalog_queries, evaluation_queries, file_queries, job_queries, retrieval_queries, review_queries

MODULES = (catalog_queries, review_queries, evaluation_queries, retrieval_queries, file_queries, job_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
