"""All registered queries of the library and their SQL."""

from __future__ import annotations

from textloom.plans import annotation, chunks, documents, frequency, lexical, models, retrieval, similarity, streams  # noqa: F401
from textloom.plans import further, glue, named, selection, structures  # noqa: F401  # after the others, which it refers to
from textloom.plans.registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
