"""Every query of the library outside the training-data operators, with its SQL."""

from __future__ import annotations

from lexispark.plans import check_queries, function_queries, guard_queries, lookup_queries, note_queries, registry, shelf_queries, source_queries, store_queries, text_queries, vector_queries  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
