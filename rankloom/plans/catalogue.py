"""All queries of the engine proper, by name, with their SQL twins."""

from __future__ import annotations

from . import base, comparison, corpus, endtoend, inference, learned, rerank, storage, web  # noqa: F401  the modules register their queries


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
