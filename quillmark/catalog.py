"""All queries of the engine with their SQL twins."""

from __future__ import annotations

from quillmark.plans import ORACLES, QUERIES, content, grids, layout, matching, review, scoring  # noqa: F401  the modules register their queries


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
