"""Jobs that combine the operators, and the queries registered for them."""

from __future__ import annotations

from .registry import ORACLES, QUERIES


def _load() -> None:
    from . import evaluation, imaging, prompting, catalogue  # noqa: F401


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
