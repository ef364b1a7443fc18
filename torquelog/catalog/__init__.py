"""Registered queries over the test tables."""

from __future__ import annotations

from torquelog.catalog import (  # noqa: F401
    classes,
    cleaning,
    described,
    keywords,
    learning,
    records,
)
from torquelog.catalog.registry import COVERS, ORACLES, QUERIES, Build


def queries() -> dict[str, Build]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def covers() -> dict[str, str]:
    return dict(COVERS)
