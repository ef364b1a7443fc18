"""The registered queries and, where SQL can say it, the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def register(name: str, covers: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query under ``name``; ``covers`` lists the inventory items it exercises."""

    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = build
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add
