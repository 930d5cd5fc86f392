"""Register of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    sql: str | None
    covers: tuple[str, ...]


CATALOG: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a function under its own name. ``covers`` lists inventory ids."""

    def add(fn: QueryFn) -> QueryFn:
        if fn.__name__ in CATALOG:
            raise ValueError(f"query {fn.__name__} is registered twice")
        CATALOG[fn.__name__] = Query(fn.__name__, fn, sql, tuple(covers.split()))
        return fn

    return add


def load_all() -> dict[str, Query]:
    from locigrid.plans import (  # noqa: F401
        benchmarks,
        counting,
        files,
        learning,
        ordering,
        relational,
        replicates,
        sequence_jobs,
        texts,
    )

    return CATALOG
