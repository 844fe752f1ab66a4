"""Registered queries: a Spark plan and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.plans.fixtures import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(fixtures) -> DataFrame`` under a name, with its SQL if there is one."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Fixtures(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def stamp(column: str | Column) -> Column:
    """Times leave as text so that both engines print them alike."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def rounded(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def joined(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.array_join(value.cast("array<string>"), "|")
