"""The registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarsift.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(configure(spark), folder)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def flat(values: Column, sort: bool = True) -> Column:
    """An array of strings as one string, so that results compare across engines."""
    return F.array_join(F.array_sort(values) if sort else values, "|")


def stamp(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return ", ".join(sql_text(v) for v in values)
