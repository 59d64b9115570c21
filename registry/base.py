"""Registration of queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.fixtures import derived, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(*inputs: str, sql: str | None = None, uses: tuple[str, ...] | None = None):
    """Register a function of the named input tables under its own name.

    sql is run over the same derived tables, which come as its WITH clause;
    `uses` names them where they differ from the inputs.
    """

    def register(fn):
        name = fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            frames = derived(spark, sf_dir, *inputs)
            return fn(*frames) if isinstance(frames, tuple) else fn(frames)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            head = with_clause(*(inputs if uses is None else uses))
            body = sql.strip()
            if head == "WITH ":
                ORACLE[name] = body
            elif body[:14].upper() == "WITH RECURSIVE":
                ORACLE[name] = "WITH RECURSIVE" + head[4:] + ",\n" + body[14:]
            elif body[:4].upper() == "WITH":
                ORACLE[name] = head + ",\n" + body[4:]
            else:
                ORACLE[name] = head + "\n" + body
        return fn

    return register


def rnd(column: str | Column, digits: int = 6) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c.cast("double"), digits)
    return out.alias(column) if isinstance(column, str) else out


def big(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = c.cast("long")
    return out.alias(column) if isinstance(column, str) else out


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")).alias(column)


def secs(column: str) -> Column:
    return F.unix_seconds(F.col(column).cast("timestamp")).alias(column)


def text(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("string").alias(column) if isinstance(column, str) else c.cast("string")
