"""SQL with named parameters over DataFrames, and results of a stated number of rows.

Values are bound, never pasted into the text, and tables are given as DataFrames by name, so a question is planned with
the filters of its parameters pushed into the scans like any other query.
"""

from __future__ import annotations

from dataclasses import fields, is_dataclass
from typing import Any, TypeVar

from pyspark.sql import DataFrame, Row, SparkSession

T = TypeVar("T")


class WrongCount(ValueError):
    """A result of more or fewer rows or columns than asked for."""


def many(spark: SparkSession, sql: str, params: dict[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """The rows of a statement with :name parameters over {name} tables; stays a DataFrame."""
    return spark.sql(sql, args=params or None, **tables)


def maybe(df: DataFrame) -> Row | None:
    """The only row, or None; more than one is an error.  At most two rows are fetched."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise WrongCount("more than one row")
    return rows[0] if rows else None


def one(df: DataFrame) -> Row:
    row = maybe(df)
    if row is None:
        raise WrongCount("no row")
    return row


def scalar(df: DataFrame) -> Any:
    """The value of the only column of the only row."""
    if len(df.columns) != 1:
        raise WrongCount(f"{len(df.columns)} columns")
    return one(df)[0]


def typed(df: DataFrame, kind: type[T], most: int = 10_000) -> list[T]:
    """The rows as objects of a dataclass, whose fields the columns must cover; more rows than `most` are an error."""
    if not is_dataclass(kind):
        raise TypeError("a dataclass is asked for")
    names = [f.name for f in fields(kind)]
    rows = df.select(*names).limit(most + 1).collect()
    if len(rows) > most:
        raise WrongCount(f"more than {most} rows")
    return [kind(**r.asDict(recursive=True)) for r in rows]
