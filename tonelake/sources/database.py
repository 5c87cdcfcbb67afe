"""Rows of a relational database: reads split by a key with pushed filters, and batched writes.

The parts of a read cover every row once: the first is open below and holds the rows without a key, the last is open
above, so rows that come while the bounds are looked up are read too.  Bounds cut the key's range evenly; a key that is
not spread evenly gives parts of unlike size, so take a running number.  Filters and columns of a query reach each
part's statement.

A task's rows are written in batches as one transaction.  A task that is lost after its commit is run again, so rows go
to a staging table that this run creates, and the target gets by one statement those whose key it lacks.

Spark's writer sends a null text as a CLOB, which Derby refuses in a VARCHAR column: there null texts fail, other nulls
don't.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tonelake.sources import sinks


def ranges(key: str, least: int | None, most: int | None, parts: int) -> list[str]:
    """Predicates that cover all rows, those with a null key included, each row by exactly one."""
    if parts < 2 or least is None or most is None or most <= least:
        return ["1 = 1"]
    parts = min(parts, most - least + 1)
    cuts = [least + (most - least + 1) * k // parts for k in range(1, parts)]
    return [f"{key} < {cuts[0]} OR {key} IS NULL", *[f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:])], f"{key} >= {cuts[-1]}"]


def read(spark: SparkSession, url: str, table: str, key: str, parts: int = 8, properties: dict[str, str] | None = None) -> DataFrame:
    """A table in up to `parts` parts by a whole-number key (as the database quotes it)."""
    held = spark.read.jdbc(url, f"(SELECT min({key}) AS a, max({key}) AS b FROM {table}) bounds", properties=properties).first()
    return spark.read.jdbc(url, table, predicates=ranges(key, held[0], held[1], parts), properties=properties)


def append(df: DataFrame, url: str, table: str, batch: int = 1000, connections: int = 8, types: str | None = None, properties: dict[str, str] | None = None) -> None:
    """Add rows, over at most `connections` connections at a time; creates the table where it isn't there."""
    out = df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, numPartitions=connections, **(properties or {})).mode("append")
    (out.option("createTableColumnTypes", types) if types else out).save()


def insert_missing(df: DataFrame, url: str, table: str, keys: list[str], types: str | None = None, **how) -> None:
    """Add the rows whose key the table lacks, one of each key; running it again changes nothing.  Null keys are left out."""
    spark = df.sparkSession
    rows = df.dropna(subset=keys).dropDuplicates(keys)
    staging = f"staging_{uuid.uuid4().hex[:16]}"
    append(rows.limit(0), url, table, types=types, **how)
    append(rows, url, staging, types=types, **how)
    names = ", ".join(f'"{c}"' for c in df.columns)
    one = ", ".join(f'min("{c}")' if c not in keys else f'"{c}"' for c in df.columns)  # a task that ran twice left equal rows
    same = " AND ".join(f't."{k}" = s."{k}"' for k in keys)
    by = ", ".join(f'"{k}"' for k in keys)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        statement = connection.createStatement()
        statement.executeUpdate(f'INSERT INTO {table} ({names}) SELECT {one} FROM {staging} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {same}) GROUP BY {by}')
        statement.executeUpdate(f"DROP TABLE {staging}")
    finally:
        connection.close()


def reachable(spark: SparkSession) -> bool:
    """Whether `own_url` has a database for this session: a named one, or one in memory where there is one process."""
    return bool(spark.conf.get("spark.tonelake.jdbc.url", None)) or spark.sparkContext.master.startswith("local[")


def with_missing(df: DataFrame, held: DataFrame | None, keys: list[str]) -> DataFrame:
    """`insert_missing` for a cluster that has no database: held with the rows whose key it lacks, one of each key, as
    Parquet in the folder that all machines share.  Null keys are left out."""
    rows = df.dropna(subset=keys)
    rows = rows.dropDuplicates(keys) if held is None else sinks.insert_if_absent(held.hint("merge"), rows, keys)  # keys of many rows are not sent through the driver
    path = sinks.scratch(df.sparkSession, "rows")
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def own_url(spark: SparkSession) -> str:
    """The database that the session names (spark.tonelake.jdbc.url), or one in memory, which only one process can share."""
    url = spark.conf.get("spark.tonelake.jdbc.url", None)
    if url:
        return url
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.tonelake.jdbc.url to a database that all machines reach")
    return f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"
