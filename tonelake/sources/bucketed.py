"""Raw tables laid out by utterance, so that the hourly build joins bucket by bucket without a shuffle.

Rows are written in hours or days (partitions) and, within each, in a fixed number of buckets by key, sorted.  Two tables
of equally many buckets meet without an exchange, and so does an aggregate by keys that hold the bucket's; filters on the
hour or day still prune folders.  Rewriting one replaces it and leaves the others.  Each hour and bucket is a file, so
where an hour holds little, days make fewer and larger files.

The number of buckets is the table's for good: choose it for an hour range that a run reads (a bucket of a range is one
task, so hours * bytes an hour / buckets should fit an executor).  A key must not hold many rows: an utterance has one
row and as many hits as its text has room for.  The tables' files lie where `path` says; the catalog holds their layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.plans.compact import hour_of

BUCKETS = 64


def store(df: DataFrame, table: str, key: str, path: str, buckets: int = BUCKETS, unit: str = "hour") -> None:
    """Replace in `table` the hours (or days, by `unit`) that df has rows of; creates it where it isn't there.  Rows
    without a time go to the default partition.  Another key, number of buckets or unit than the table's is an error."""
    spark = df.sparkSession
    hour = hour_of(F.col("created_at"))
    rows = df.withColumn(unit, {"hour": hour, "day": F.substring(hour, 1, 10)}[unit])
    # dealt as the buckets are, so that each bucket of an hour is one file
    rows = rows.repartition(buckets, key).sortWithinPartitions(unit, key)
    if not spark.catalog.tableExists(table):
        rows.write.partitionBy(unit).bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
        return
    if layout(spark, table) != (key, buckets, unit):
        raise ValueError(f"{table} is laid out by {layout(spark, table)}")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def layout(spark: SparkSession, table: str) -> tuple[str, int, str]:
    """The bucket column, the number of buckets and the unit of time of a table."""
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    return told["Bucket Columns"].strip("[]`"), int(told["Num Buckets"]), unit_of(spark, table)


def unit_of(spark: SparkSession, table: str) -> str:
    return next(c.name for c in spark.catalog.listColumns(table) if c.isPartition)


def read(spark: SparkSession, table: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """A table's rows, of the hours (yyyy-MM-dd-HH) or days (yyyy-MM-dd) from first to last, both included, where given."""
    df, unit = spark.table(table), unit_of(spark, table)
    if first is not None:
        df = df.filter(F.col(unit) >= first)
    if last is not None:
        df = df.filter(F.col(unit) <= last)
    return df.drop(unit)
