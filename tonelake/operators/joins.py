"""Join shapes of the queries, as functions of their inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_on(left: DataFrame, right: DataFrame, keys: list[str], right_only: Column) -> DataFrame:
    """A left join with a further condition on the right side in its ON clause: left rows without a match stay."""
    return left.join(right.filter(right_only), keys, "left")


def full_zero(a: DataFrame, b: DataFrame, keys: list[str], *measures: str) -> DataFrame:
    """Both sides' rows by key, missing measures as zero."""
    return a.join(b, keys, "full").withColumns({m: F.coalesce(m, F.lit(0)) for m in measures})


def hydrate(df: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """Fill a null or blank column from a lookup table of one row per key."""
    found = lookup.select(key, F.col(column).alias("__found"))
    return df.join(found, key, "left").withColumn(column, F.coalesce(F.nullif(F.trim(column), F.lit("")), F.nullif(F.trim("__found"), F.lit("")))).drop("__found")


def or_one_row(df: DataFrame) -> DataFrame:
    """df, or a single row of nulls where it has none."""
    return df.sparkSession.range(1).select().join(df, F.lit(True), "left")


def nearest_within(points: DataFrame, targets: DataFrame, group: str, at: str, target_at: str, window: int, *order: str) -> DataFrame:
    """For each point that has one the nearest target of its group at most `window` away; ties by the given columns.

    Points that are equal in all columns are one row with a count until the end, and each gets its row.  Both sides are dealt to cells of the window's width and a point meets the targets of its own and the two
    neighbouring cells, so the join has equal keys and never compares a whole group."""
    each = points.groupBy(*points.columns).agg(F.count("*").alias("__copies"))
    p = each.withColumn("__cell", F.explode(F.array(*[F.floor(F.col(at) / window) + d for d in (-1, 0, 1)])))
    t = targets.withColumn("__cell", F.floor(F.col(target_at) / window))
    distance = F.abs(F.col(at) - F.col(target_at))
    joined = p.join(t, [group, "__cell"]).filter(distance <= window)
    rest = [c for c in targets.columns if c != group]
    nearest = joined.groupBy(*each.columns).agg(F.min_by(F.struct(distance.alias("distance"), *rest), F.struct(distance, *order)).alias("n"))
    return nearest.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*points.columns, "n.*")


def overlapping(spans: Column, start: Column, end: Column) -> Column:
    """Whether any span of an array of (start, end) overlaps the half-open range."""
    return F.exists(spans, lambda z: (end > z["start"]) & (start < z["end"]))
