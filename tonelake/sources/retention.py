"""Retention to a byte budget: the newest files whose sizes add up to no more than it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OLDEST = 2**63 - 1


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime and length of all files below a folder; their contents aren't read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
            .withColumn("tie", F.xxhash64("path")))


def _below(bounds: list[int], x: Column) -> Column:
    """How many of the sorted bounds are less than x, by a tree of comparisons, log2 of them a row and compiled."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.lit(bounds[mid]).cast("long") < x, tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(bounds))


def running_bytes(files: DataFrame, at: str, tie: str, size: str, cells: int = 64) -> DataFrame:
    """files with `running`, the bytes of all files that are as new or newer, by time and then by the number `tie`.

    Rows are dealt to cells of the order, whose totals are known before the rows are summed up within each cell, so no task
    sees more than a cell.  A time that many files share is a cell of its own and is cut further by `tie`.  At most
    2 * cells bounds, and as many for each such time, come to the driver.  A null time is the oldest, a null size no bytes;
    rows of equal time and tie count as one step, so each of them has the total of all."""
    spark, names = files.sparkSession, files.columns
    points = [k / cells for k in range(1, cells)]
    f = files.withColumns({"__a": F.coalesce(-F.unix_micros(F.col(at).cast("timestamp")), F.lit(OLDEST)), "__t": F.coalesce(F.col(tie).cast("long"), F.lit(-OLDEST)),
                           "__n": F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))})
    bounds = sorted(set(f.agg(F.percentile_approx("__a", points)).first()[0] or []))
    below = lambda b, x: F.size(F.filter(b, lambda y: y < x))
    f = f.withColumn("__cell", 2 * _below(bounds, F.col("__a")) + F.col("__a").isin(bounds).cast("int"))
    own = f.filter("__cell % 2 = 1").groupBy("__cell").agg(F.percentile_approx("__t", points).alias("__b")).collect()
    ties = spark.createDataFrame([(r["__cell"], sorted(set(r["__b"]))) for r in own], "__cell int, __b array<bigint>")
    f = f.join(F.broadcast(ties), "__cell", "left").withColumn("__sub", F.coalesce(below(F.col("__b"), F.col("__t")), F.lit(0))).drop("__b")
    totals = f.groupBy("__cell", "__sub").agg(F.sum("__n").alias("__s"))
    whole = totals.groupBy("__cell").agg(F.sum("__s").alias("__w"))
    earlier = whole.select(F.col("__cell").alias("__c"), F.col("__w").alias("__e"))
    before = whole.join(F.broadcast(earlier), F.col("__c") < F.col("__cell"), "left").groupBy("__cell").agg(F.coalesce(F.sum("__e"), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__s").over(Window.partitionBy("__cell").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.withColumn("__inside", inside).join(F.broadcast(before), "__cell").select("__cell", "__sub", (F.col("__inside") + F.col("__before")).alias("__offset"))
    placed = f.join(F.broadcast(offsets), ["__cell", "__sub"])
    within = F.sum("__n").over(Window.partitionBy("__cell", "__sub").orderBy("__a", "__t"))
    return placed.select(*names, (F.col("__offset") + within).alias("running"))


def over_budget(files: DataFrame, at: str, tie: str, size: str, budget: int) -> DataFrame:
    """The files that have to go: all that don't fit into the budget when the newest are taken first."""
    return running_bytes(files, at, tie, size).filter(F.col("running") > budget).drop("running")
