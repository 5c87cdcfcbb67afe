"""Writers: append, replacing the slices that a batch touches, and merges written as joins.

There is no table format with MERGE here, so a change to a partitioned table is a dynamic partition overwrite, which
a second run of the same input repeats without effect.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, *partitions: str, rows_per_file: int = 5_000_000) -> None:
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy(*partitions).parquet(path)


def overwrite_slices(df: DataFrame, path: str, *partitions: str, sort: tuple[str, ...] = (), rows_per_file: int = 5_000_000) -> None:
    """Replace exactly the partitions that df has rows of.  Rows are dealt by partition; AQE splits the large ones."""
    out = df.hint("rebalance", *partitions) if partitions else df
    out = out.sortWithinPartitions(*partitions, *sort) if sort else out
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
     .partitionBy(*partitions).parquet(path))


def slices(spark: SparkSession, path: str) -> dict[str, str]:
    """The partition folders right below a table's path, by their value."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return {n.split("=", 1)[1]: f"{path}/{n}" for n in names if "=" in n}


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below the checkpoint folder; it goes when the application ends.

    Only where the session names no such folder and runs in one process (tests) a temporary one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="tonelake-")
    path = f"{base.rstrip('/')}/tonelake-{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target and those rows whose key it lacks; of rows with equal keys one is taken."""
    return target.unionByName(rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], keep_old_if_null: bool = True) -> DataFrame:
    """Rows replace those of equal key column by column; nulls leave the old value where asked."""
    t, s = target.alias("t"), rows.withColumn("__new", F.lit(True)).alias("s")
    joined = t.join(s, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "full")
    out = []
    for c in target.columns:
        old, new = F.col(f"t.{c}"), F.col(f"s.{c}") if c in rows.columns else F.lit(None)
        out.append((F.coalesce(new, old) if keep_old_if_null or c in keys else F.when(F.col("s.__new"), new).otherwise(old)).alias(c))
    return joined.select(*out)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """What stays after a delete; rows for which the condition is unknown stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def zipped(spark, **arrays: list) -> DataFrame:
    """Parallel lists as a table, one column each."""
    names = list(arrays)
    lists = [F.array(*map(F.lit, arrays[n])).alias(n) for n in names]
    return spark.range(1).select(F.explode(F.arrays_zip(*lists)).alias("z")).select(*[F.col("z")[n].alias(n) for n in names])
