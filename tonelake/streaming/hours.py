"""The hourly pipeline as a stream over archive files.

Each micro-batch handles the files that are new since the last: lines become utterances, the stored utterances hits, and
the facts and states of the touched hours are made anew from all that is stored of these hours, so a batch that is run
again after a failure leaves the same tables.  A ledger row per batch says what it held.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators.detector import hits
from tonelake.operators.extract import utterances
from tonelake.plans import compact
from tonelake.plans.compact import hour_of
from tonelake.sources.archive import envelopes, parsed
from tonelake.sources.rulepack import Pack
from tonelake.sources.sinks import append


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int = 24) -> DataFrame:
    """New archive files as they come; the file's name is kept for the ledger."""
    return (spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(folder)
            .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")))


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, pack: Pack, detver: int = 1, files_per_batch: int = 24):
    """Handle all files that are there and end; a later start goes on from the checkpoint."""
    def store(df: DataFrame, name: str, batch_id: int, *partitions: str) -> None:
        df = df.withColumn("batch", F.lit(batch_id))
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions, "batch").parquet(f"{out}/{name}")

    def batch(df: DataFrame, batch_id: int) -> None:
        u = utterances(envelopes(parsed(df, "skip")), batch_id)
        store(u.withColumn("hour", hour_of(F.col("created_at"))), "utterances", batch_id, "hour")
        every = spark.read.parquet(f"{out}/utterances")
        own = every.filter(F.col("batch") == batch_id)
        touched = sorted(r.hour for r in own.select("hour").distinct().collect())
        if touched:
            found = hits(own, pack, detver)
            store(found.withColumn("hour", hour_of(F.col("created_at"))), "hits", batch_id, "hour")
            of_hours = F.col("hour").isin(*touched)
            raw = spark.read.schema(found.withColumn("hour", F.lit("")).withColumn("batch", F.lit(0)).schema).parquet(f"{out}/hits")
            compact.run(raw.filter(of_hours).drop("hour", "batch"), every.filter(of_hours).drop("hour", "batch"), out, detver)
        ledger = df.groupBy("file").agg(F.count("*").alias("events"), F.sum(F.octet_length("line") + 1).alias("bytes")).withColumn("status", F.lit("ok"))
        store(ledger, "ledger", batch_id)

    return (stream_lines(spark, folder, files_per_batch).writeStream.foreachBatch(batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def hourly_counts(stream: DataFrame, id_col: str = "id", late: str = "2 hours") -> DataFrame:
    """Counts per hour of a stream with columns id and created_at; repeated ids count once within the watermark."""
    unique = stream.withWatermark("created_at", late).dropDuplicatesWithinWatermark([id_col])
    return unique.groupBy(F.window("created_at", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket_hour"), "n")


def to_table(stream: DataFrame, path: str, checkpoint: str, fix: Callable[[DataFrame], DataFrame] | None = None):
    """Append a stream's finished windows to a table, through a function of the batch where one is given."""
    def batch(df: DataFrame, _: int) -> None:
        append(fix(df) if fix else df, path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
