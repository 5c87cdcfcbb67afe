"""The ledger of hours: which are known, what became of them, and which may be worked on next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions.dates import series
from tonelake.sources.sinks import insert_if_absent, upsert

# The statuses that an hour may change to, by stage.
NEXT = {
    "bf_status": {"pending": ("running",), "error": ("running",), "running": ("ok", "error"), "ok": ()},
    "ns_status": {"pending": ("running",), "error": ("running",), "running": ("retention_applied", "error"), "retention_applied": ()},
}


def seed(spark: SparkSession, ledger: DataFrame, start: str, stop: str) -> DataFrame:
    """The ledger with every hour of a range, both ends included; hours that are there stay as they are."""
    hours = series(spark, start, stop, "1 hour", "hour_utc").withColumns({"bf_status": F.lit("pending"), "ns_status": F.lit("pending")})
    missing = [c for c in ledger.columns if c not in hours.columns]
    hours = hours.withColumns({c: F.lit(None).cast(ledger.schema[c].dataType) for c in missing}).select(*ledger.columns)
    return insert_if_absent(ledger, hours, ["hour_utc"])


def advance(ledger: DataFrame, changes: DataFrame, stage: str) -> DataFrame:
    """The ledger after changes (hour_utc, a status, counters); changes that the stage doesn't allow have no effect."""
    now = ledger.select("hour_utc", F.col(stage).alias("__now"))
    allowed = F.lit(False)
    for status, following in NEXT[stage].items():
        if following:
            allowed = allowed | (F.col("__now") == status) & F.col(stage).isin(*following)
    good = changes.join(now, "hour_utc").filter(allowed).drop("__now")
    return upsert(ledger, good, ["hour_utc"])


def open_hours(ledger: DataFrame, stage: str, limit: int | None = None) -> DataFrame:
    df = ledger.filter(F.col(stage).isin("pending", "error")).orderBy("hour_utc")
    return df.limit(limit) if limit else df
