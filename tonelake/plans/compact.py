"""Hourly compaction: hits joined to their utterances as a wide fact, hour states, then retention.

Hours are partitions.  Both facts are written by replacing the hours that a run touches, so running it again changes
nothing, and an hour that has hits but no fact of the run's version loses the facts it had; the states are taken before
raw rows go.  Hours are UTC.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators.aggregates import hour_states, latest_version
from tonelake.sources.sinks import overwrite_slices, remove, slices

HOUR = "yyyy-MM-dd-HH"
HIT_KEYS = ["utterance_id", "id"]  # an id is a digest over its utterance; both keep a layout by utterance


def newest(df: DataFrame, keys: list[str]) -> DataFrame:
    return latest_version(df, keys, "ver", "ingest_batch_id")


def wide_facts(hits: DataFrame, utterances: DataFrame, detver: int, stamp_all: bool = False) -> DataFrame:
    """One row per hit.  stamp_all takes hits of every version and gives them this one's number."""
    h = hits if stamp_all else hits.filter(F.col("detector_version") == detver)
    u = utterances.select(F.col("id").alias("utterance_id"), "source_detail", "lang_confidence", "lang_reliable", "sentiment_score",
                          F.col("lang_code").alias("u_lang"), F.octet_length("text_raw").alias("text_len"))
    return h.join(u, "utterance_id").select(
        "created_at", F.date_trunc("hour", "created_at").alias("bucket_hour"), F.lit(detver).cast("int").alias("detver"), F.col("id").alias("hit_id"), "utterance_id",
        "repo_hid", "actor_hid", "source", "source_detail", F.coalesce(F.nullif(F.trim("lang_code"), F.lit("")), "u_lang").alias("lang_code"),
        "lang_confidence", "lang_reliable", "sentiment_score", "text_len", F.xxhash64(F.lower("term")).alias("term_id"), "term", "category", "severity",
        "ctx_action", "target_type", "target_id", "target_name", "target_span_start", "target_span_end", "target_distance",
        "span_start", "span_end", "detector_source", "pre_context", "post_context", "zones")


def kept(hours: Column, retention: str, now: datetime) -> Column:
    """Whether raw rows of an hour stay.  'full' and unknown rules keep all, 'aggressive' none, and 'timebox:Nd' the
    hours that don't end before N days ago."""
    if retention == "aggressive":
        return F.lit(False)
    if m := re.fullmatch(r"timebox:(\d+)d", retention):
        limit = now - timedelta(days=int(m[1]))
        return hours + F.expr("interval 1 hour") >= F.lit(limit.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    return F.lit(True)


def hour_of(at: Column) -> Column:
    return F.date_format(F.date_trunc("hour", at), HOUR)


def run(hits: DataFrame, utterances: DataFrame, out: str, detver: int, retention: str = "full", now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Write facts and states below `out`, and return the raw utterances and hits that retention keeps."""
    spark = hits.sparkSession
    # a run's hours are few whatever they hold; their facts go first, since an hour may have none now
    seen = {r.hour for r in hits.select(hour_of(F.col("created_at")).alias("hour")).distinct().collect()}
    for hour, folder in slices(spark, f"{out}/commit_crimes").items():
        if hour in seen:
            remove(spark, f"{folder}/detver={detver}")
    u = newest(utterances, ["id"]).persist()
    facts = wide_facts(newest(hits, HIT_KEYS), u, detver).withColumn("hour", hour_of(F.col("bucket_hour")))
    overwrite_slices(facts, f"{out}/commit_crimes", "hour", "detver", sort=("repo_hid", "actor_hid"))
    states = hour_states(u).withColumn("hour", hour_of(F.col("bucket_hour")))
    overwrite_slices(states, f"{out}/utt_hour_agg", "hour", sort=("repo_hid", "actor_hid"))
    u.unpersist()
    stay = kept(F.date_trunc("hour", "created_at"), retention, now or datetime.now(timezone.utc))
    return utterances.filter(stay), hits.filter(stay)


def prune(spark: SparkSession, path: str, retention: str, now: datetime | None = None) -> list[str]:
    """Remove the hours of a raw table (partitioned by `hour`) that retention doesn't keep; returns them."""
    hours = sorted(slices(spark, path))
    if not hours:
        return []
    df = spark.createDataFrame([(h,) for h in hours], "hour string")
    at = F.to_timestamp("hour", HOUR)
    gone = sorted(r.hour for r in df.filter(~kept(at, retention, now or datetime.now(timezone.utc))).collect())
    for hour in gone:
        remove(spark, f"{path}/hour={hour}")
    return gone
