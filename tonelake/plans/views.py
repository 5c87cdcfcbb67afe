"""The seventeen named views over the hit facts, as functions and as temporary views.

Each is one aggregation; the top lists add a ranking that Spark prunes to the first rows of each group before it sorts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.dates import monday_zero
from tonelake.operators.aggregates import hits_and_utterances


def _day() -> Column:
    return F.to_date("created_at").alias("day")


def _hour() -> Column:
    return F.date_trunc("hour", "created_at").alias("hour")


def _lang() -> Column:
    return F.coalesce("lang_code", F.lit("")).alias("lang")


def _keyed(*keys: str | Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda crimes: hits_and_utterances(crimes, *[k() if callable(k) else F.col(k) for k in keys])


def hits_by_detver_daily(crimes: DataFrame) -> DataFrame:
    return crimes.groupBy(_day(), "detver").agg(F.count("*").alias("hits"))


def heatmap_weekly(crimes: DataFrame) -> DataFrame:
    """Monday is 0 here, unlike in the endpoint of the same name."""
    return hits_and_utterances(crimes, monday_zero(F.col("created_at")).alias("dow"), F.hour("created_at").alias("hod"))


def _ranked(df: DataFrame, group: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc("hits"), F.asc("term_id"), F.asc("lang"))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_terms_hour(crimes: DataFrame, n: int = 20) -> DataFrame:
    """Spellings of a term share its id; the most frequent one is shown, the first among equals."""
    own = crimes.groupBy("bucket_hour", "detver", _lang(), "term_id").agg(F.mode("term", True).alias("term"), F.count("*").alias("hits"))
    return _ranked(own, ["bucket_hour", "detver"], n)


def actor_top_terms_daily(crimes: DataFrame, n: int = 20) -> DataFrame:
    own = crimes.groupBy(_day(), "actor_hid", "detver", _lang(), "term_id").agg(F.mode("term", True).alias("term"), F.count("*").alias("hits"))
    return _ranked(own, ["day", "actor_hid", "detver"], n)


def samples_latest(crimes: DataFrame, n: int = 50) -> DataFrame:
    w = Window.partitionBy("term_id", "repo_hid").orderBy(F.desc("created_at"), F.asc("hit_id"))
    return crimes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def actor_leaderboard(crimes: DataFrame) -> DataFrame:
    return (crimes.groupBy("actor_hid").agg(F.count("*").alias("hits"), F.count_distinct("utterance_id").alias("utterances"),
                                            F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen")))


VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "timeseries_daily": _keyed(_day, "detver"),
    "timeseries_hourly": _keyed(_hour, "detver"),
    "hits_by_detver_daily": hits_by_detver_daily,
    "heatmap_weekly": heatmap_weekly,
    "lang_breakdown": _keyed(_lang),
    "category_severity": _keyed("category", "severity"),
    "top_terms_hour": top_terms_hour,
    "repo_day": _keyed(_day, "repo_hid", "detver", "category", "severity"),
    "samples_latest": samples_latest,
    "actor_timeseries_daily": _keyed(_day, "actor_hid", "detver"),
    "actor_timeseries_hourly": _keyed(_hour, "actor_hid", "detver"),
    "actor_day": _keyed(_day, "actor_hid", "detver", "category", "severity"),
    "actor_lang_breakdown": _keyed("actor_hid", _lang),
    "actor_category_severity": _keyed("actor_hid", "category", "severity"),
    "actor_top_terms_daily": actor_top_terms_daily,
    "actor_leaderboard": actor_leaderboard,
    "actor_repo_day": _keyed(_day, "actor_hid", "repo_hid", "detver"),
}


def register(crimes: DataFrame, prefix: str = "v_cc_") -> None:
    """All views for spark.sql."""
    for name, view in VIEWS.items():
        view(crimes).createOrReplaceTempView(prefix + name)
