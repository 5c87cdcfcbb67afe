"""Hourly archives of public events: newline-delimited JSON, one gzip file an hour, in shapes that changed over years.

Each line is parsed once into a VARIANT, and every field is the first of several paths that holds a value.  A gzip
file can't be split, so an hour is one task; the rows are spread by their own digest only where a caller asks for it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tonelake.functions.ids import synthetic_id_col
from tonelake.functions.scalars import boolish, canonical_repo


def hour_name(at: datetime) -> str:
    """The file of an hour; the hour has no leading zero."""
    return f"{at:%Y-%m-%d}-{at.hour}.json.gz"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))


def observed(df: DataFrame, observation: Observation) -> DataFrame:
    """Events and uncompressed bytes, counted while the lines pass."""
    return df.observe(observation, F.count("*").alias("events"), F.sum(F.octet_length("line") + 1).alias("bytes"))


def parsed(raw: DataFrame, malformed: str = "fail") -> DataFrame:
    """Lines with column v.  malformed: 'fail' stops at a line that is no JSON object, 'skip' leaves it out."""
    v = F.try_parse_json("line")
    good = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    df = raw.filter(F.trim("line") != "").withColumn("v", v)
    if malformed == "skip":
        return df.filter(good)
    return df.filter(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), F.substring("line", 1, 200))).cast("boolean")))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def _text(path: str) -> Column:
    """A string there that is no object in text form."""
    return F.when(~F.startswith(_get(path), F.lit("{")), F.nullif(F.trim(_get(path)), F.lit("")))


def envelopes(events: DataFrame) -> DataFrame:
    """line, v, type, public, created_at, actor_id, actor_login, repo_id, repo_name; ids that are missing are negative digests of the name."""
    url = F.coalesce(_text("$.repo.url"), _text("$.repository.url"))
    owner = F.coalesce(_text("$.repository.owner.login"), _text("$.repository.owner"))
    # old shapes name the owner apart from the repository
    old = F.when(owner.isNotNull(), F.concat(owner, F.lit("/"), _text("$.repository.name"))).otherwise(_text("$.repository.name"))
    named = canonical_repo(F.coalesce(F.nullif(_text("$.repo.name"), F.lit("/")), old, url))
    login = F.coalesce(_text("$.actor.login"), _text("$.actor_attributes.login"), _text("$.actor"))
    at = _text("$.created_at")
    time = F.coalesce(F.try_to_timestamp(at), F.try_to_timestamp(at, F.lit("yyyy/MM/dd HH:mm:ss Z")))
    df = events.select(
        "line", "v", _text("$.type").alias("type"), boolish(_get("$.public")).alias("public"), F.date_trunc("millisecond", time).alias("created_at"),
        F.coalesce(_get("$.actor.id", "long"), F.lit(0)).alias("actor_id"), login.alias("actor_login"),
        F.coalesce(_get("$.repo.id", "long"), _get("$.repository.id", "long"), F.lit(0)).alias("repo_id"), named.alias("repo_name"))
    df = df.withColumn("actor_login", F.when(F.col("actor_id") != 0, F.col("actor_login")).otherwise(F.lower(F.trim("actor_login"))))
    return (df.withColumn("actor_id", F.when(F.col("actor_id") != 0, F.col("actor_id")).otherwise(synthetic_id_col("actor:", F.col("actor_login"))))
            .withColumn("repo_id", F.when(F.col("repo_id") != 0, F.col("repo_id")).otherwise(synthetic_id_col("repo:", F.col("repo_name")))))
