"""The fact tables projected from the `events` table, so that every query can be compared with plain SQL.

Each event is an utterance; two of three are offending, with one or two hits.  Keys are the same digests that the
archive reader makes; `term_id` is a small number here, where the hourly compaction uses a hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions.ids import hid
from tonelake.operators.aggregates import hour_states


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    return e.select(
        eid.alias("id"), F.col("ts").cast("timestamp").alias("created_at"), "event_type", "value",
        (uid % 20).alias("repo_key"), uid.alias("actor_key"), hid("repo", uid % 20).alias("repo_hid"), hid("actor", uid).alias("actor_hid"),
        F.when(eid % 4 == 0, "commit").when(eid % 4 == 1, "issue").when(eid % 4 == 2, "pr").otherwise("comment").alias("source"),
        F.when(uid % 5 == 0, "en").when(uid % 5 == 1, "fr").when(uid % 5 == 2, "de").when(uid % 5 == 4, "").alias("lang_code"),
        (eid % 7 != 0).alias("lang_reliable"), F.col("props").alias("text_raw"),
        F.when(eid % 5 == 0, F.col("value") / 500).cast("float").alias("sentiment_score"))


def crimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hit, with all that the queries ask for."""
    u = utterances(spark, sf_dir).filter("id % 3 <> 0").withColumn("n", F.explode(F.sequence(F.lit(0), (F.col("id") % 2).cast("int"))))
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    category = F.element_at(F.array(*map(F.lit, ("tooling_rage", "bot_rage", "generic", "self_own", "lang_rage"))), kind + 1)
    return u.select(
        "created_at", F.date_trunc("hour", "created_at").alias("bucket_hour"), (1 + F.col("id") % 2).cast("int").alias("detver"),
        (F.col("id") * 2 + F.col("n")).alias("hit_id"), F.col("id").alias("utterance_id"), "repo_key", "actor_key", "repo_hid", "actor_hid",
        "source", "lang_code", "lang_reliable", F.octet_length("text_raw").alias("text_len"),
        F.concat("event_type", F.lit("_"), F.col("id") % 13).alias("term"), (kind * 13 + F.col("id") % 13).alias("term_id"), category.alias("category"),
        F.when(F.col("value") < 50, "mild").when(F.col("value") < 150, "strong").otherwise("slur_masked").alias("severity"),
        F.when(F.col("id") % 4 == 0, "none").when(F.col("id") % 4 == 1, "bot").when(F.col("id") % 4 == 2, "tool").otherwise("lang").alias("target_type"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hour_states(utterances(spark, sf_dir))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of the hourly states only: an utterance is in one slice, so distinct ids sum up."""
    return (utterances(spark, sf_dir)
            .groupBy(F.date_trunc("hour", "created_at").alias("bucket_hour"), "repo_hid", "actor_hid", "source", "lang_code", "lang_reliable")
            .agg(F.count("*").alias("cnt")))


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repositories of the events, with the main language and counters that a catalogue would hold."""
    k = F.col("id")
    langs = F.map_from_arrays(F.array(F.lit("Go"), F.lit("Rust"), F.lit("C")), F.array(k % 7, k % 5, k % 3))
    return read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("id")).distinct().select(
        hid("repo", k).alias("repo_hid"), F.concat(F.lit("owner"), k % 4, F.lit("/repo"), k).alias("full_name"), langs.alias("languages"),
        F.element_at(F.array(F.lit("Go"), F.lit("Rust"), F.lit("C")), (k % 3 + 1).cast("int")).alias("primary_lang"), (k * 97 % 1500).cast("int").alias("stars"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consent receipts made of orders: who opted in or out, when, and whether it was revoked."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("consent_id"), F.when(k % 2 == 0, "repo").otherwise("actor").alias("principal"), F.col("o_custkey").alias("principal_key"),
        F.when(k % 3 == 0, "opt_out").otherwise("opt_in").alias("action"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(k % 5 == 0, "revoked").when(k % 5 == 1, "pending").otherwise("active").alias("state"))


# The same facts for DuckDB, as common table expressions.
FACTS_SQL = """
utterances AS (
  SELECT event_id AS id, ts AS created_at, event_type, value, user_id % 20 AS repo_key, user_id AS actor_key,
         sha256('repo:' || (user_id % 20)) AS repo, sha256('actor:' || user_id) AS actor,
         CASE event_id % 4 WHEN 0 THEN 'commit' WHEN 1 THEN 'issue' WHEN 2 THEN 'pr' ELSE 'comment' END AS source,
         CASE user_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' WHEN 4 THEN '' END AS lang_code,
         event_id % 7 <> 0 AS lang_reliable, props AS text_raw
  FROM events),
crimes AS (
  SELECT created_at, date_trunc('hour', created_at) AS bucket_hour, CAST(1 + id % 2 AS INT) AS detver, id * 2 + n AS hit_id,
         id AS utterance_id, repo_key, actor_key, repo, actor, source, lang_code, lang_reliable, strlen(text_raw) AS text_len,
         event_type || '_' || (id % 13) AS term,
         CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END * 13 + id % 13 AS term_id,
         CASE event_type WHEN 'click' THEN 'tooling_rage' WHEN 'error' THEN 'bot_rage' WHEN 'purchase' THEN 'generic' WHEN 'signup' THEN 'self_own' ELSE 'lang_rage' END AS category,
         CASE WHEN value < 50 THEN 'mild' WHEN value < 150 THEN 'strong' ELSE 'slur_masked' END AS severity,
         CASE id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'bot' WHEN 2 THEN 'tool' ELSE 'lang' END AS target_type
  FROM utterances, (VALUES (0), (1)) AS d(n) WHERE id % 3 <> 0 AND n <= id % 2),
repositories AS (
  SELECT sha256('repo:' || k) AS repo, 'owner' || (k % 4) || '/repo' || k AS full_name, ['Go', 'Rust', 'C'][k % 3 + 1] AS primary_lang,
         CAST(k * 97 % 1500 AS INT) AS stars, k
  FROM (SELECT DISTINCT user_id % 20 AS k FROM events)),
receipts AS (
  SELECT o_orderkey AS consent_id, CASE WHEN o_orderkey % 2 = 0 THEN 'repo' ELSE 'actor' END AS principal, o_custkey AS principal_key,
         CASE WHEN o_orderkey % 3 = 0 THEN 'opt_out' ELSE 'opt_in' END AS action, o_orderdate AS created_at,
         CASE o_orderkey % 5 WHEN 0 THEN 'revoked' WHEN 1 THEN 'pending' ELSE 'active' END AS state
  FROM orders)"""


def with_facts(select: str, extra: str = "") -> str:
    return f"WITH {FACTS_SQL.strip()}{', ' + extra if extra else ''}\n{select}"
