"""From events to utterances: one row for each piece of text that somebody wrote in an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.ids import hid, utterance_uuid_col
from tonelake.functions.scalars import coarse_source, trimmed
from tonelake.functions.text import normalize_col, script_and_lang

# Where the texts of each event type are, and what a piece is called.
PIECES = {
    "IssuesEvent": (("issues:title", "$.payload.issue.title"), ("issues:body", "$.payload.issue.body")),
    "IssueCommentEvent": (("issue_comment:title", "$.payload.issue.title"), ("issue_comment:body", "$.payload.comment.body")),
    "PullRequestEvent": (("pr:title", "$.payload.pull_request.title"), ("pr:body", "$.payload.pull_request.body")),
    "PullRequestReviewCommentEvent": (("pr_review_comment:body", "$.payload.comment.body"),),
    "CommitCommentEvent": (("commit_comment:body", "$.payload.comment.body"),),
}


def _piece(detail: Column, text: Column) -> Column:
    return F.struct(detail.alias("detail"), trimmed(text).alias("text"))


def pieces(envelopes: DataFrame) -> DataFrame:
    """The rows of envelopes with detail, text and ordinal (1, 2, ... among an event's pieces of one detail)."""
    commits = F.transform(F.try_variant_get("v", "$.payload.commits", "array<variant>"),
                          lambda c: _piece(F.lit("push:commit"), F.try_variant_get(c, "$.message", "string")))
    every = F.when(F.col("type") == "PushEvent", commits)
    for kind, own in PIECES.items():
        every = every.when(F.col("type") == kind, F.array(*[_piece(F.lit(d), F.try_variant_get("v", p, "string")) for d, p in own]))
    told = F.filter(every, lambda p: F.coalesce(p["text"], F.lit("")) != "")
    # only commits repeat a detail within an event, so the place in the list is the ordinal there and 1 elsewhere
    df = envelopes.select("*", F.posexplode(told).alias("place", "piece"))
    return df.select("*", F.col("piece.detail").alias("detail"), F.col("piece.text").alias("text"),
                     F.when(F.col("piece.detail") == "push:commit", F.col("place") + 1).otherwise(F.lit(1)).alias("ordinal")).drop("place", "piece")


def utterances(envelopes: DataFrame, batch_id: int = 1, leet: str = "reference") -> DataFrame:
    """Rows of the utterance table; events without a repository, an actor or a time make none."""
    p = pieces(envelopes.filter("repo_id <> 0 AND actor_id <> 0 AND created_at IS NOT NULL"))
    p = p.withColumn("text_normalized", normalize_col(F.col("text"), leet))
    _, lang = script_and_lang(F.col("text_normalized"))
    return p.select(
        utterance_uuid_col(F.col("line"), F.col("detail"), F.col("ordinal")).alias("id"), F.col("type").alias("event_type"), hid("repo", F.col("repo_id")).alias("repo_hid"),
        hid("actor", F.col("actor_id")).alias("actor_hid"), F.lit(1).cast("smallint").alias("hid_key_version"), "created_at",
        coarse_source(F.col("detail")).alias("source"), F.col("detail").alias("source_detail"), "ordinal", F.col("text").alias("text_raw"), "text_normalized",
        F.nullif(lang, F.lit("")).alias("lang_code"), F.lit(None).cast("smallint").alias("lang_confidence"), F.lit(False).alias("lang_reliable"),
        F.lit(None).cast("float").alias("sentiment_score"), F.lit(batch_id).cast("bigint").alias("ingest_batch_id"), F.lit(batch_id).cast("bigint").alias("ver"), "repo_name")
