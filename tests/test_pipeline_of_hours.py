"""From archive lines to compacted hours: shapes of events, repeats, merging, retention, and the stream."""

from __future__ import annotations

import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tonelake.functions import ids
from tonelake.operators import aggregates as agg
from tonelake.operators.detector import hits
from tonelake.operators.extract import utterances
from tonelake.plans import compact
from tonelake.sources import archive, sinks
from tonelake.sources.rulepack import OWN, from_json
from tonelake.streaming import hours

PACK = from_json([OWN])
ACTOR, REPO = {"id": 5, "login": "Ann"}, {"id": 7, "name": "Own/Repo"}


def event(kind, payload, at="2024-01-01T10:05:06Z", **more):
    return {"type": kind, "public": True, "created_at": at, "actor": ACTOR, "repo": REPO, "payload": payload} | more


EVENTS = [
    event("PushEvent", {"commits": [{"sha": "1", "message": "worthless thing"}, {"sha": "2", "message": "  "}, {"sha": "3", "message": "fix clown bug"}]}),
    event("IssuesEvent", {"issue": {"title": "soup of nothing", "body": None}}),
    event("IssueCommentEvent", {"issue": {"title": "t"}, "comment": {"body": "flumdrub"}}),
    event("PullRequestEvent", {"pull_request": {"title": "p", "body": "clown"}}, at="2024-01-01T11:00:00Z"),
    event("PullRequestReviewCommentEvent", {"comment": {"body": "zibbo fell asleep"}}),
    event("CommitCommentEvent", {"comment": {"body": "fine"}}),
    event("WatchEvent", {}),
    # old shapes
    {"type": "CommitCommentEvent", "public": 1, "created_at": "2012/03/10 22:55:31 -0800", "actor": "Bob", "repository": {"name": "old", "owner": {"login": "Bob"}}, "payload": {"comment": {"body": "worthless"}}},
    {"type": "CommitCommentEvent", "public": "true", "created_at": "2012/03/10 22:55:31 -0800", "actor_attributes": {"login": "Eve"}, "repository": {"url": "https://github.com/Eve/thing.git"}, "payload": {"comment": {"body": "x"}}},
    {"type": "CommitCommentEvent", "created_at": "2012/03/10 22:55:31 -0800", "repository": {"name": "n", "owner": "o"}, "payload": {"comment": {"body": "no actor"}}},
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("archive")
    with gzip.open(d / archive.hour_name(datetime(2024, 1, 1, 9)), "wt") as f:
        f.write("\n".join(map(json.dumps, EVENTS)) + "\n\n")
    return str(d)


def table(spark, folder):
    return utterances(archive.envelopes(archive.parsed(archive.lines(spark, folder), "skip")))


def test_reading(spark, folder):
    assert archive.hour_name(datetime(2024, 1, 1, 9)) == "2024-01-01-9.json.gz"
    seen = Observation("read")
    env = archive.envelopes(archive.parsed(archive.observed(archive.lines(spark, folder).filter("line <> ''"), seen))).collect()
    assert len(env) == len(EVENTS) == seen.get["events"]
    old = [e for e in env if e.created_at.year == 2012]
    assert {e.repo_name for e in old} == {"bob/old", "eve/thing", "o/n"} and all(e.created_at == datetime(2012, 3, 11, 6, 55, 31) for e in old)
    bob = next(e for e in old if e.actor_login == "bob")
    assert bob.actor_id == ids.synthetic_id("actor:", "bob") and bob.repo_id == ids.synthetic_id("repo:", "bob/old") and bob.public


def test_malformed_lines(spark):
    bad = spark.createDataFrame([('{"type":"X"}',), ("{oops",), ("[1]",), ("",)], "line string")
    assert archive.parsed(bad, "skip").count() == 1
    with pytest.raises(Exception, match="no JSON object"):
        archive.parsed(bad, "fail").collect()


def test_utterances(spark, folder):
    rows = table(spark, folder).collect()
    got = sorted((r.source_detail, r.ordinal, r.source, r.text_raw) for r in rows)
    assert got == sorted([
        ("push:commit", 1, "commit", "worthless thing"), ("push:commit", 2, "commit", "fix clown bug"), ("issues:title", 1, "issue", "soup of nothing"),
        ("issue_comment:title", 1, "issue", "t"), ("issue_comment:body", 1, "issue", "flumdrub"), ("pr:title", 1, "pr", "p"), ("pr:body", 1, "pr", "clown"),
        ("pr_review_comment:body", 1, "pr", "zibbo fell asleep"), ("commit_comment:body", 1, "comment", "fine"), ("commit_comment:body", 1, "comment", "worthless"),
        ("commit_comment:body", 1, "comment", "x")])
    assert len({r.id for r in rows}) == len(rows)
    first = next(r for r in rows if r.text_raw == "fix clown bug")
    assert first.id == ids.utterance_uuid(json.dumps(EVENTS[0]).encode(), "push:commit", 2)


def test_compaction_repeats_without_effect(spark, folder, tmp_path):
    u = table(spark, folder).cache()
    h = hits(u, PACK, 1)
    doubled = (h.unionByName(h), u.unionByName(u))  # as if an hour had been loaded twice
    counts = []
    for raw in ((h, u), doubled):
        compact.run(*raw, str(tmp_path), 1)
        facts, states = (spark.read.parquet(f"{tmp_path}/{t}") for t in ("commit_crimes", "utt_hour_agg"))
        counts.append((facts.count(), facts.select("hit_id").distinct().count(), states.agg(F.sum("cnt")).first()[0]))
    assert counts[0] == counts[1] and counts[0][0] == counts[0][1] == h.count() and counts[0][2] == u.count()
    stay_u, stay_h = compact.run(h, u, str(tmp_path), 1, "timebox:5d", datetime(2024, 1, 3))
    assert stay_u.count() == u.filter("year(created_at) = 2024").count()
    assert compact.run(h, u, str(tmp_path), 1, "aggressive")[0].count() == 0


def test_states_merge_in_any_order(spark, folder):
    u = table(spark, folder)
    whole = agg.read_states(agg.merge_states(agg.hour_states(u), "source"), "source")
    a, b = agg.hour_states(u.filter("ordinal = 1")), agg.hour_states(u.filter("ordinal > 1"))
    parts = agg.read_states(agg.merge_states(b.unionByName(a), "source"), "source")
    exact = ["source", "uniq", "cnt", "text_sum", "min_at", "max_at"]
    assert sorted(whole.select(exact).collect()) == sorted(parts.select(exact).collect())


def test_an_hour_that_empties(spark, folder, tmp_path):
    """Facts of an hour go where a run finds none there; other hours and versions stay, and so does what retention keeps."""
    u = table(spark, folder).cache()
    h = hits(u, PACK, 1)
    compact.run(h, u, str(tmp_path), 1)
    compact.run(h.withColumn("detector_version", F.lit(2)), u, str(tmp_path), 2)
    count = lambda v, where="true": spark.read.parquet(f"{tmp_path}/commit_crimes").filter(F.col("detver") == v).filter(where).count()
    first, hour = count(1), "hour = '2024-01-01-10'"
    assert count(1, hour) and count(1, hour) < first and count(2) == first
    ten = h.filter("hour(created_at) = 10 and year(created_at) = 2024")
    compact.run(ten.withColumn("detector_version", F.lit(9)), u, str(tmp_path), 1)  # the hour has hits, but none of this version
    assert count(1, hour) == 0 and count(1) == first - count(2, hour) and count(2) == first
    facts = spark.read.parquet(f"{tmp_path}/commit_crimes")
    assert {"target_span_start", "target_span_end", "target_distance", "pre_context", "post_context"} <= set(facts.columns)
    raw = u.withColumn("hour", compact.hour_of(F.col("created_at")))
    sinks.overwrite_slices(raw, f"{tmp_path}/raw", "hour")
    assert compact.prune(spark, f"{tmp_path}/raw", "full") == [] == compact.prune(spark, f"{tmp_path}/none", "aggressive")
    assert compact.prune(spark, f"{tmp_path}/raw", "timebox:5d", datetime(2024, 1, 3)) == ["2012-03-11-06"]
    assert spark.read.parquet(f"{tmp_path}/raw").count() == u.filter("year(created_at) = 2024").count()


def test_sentiment_quantiles(spark):
    u = spark.createDataFrame([(f"u{k}", "s" if k < 100 else "t", "x" * (k % 9), k / 100 if k < 100 else None) for k in range(120)], "id string, source string, text_raw string, sentiment_score float")
    u = u.withColumns({"created_at": F.lit("2024-01-01").cast("timestamp"), "repo_hid": F.lit(None).cast("binary"), "actor_hid": F.lit(None).cast("binary"), "lang_code": F.lit("en"), "lang_reliable": F.lit(True)})
    got = {r.source: r for r in agg.read_states(agg.merge_states(agg.hour_states(u), "source"), "source").collect()}
    assert [round(q, 1) for q in got["s"].sent_quantiles] == [0.5, 0.9, 1.0] and got["t"].sent_quantiles is None and got["t"].sent_cnt == 0


def test_stream_equals_batch(spark, folder, tmp_path):
    for _ in range(2):  # the second start finds nothing new
        hours.start(spark, folder, f"{tmp_path}/out", f"{tmp_path}/checkpoint", PACK).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/hits")
    batch = hits(table(spark, folder), PACK, 1)
    assert sorted(r.id for r in got.select("id").collect()) == sorted(r.id for r in batch.select("id").collect())
    assert spark.read.parquet(f"{tmp_path}/out/ledger").agg(F.sum("events")).first()[0] == len(EVENTS) + 1
    compact.run(batch, table(spark, folder), f"{tmp_path}/batch", 1)
    for name, key in (("commit_crimes", "hit_id"), ("utt_hour_agg", "cnt")):
        stream, plain = (sorted((str(r.bucket_hour), r[key]) for r in spark.read.parquet(f"{tmp_path}/{x}/{name}").collect()) for x in ("out", "batch"))
        assert stream == plain and stream


def test_windowed_stream(spark, tmp_path):
    rows = [(f"a{k}", f"2024-01-01 {k % 3 + 1:02}:10:00") for k in range(9)] + [("a1", "2024-01-01 02:20:00"), ("z", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "id string, created_at string").selectExpr("id", "cast(created_at as timestamp) created_at").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, created_at timestamp").parquet(f"{tmp_path}/in")
    hours.to_table(hours.hourly_counts(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {str(r.bucket_hour)[11:13]: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"01": 3, "02": 3, "03": 3}


def test_upsert_keeps_or_replaces(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "n"), (3, "c", None)], "k int, v string, w string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a", "x"), (2, "b", "n"), (3, "c", None)]
    assert (2, None, "n") in set(map(tuple, sinks.upsert(old, new, ["k"], keep_old_if_null=False).collect()))


def test_overwrite_touches_only_its_slices(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.overwrite_slices(spark.createDataFrame([(1, "a"), (2, "b")], "v int, h string"), p, "h")
    sinks.overwrite_slices(spark.createDataFrame([(9, "b")], "v int, h string"), p, "h")
    assert sorted(map(tuple, spark.read.parquet(p).select("v", "h").collect())) == [(1, "a"), (9, "b")]


def test_masked_samples(spark):
    """Spans count bytes of the normalized text."""
    from tonelake.plans.endpoints import clamped, samples_latest, samples_masked

    texts = {"u": "what clown is this", "v": "é what clown is thís, clown", "w": None, "x": "no hits"}
    u = spark.createDataFrame([(i, "RAW", t) for i, t in texts.items()], "id string, text_raw string, text_normalized string")
    rows = [("u", 5, 10), ("v", 8, 13), ("v", 24, 29), ("v", 24, 29), ("w", 0, 3), ("gone", 0, 1)]
    c = spark.createDataFrame([(*r, "clown", "mild", k) for k, r in enumerate(rows)], "utterance_id string, span_start int, span_end int, term string, severity string, hit_id long").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    got = {r.utterance_id: (r.masked, len(r.hits)) for r in samples_masked(c, u).collect()}
    assert got == {"u": ("what ***** is this", 1), "v": ("é what ***** is thís, *****", 2), "w": (None, 1)}
    assert [r.hit_id for r in samples_latest(c, u, 3).orderBy("hit_id").collect()] == [0, 1, 2]
    assert [clamped(n, 50, 200) for n in (0, -1, 1, 200, 201)] == [50, 50, 1, 200, 50] and clamped(5000, 100) == 5000
