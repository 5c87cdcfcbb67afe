"""None of the queries that near copies takes, not only the last one, sends long tables through the driver."""

from __future__ import annotations

import random

from test_driver_memory import ten_megabytes  # noqa: F401
from test_operators import words

from tonelake.llm import common, simhash_dedup


def ran(spark):
    """Plans of the queries so far, as they ended, by number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(k).executionId(): found.apply(k).physicalPlanDescription() for k in range(found.size())}


def test_no_query_sends_long_tables(spark, ten_megabytes, monkeypatch):  # noqa: F811
    monkeypatch.setattr(common, "SENT_ROWS", 5, raising=False)
    rng = random.Random(9)
    texts = [words(rng, 80, 4000) for _ in range(30)]
    docs = common.durable(spark.createDataFrame([(k, t if k < 30 else t + " end") for k, t in enumerate(texts * 2)], "doc_id long, text string"), "docs")
    before = ran(spark)
    assert sorted(r.doc_id for r in simhash_dedup.near_copies(docs).collect()) == list(range(30))
    plans = [p for k, p in ran(spark).items() if k not in before]
    assert len(plans) > 10 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]
