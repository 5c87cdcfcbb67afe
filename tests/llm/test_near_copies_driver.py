"""The copies that near copies takes away are not sent through the driver, however small Spark takes them to be."""

from __future__ import annotations

import random

from test_driver_memory import ten_megabytes  # noqa: F401
from test_operators import words

from tonelake.llm import common, simhash_dedup


def test_copies_are_not_sent(spark, ten_megabytes, monkeypatch):  # noqa: F811
    monkeypatch.setattr(common, "SENT_ROWS", 5)
    rng = random.Random(8)
    texts = [words(rng, 80, 4000) for _ in range(20)]
    found = simhash_dedup.near_copies(spark.createDataFrame([(k, t if k < 20 else t + " end") for k, t in enumerate(texts * 2)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == list(range(20))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
