"""Tables in buckets: joins and newest rows without an exchange, hours replaced on their own."""

from __future__ import annotations

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tonelake.plans import catalogue, compact
from tonelake.sources import bucketed, facts

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, name = tmp_path_factory.mktemp("buckets"), uuid.uuid4().hex
    raw, u = catalogue._raw_hits_and_utterances(spark, SMALL)
    bucketed.store(raw, f"h_{name}", "utterance_id", f"{folder}/h", 6)
    bucketed.store(u, f"u_{name}", "id", f"{folder}/u", 6)
    yield raw, u, f"h_{name}", f"u_{name}"
    for t in (f"h_{name}", f"u_{name}"):
        spark.sql(f"DROP TABLE {t}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange_from_scan_to_facts(spark, tables):
    raw, u, hits, utterances = tables
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        wide = compact.wide_facts(compact.newest(bucketed.read(spark, hits), compact.HIT_KEYS), compact.newest(bucketed.read(spark, utterances), ["id"]), 2)
        assert "Exchange" not in plan(wide) and "SortMergeJoin" in plan(wide)
        joined = bucketed.read(spark, hits).join(bucketed.read(spark, utterances).select(F.col("id").alias("utterance_id"), "event_type"), "utterance_id")
        assert "Exchange" not in plan(joined)
        plain = compact.wide_facts(compact.newest(raw, ["id"]), compact.newest(u, ["id"]), 2)
        assert "Exchange" in plan(plain)
        assert sorted(map(str, wide.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hours_are_pruned_and_replaced_alone(spark, tables, tmp_path):
    raw, _, hits, _ = tables
    hour = raw.select(compact.hour_of(F.col("created_at")).alias("h")).agg(F.min("h")).first()[0]
    one = bucketed.read(spark, hits, hour, hour)
    assert "PartitionFilters" in plan(one) and "(hour#" in plan(one)
    assert one.count() == raw.filter(compact.hour_of(F.col("created_at")) == hour).count() > 0
    name = f"t_{uuid.uuid4().hex}"
    bucketed.store(raw, name, "utterance_id", f"{tmp_path}/t", 3)
    changed = raw.filter(compact.hour_of(F.col("created_at")) == hour).limit(1).withColumn("term", F.lit("new")).cache()
    for _ in range(2):  # again without effect
        bucketed.store(changed, name, "utterance_id", f"{tmp_path}/t", 3)
        got = bucketed.read(spark, name)
        assert [r.term for r in bucketed.read(spark, name, hour, hour).collect()] == ["new"]
        assert got.count() == raw.count() - one.count() + 1
    with pytest.raises(ValueError, match="laid out"):
        bucketed.store(changed, name, "utterance_id", f"{tmp_path}/t", 4)
    bucketed.store(raw.limit(0), name, "utterance_id", f"{tmp_path}/t", 3)  # no hours, so none is replaced
    assert bucketed.read(spark, name).count() == raw.count() - one.count() + 1
    spark.sql(f"DROP TABLE {name}")


def test_days_as_partitions(spark, tables, tmp_path):
    raw, *_ = tables
    name = f"d_{uuid.uuid4().hex}"
    bucketed.store(raw, name, "utterance_id", f"{tmp_path}/d", 3, unit="day")
    day = raw.select(F.date_format("created_at", "yyyy-MM-dd").alias("d")).agg(F.min("d")).first()[0]
    one = bucketed.read(spark, name, day, day)
    assert "(day#" in plan(one) and one.count() == raw.filter(F.date_format("created_at", "yyyy-MM-dd") == day).count() > 0
    assert bucketed.layout(spark, name) == ("utterance_id", 3, "day") and bucketed.read(spark, name).count() == raw.count()
    with pytest.raises(ValueError, match="laid out"):
        bucketed.store(raw, name, "utterance_id", f"{tmp_path}/d", 3)
    spark.sql(f"DROP TABLE {name}")
