"""What must not pass through the driver, however small Spark takes it to be."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tonelake.llm import common


@pytest.fixture
def ten_megabytes(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_blocks_of_exploded_rows_are_not_sent(spark, ten_megabytes):
    few = common.durable(spark.range(2000).select(F.col("id").alias("fp")), "few")
    units = common.in_blocks(few.select("fp", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("bucket")), "bucket", F.col("fp"), 512)
    assert units.count() == 31 * 4 * 2000
    assert "BroadcastHashJoin" not in units._jdf.queryExecution().executedPlan().toString()


def test_long_tables_of_nodes_are_not_sent(spark, ten_megabytes, monkeypatch):
    monkeypatch.setattr(common, "SENT_ROWS", 50)
    items = common.durable(spark.range(100).select(F.col("id").alias("k"), (F.col("id") + 7).alias("first")), "nodes")
    links = spark.range(99).filter("id % 10 <> 9").select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = common.smallest_reached(items, links, "k", "first")
    assert {r.k: r.component_id for r in found.collect()} == {k: k // 10 * 10 + 7 for k in range(100)}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
