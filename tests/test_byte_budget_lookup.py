"""A row's place among the bounds takes few comparisons, all compiled."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import functions as F

from tonelake.sources import retention


def test_places_by_a_tree_of_comparisons(spark):
    for bounds in ([], [5], [-3, 0, 4, 9, 20], list(range(0, 126, 2))):
        df = spark.range(-10, 140).select("id", retention._below(bounds, F.col("id")).alias("n"))
        assert all(r.n == bisect_left(bounds, r.id) for r in df.collect())
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
