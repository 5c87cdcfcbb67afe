"""Pages by key over the fact table and over odd keys."""

from __future__ import annotations

import os
from datetime import datetime
from decimal import Decimal

import pytest

from tonelake.operators.paging import decoded, page
from tonelake.sources import facts

SMALL = "/root/testdata/sf0.001"


def walked(df, order, limit):
    rows, cursor, pages = [], None, 0
    while True:
        p = page(df, order, limit, cursor)
        rows += p.rows
        pages += 1
        assert len(p.rows) == limit or p.next is None
        if p.next is None:
            return rows, pages
        cursor = p.next


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_pages_of_the_fact_table(spark):
    """Ties of severity and hour run over the edges of pages."""
    df = facts.crimes(spark, SMALL).select("hit_id", "severity", "created_at", "lang_code").repartition(3).cache()
    rows, pages = walked(df, ["severity", "-created_at", "hit_id"], 150)
    want = sorted(df.collect(), key=lambda r: (r.severity is not None, r.severity, -r.created_at.timestamp(), r.hit_id))
    assert rows == want and pages == -(-len(want) // 150)
    assert page(df, ["hit_id"], 0).rows == sorted(df.collect(), key=lambda r: r.hit_id) and page(df, ["hit_id"], 0).next is None
    assert "TakeOrderedAndProject" in df.orderBy("hit_id").limit(3)._jdf.queryExecution().executedPlan().toString()
    df.unpersist()


def test_pages_of_odd_keys(spark):
    at = datetime(2024, 1, 1, 2, 3, 4, 567890)
    rows = [(k, t, x, d, None if k % 3 else at, k % 2 == 0) for k, (t, x, d) in enumerate([(None, None, None), ("", 0.1, Decimal("1.50")), ("a'b\"\\", 1e300, None), ("é🙂", -0.5, Decimal("-2.00")), (None, 0.1, Decimal("1.50")), ("", None, Decimal("1.50"))])]
    df = spark.createDataFrame(rows, "k int, t string, x double, d decimal(9,2), at timestamp, b boolean")
    for name in ("t", "x", "d", "at", "b"):
        for sign in ("", "-"):
            got, _ = walked(df, [sign + name, "k"], 1)
            whole = page(df, [sign + name, "k"], 0).rows
            assert got == whole and len(whole) == len(rows)
    assert page(df.filter("false"), ["k"], 5) == page(df.filter("k > 99"), ["k"], 5) and page(df, ["k"], 6).next is None


def test_cursors_belong_to_their_order(spark):
    df = spark.range(9).withColumnRenamed("id", "k")
    cursor = page(df, ["k"], 3).next
    assert decoded(["k"], cursor) == ["2"] and [r.k for r in page(df, ["k"], 3, cursor).rows] == [3, 4, 5]
    for order, bad in ((["-k"], cursor), (["k"], cursor[:-4]), (["k"], "%%%"), (["k"], "bnVsbA"), (["k"], "")):
        with pytest.raises(ValueError):
            page(df, order, 3, bad)
    with pytest.raises(ValueError):
        page(df, ["k"], -1)
