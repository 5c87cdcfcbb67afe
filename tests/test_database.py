"""Reads in parts and writes that can be repeated, on a Derby database in memory."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tonelake.sources import database


@given(st.integers(-50, 50), st.integers(0, 60), st.integers(1, 9))
def test_ranges_cover_each_key_once(least, width, parts):
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (k INTEGER)")
    con.executemany("INSERT INTO t VALUES (?)", [(k,) for k in (None, *range(least - 5, least + width + 6))])
    got = [r[0] for p in database.ranges("k", least, least + width, parts) for r in con.execute(f"SELECT k FROM t WHERE {p}")]
    con.close()
    assert sorted(map(str, got)) == sorted(map(str, (None, *range(least - 5, least + width + 6))))


def test_round_trip_and_pushdown(spark):
    url = database.own_url(spark)
    rows = [(k if k % 10 else None, k, f"it's \"{k}\"" if k % 7 else "") for k in range(100)]
    df = spark.createDataFrame(rows, "part int, id long, name string").repartition(3)
    types = "name VARCHAR(50)"
    database.insert_missing(df.filter("id < 60"), url, "t", ["id"], types=types)
    for _ in range(2):  # again without effect
        database.insert_missing(df.unionByName(df), url, "t", ["id"], types=types)
    got = database.read(spark, url, "t", '"part"', 5)
    assert got.rdd.getNumPartitions() == 5
    assert sorted(map(str, got.select("part", "id", "name").collect())) == sorted(map(str, df.collect()))
    wanted = got.filter("id >= 90").select("name")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,90)" in plan and "part" not in plan.split("ReadSchema")[-1]
    assert wanted.count() == 10
    database.append(df.limit(0), url, "empty", types=types)
    assert database.read(spark, url, "empty", '"part"').count() == 0
    assert sorted(r[0] for r in spark.read.jdbc(url, "(SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T') x").collect()) == ["EMPTY", "T"]  # no staging is left


def test_no_private_database_on_a_cluster(monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda name, usual: usual)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="jdbc"):
        database.own_url(Cluster)
