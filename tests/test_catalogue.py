"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tonelake.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rel = duck.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_sketches_are_close(spark):
    for r in catalogue.QUERIES["a03_sketch_estimates"](spark, SMALL).collect():
        assert abs(r.uniq - r.cnt) <= 0.05 * r.cnt + 2
        assert list(r.text_quantiles) == sorted(r.text_quantiles)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 23
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_reach_the_scan(spark):
    plan = catalogue.QUERIES["v05_lang_breakdown"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_views_by_name(spark):
    from tonelake.plans import views
    from tonelake.sources import facts

    views.register(facts.crimes(spark, SMALL))
    n = spark.sql("SELECT sum(hits) AS n FROM v_cc_timeseries_daily").first().n
    assert n == facts.crimes(spark, SMALL).count() and len([t for t in spark.catalog.listTables() if t.name.startswith("v_cc_")]) == len(views.VIEWS) == 17


def test_parts_of_the_yearly_answer(spark):
    from tonelake.plans import endpoints
    from tonelake.sources import facts

    c, n = facts.crimes(spark, SMALL), facts.counts(spark, SMALL)
    every = endpoints.yearly_trends(c, n, 2023, 2024)
    assert set(every) == {"monthly", "seasonality", "mix", "detver_markers", "year_over_year"}
    some = endpoints.yearly_trends(c, n, 2023, 2024, include=("mix", "detver_markers"))
    assert set(some) == {"mix", "detver_markers"} and sorted(some["mix"].collect()) == sorted(every["mix"].collect())


def test_spread(spark):
    from tonelake.session import spread

    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(100).coalesce(1), spark.range(0, 100, 1, cores + 3)
    assert spread(few).rdd.getNumPartitions() == cores and spread(few).count() == 100
    assert spread(many) is many
