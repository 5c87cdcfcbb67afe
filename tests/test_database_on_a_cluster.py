"""The database query where executors reach no database: it failed with an error."""

from __future__ import annotations

import pytest

from tonelake.plans import catalogue
from tonelake.sources import database

SMALL = "/root/testdata/sf0.001"


def test_same_rows_without_a_database(spark, monkeypatch):
    query = catalogue.QUERIES["s13_rows_of_a_database"]
    wanted = sorted(map(tuple, query(spark, SMALL).collect()))

    def refused(spark):
        raise ValueError("set spark.tonelake.jdbc.url to a database that all machines reach")

    monkeypatch.setattr(database, "reachable", lambda spark: False)
    monkeypatch.setattr(database, "own_url", refused)
    assert sorted(map(tuple, query(spark, SMALL).collect())) == wanted and wanted


@pytest.mark.parametrize(("master", "url", "found"), [("local[4]", None, True), ("local-cluster[3,2,3000]", None, False), ("spark://host:7077", "jdbc:x", True)])
def test_when_a_database_is_reachable(master, url, found):
    class Session:
        class conf:
            get = staticmethod(lambda name, usual: url)

        class sparkContext:
            pass

    Session.sparkContext.master = master
    assert database.reachable(Session) is found


def test_rows_of_known_and_null_keys_are_left_out(spark):
    held = database.with_missing(spark.createDataFrame([(1, "a"), (1, "a"), (None, "x")], "k int, v string"), None, ["k"])
    held = database.with_missing(spark.createDataFrame([(1, "b"), (2, None), (2, None), (None, "y")], "k int, v string"), held, ["k"])
    assert sorted(map(tuple, held.collect())) == [(1, "a"), (2, None)]
