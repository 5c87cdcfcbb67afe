"""Retention to a byte budget, heavy hitters that merge in any order, and questions with parameters."""

from __future__ import annotations

import os
import random
from collections import Counter
from dataclasses import dataclass
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tonelake.operators import aggregates as agg
from tonelake.plans import ask
from tonelake.sources import retention


def test_running_bytes_with_hot_times(spark):
    rng = random.Random(2)
    at = datetime(2024, 1, 1)
    rows = [(at + timedelta(hours=0 if k % 3 == 0 else rng.randrange(400)), k, rng.randrange(50)) for k in range(3000)]
    rows += [(None, 5000, 7), (None, 5001, 1), (at, None, 3), (at, 9999, None), (at, 7, 11), (at, 7, 11)]
    df = spark.createDataFrame(rows, "at timestamp, tie long, n long").repartition(5)
    key = lambda r: (r[0] is None, -r[0].timestamp() if r[0] else 0, -(2**63) if r[1] is None else r[1])
    total, want = 0, []
    steps = {}
    for r in sorted(rows, key=key):
        total += r[2] or 0
        steps[key(r)] = total
    want = sorted(str((*r, steps[key(r)])) for r in rows)
    got = retention.running_bytes(df, "at", "tie", "n", cells=8)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan
    assert retention.over_budget(df, "at", "tie", "n", 10**9).count() == 0
    assert retention.over_budget(df, "at", "tie", "n", total // 2).count() == sum(steps[key(r)] > total // 2 for r in rows)
    assert retention.over_budget(df.limit(0), "at", "tie", "n", 1).count() == 0


def test_listing_reads_no_contents(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"f{k}").write_bytes(b"x" * (10 * k + 10))
        os.utime(tmp_path / f"f{k}", (1_700_000_000 + k, 1_700_000_000 + k))
    files = retention.listing(spark, str(tmp_path))
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    gone = retention.over_budget(files, "modificationTime", "tie", "length", 75).collect()
    assert sorted(r.path[-2:] for r in gone) == ["f0", "f1"]


def test_heavy_items_in_every_merge_order(spark):
    rng = random.Random(4)
    tracked = 24
    share = agg.guaranteed_share(tracked)
    assert share == 0.25
    words = ["big"] * 2600 + ["wide"] * 2600 + [f"w{k}" for k in range(4000)]
    rng.shuffle(words)
    words.sort(key=lambda w: rng.random() < 0.5 or w == "wide")  # parts of unlike content
    rows = [(k * 12 // len(words), w) for k, w in enumerate(words)]
    df = spark.createDataFrame(rows, "part int, word string")
    states = agg.heavy_states(df, F.col("word"), "part", tracked=tracked)
    exact = Counter(words)
    heavy = {w for w, n in exact.items() if n > share * len(words)}
    assert heavy == {"big", "wide"}
    for key in (F.lit(1), F.col("part") % 2, F.col("part") % 5):
        merged = agg.merge_heavy(agg.merge_heavy(states, key.alias("k"), tracked=tracked), F.lit(0).alias("k"), tracked=tracked)
        assert merged.first().rows == len(words)
        assert heavy <= {r.item for r in agg.heavy_items(merged, "k", tracked=tracked).collect()}


@dataclass
class Item:
    id: int
    name: str | None


def test_questions(spark):
    t = spark.createDataFrame([(1, "it's"), (2, '"; DROP'), (3, None)], "id int, name string")
    ask_for = lambda name: ask.many(spark, "SELECT id, name FROM {t} WHERE name <=> :name", {"name": name}, t=t)
    assert ask.one(ask_for("it's")).id == 1 and ask.one(ask_for('"; DROP')).id == 2 and ask.one(ask_for(None)).id == 3
    assert ask.maybe(ask_for("' OR 1=1 --")) is None
    assert ask.scalar(t.select(F.max("id"))) == 3
    assert sorted(ask.typed(t, Item), key=lambda x: x.id) == [Item(1, "it's"), Item(2, '"; DROP'), Item(3, None)]
    for bad in (lambda: ask.one(t), lambda: ask.maybe(t), lambda: ask.one(t.limit(0)), lambda: ask.scalar(t.limit(1)), lambda: ask.typed(t, Item, 2)):
        with pytest.raises(ask.WrongCount):
            bad()
    with pytest.raises(TypeError):
        ask.typed(t, dict)
