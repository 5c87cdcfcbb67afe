"""Lemma search by joins and zones as columns against the detector and the plain functions."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from tonelake.functions import text
from tonelake.operators import lemmas
from tonelake.operators.detector import Detector
from tonelake.sources import facts
from tonelake.sources.rulepack import Lemma, Pack

SMALL = "/root/testdata/sf0.001"
PACK = Pack(lemmas=[Lemma(t, "generic", s) for s, t in enumerate(
    ("ab", "a b", "b a", "b a b", "a", "é", "#", "b#", "é b", "stop", "a  b", "ab ab ab", "x_y", "b a b a b a"), 1)], stop={"stop"})


def plain(rows, pack):
    detector = Detector(pack)
    return sorted((k, h["term"], h["level"], h["span_start"], h["span_end"]) for k, t in rows for h in detector.scan(t))


def found(df, pack):
    return sorted((r.key, r.term, r.severity, r.span_start, r.span_end) for r in lemmas.lemma_hits(df, "key", "text", pack).collect())


def test_lemmas_of_odd_texts(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choices(["a", "b", "ab", " ", " ", "#", "é", "\n", "stop", "x_y", "漢", "😀"], k=rng.randrange(0, 60)))) for k in range(300)]
    rows += [(300, None), (301, ""), (302, "a b a b " * 800), (303, "ab " * 9000), (304, "é b" + "😀" * 5000 + " a  b")]
    df = spark.createDataFrame(rows, "key int, text string").repartition(5)
    want = plain(rows, PACK)
    assert found(df, PACK) == want and len(want) > 3000
    assert found(df.filter("key < 0"), PACK) == [] and found(df, Pack()) == []


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_lemmas_of_all_documents(spark):
    """Frequent pairs and words of the texts themselves, so that many overlap; and no Python in the plan."""
    docs = facts.read(spark, SMALL, "documents").select(F.col("doc_id").alias("key"), F.lower("text").alias("text"))
    rows = [(r.key, r.text) for r in docs.collect()]
    words = [w for _, t in rows[:40] for w in (t or "").split()[:12]]
    own = sorted({*words[::5], *(f"{a} {b}" for a, b in zip(words, words[1:])), *(f"{a} {b} {c}" for a, b, c in zip(words[::3], words[1::3], words[2::3]))})
    pack = Pack(lemmas=[Lemma(t, "generic", 1) for t in own if t])
    assert found(docs, pack) == plain(rows, pack)
    plan = lemmas.lemma_hits(docs, "key", "text", pack)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan


def test_offsets_over_chunks(spark):
    rows = [("",), (None,), ("é" * 7,), (" é" * 700,), ("ab " * 512,), ("x",)]
    p = text.pieces(F.col("t"))
    for r in spark.createDataFrame(rows, "t string").select("t", p.alias("p"), text.starts(p).alias("s")).collect():
        if r.t is None:
            assert r.s is None
        else:
            assert r.s == [len("".join(r.p[:k]).encode()) for k in range(len(r.p) + 1)]


def test_zones_of_odd_texts(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices(["`", "`", "```", "é", "a b", "\n", "\n> ", ">", " ", "\t> x", "> ", "\r", "``"], k=rng.randrange(0, 40))),) for _ in range(1500)]
    rows += [("",), ("`a` " * 3000,), ("> é\n" * 3000,), ("```x```" * 900 + "`",), ("````x```",), ("`" * 999,)]
    for inside in (False, True):
        got = spark.createDataFrame(rows, "t string").repartition(4).select("t", text.zones_col(F.col("t"), inside).alias("z")).collect()
        for r in got:
            assert sorted(map(tuple, r.z)) == sorted(text.zones(r.t, inside)), r.t[:80]
    assert spark.createDataFrame([(None,)], "t string").select(text.zones_col(F.col("t")).alias("z")).first().z is None


def test_zone_tags_like_the_detector(spark):
    rng = random.Random(7)
    rows = [(k, "".join(rng.choices(["clown ", "`", "```", "\n> ", "é", " loser", " x "], k=rng.randrange(1, 40)))) for k in range(400)]
    rows += [(400, "clown `clown` " * 500)]
    pack = Pack(lemmas=[Lemma("clown", "generic", 3), Lemma("loser", "generic", 1)])
    df = spark.createDataFrame(rows, "key int, text string").repartition(3)
    areas = df.select("key", F.explode(text.zones_col(F.col("text"))).alias("z")).select("key", "z.*")
    got = lemmas.zone_tags(lemmas.lemma_hits(df, "key", "text", pack), areas, "key").collect()
    detector = Detector(pack)
    want = sorted((k, h["term"], h["span_start"], h["level"], h["zones"]) for k, t in rows for h in detector.scan(t))
    assert sorted((r.key, r.term, r.span_start, r.level, r.zones) for r in got) == want
    assert {len(x[4]) for x in want} == {0, 1, 2}
