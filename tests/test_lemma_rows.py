"""Lemma hits are found piece by piece in generated code, and nothing is worked out twice for a piece."""

from __future__ import annotations

import os
import random
import re

import pytest

from tonelake.operators import lemmas
from tonelake.operators.detector import Detector
from tonelake.plans import catalogue
from tonelake.sources.rulepack import Lemma, Pack

SMALL = "/root/testdata/sf0.001"
PACK = Pack(lemmas=[Lemma("ab", "generic", 2), Lemma("b", "generic", 1)])


def test_a_piece_is_not_cut_again(spark):
    """Spark knows that a hit's piece equals a term, and so would do for all pieces what a rule's column is made by."""
    df = spark.createDataFrame([(1, "ab b")], "key int, text string")
    for pack in (PACK, Pack(lemmas=[*PACK.lemmas, Lemma("b ab", "generic", 3)])):
        plan = lemmas.lemma_hits(df, "key", "text", pack)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1


def test_rules_of_one_piece_need_no_shuffle_of_hits(spark):
    df = spark.createDataFrame([(1, "ab b")], "key int, text string")
    plan = lemmas.lemma_hits(df, "key", "text", PACK)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_texts_of_one_id_keep_their_own_hits(spark):
    df = spark.createDataFrame([(1, "ab b"), (1, "ab b"), (None, "b"), (None, "b")], "key int, text string")
    got = sorted((r.key or 0, r.term, r.span_start) for r in lemmas.lemma_hits(df, "key", "text", PACK).collect())
    assert got == [(0, "b", 0), (0, "b", 0), (1, "ab", 0), (1, "ab", 0), (1, "b", 3), (1, "b", 3)]


@pytest.mark.parametrize("open_ended", [False, True])
def test_windows_over_the_ends_of_chunks(spark, monkeypatch, open_ended):
    rng = random.Random(11)
    monkeypatch.setattr(lemmas, "ROWS", 3)
    rows = [(k, "".join(rng.choices(["a", "b", "ab", " ", " ", "#", "é", "漢"], k=rng.randrange(0, 30)))) for k in range(300)]
    terms = ("ab", "a b", "b a b", "é b", "a b a b a") + (("#", "b#", "# #") if open_ended else ())
    pack = Pack(lemmas=[Lemma(t, "generic", n) for n, t in enumerate(terms, 1)])
    detector = Detector(pack)
    want = sorted((k, h["term"], h["span_start"]) for k, t in rows for h in detector.scan(t))
    got = lemmas.lemma_hits(spark.createDataFrame(rows, "key int, text string").repartition(3), "key", "text", pack).collect()
    assert sorted((r.key, r.term, r.span_start) for r in got) == want and len(want) > 100


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_dampened_hits_and_zones_meet_in_one_shuffle(spark):
    plan = catalogue.QUERIES["l16_dampened_by_zones"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1 and len(re.findall("FileScan", plan)) == 2
