"""Scripts counted by taking letters out, against counting each script's letters on their own."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tonelake.functions import text
from tonelake.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def test_scripts_of_mixed_texts_like_separate_counts(spark):
    rng = random.Random(3)
    own = ["abcé", "Жд", "あの", "カナ", "한글", "漢字", "مر", "שא", "ก", "αβ", "ქა", "Աբ", "कख", " 1.\n", "Ⅷ〇", "𝒜𐐀"]
    rows = [(None,), ("",), ("Ⅷ",), *[("".join(rng.choice(rng.choice(own[: rng.randrange(1, 17)])) for _ in range(rng.randrange(60))),) for _ in range(500)]]
    n = {s: F.regexp_count("t", F.lit(rf"[\p{{L}}&&\p{{Is{s}}}]")) for s in text.SCRIPTS}
    most = F.greatest(*n.values())
    script, lang = F.when(most.isNull() | (most == 0), ""), F.when(F.regexp_count("t", F.lit(r"\p{L}")) < text.LEAST_LETTERS, "")
    for s in text.SCRIPTS:
        script = script.when(n[s] == most, s)
    for s, code in text.LANG_OF_SCRIPT.items():
        lang = lang.when(n[s] > 0, code)
    df = spark.createDataFrame(rows, "t string").select("t", script.alias("a"), lang.otherwise("").alias("b"), text.script_hint(F.col("t")).alias("h"))
    for r in df.collect():
        assert (r.h.script, r.h.lang) == (r.a, r.b), r.t


def test_one_pass_a_script_and_no_arrays_of_matches(spark):
    plan = catalogue.QUERIES["l09_scripts_and_languages"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("regexp_replace") <= len(text.SCRIPTS) + 1
