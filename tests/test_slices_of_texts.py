"""Python workers hold a few texts at a time, however many an Arrow batch has."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import functions as F

from tonelake.functions import text
from tonelake.operators import language


class Held:
    now = most = 0

    def __init__(self):
        Held.now += 1
        Held.most = max(Held.most, Held.now)

    def __del__(self):
        Held.now -= 1


def test_slices_give_what_whole_batches_give():
    texts = pa.array([None if k % 7 == 0 else f"text {k}" for k in range(1000)])
    kind = pa.list_(pa.struct([("n", pa.int64())]))
    assert text.in_slices(texts, lambda t: [{"n": len(t)}] if t else [], kind).to_pylist() == [[{"n": len(t)}] if t else [] for t in texts.to_pylist()]
    assert text.in_slices(texts.slice(3, 0), len, pa.int64()).to_pylist() == []


def test_results_of_a_slice_go_before_the_next():
    class Row(dict):
        def __init__(self, t):
            super().__init__(t=t)
            self.held = Held()

    text.in_slices(pa.array([str(k) for k in range(5000)]), Row, pa.struct([("t", pa.string())]))
    gc.collect()
    assert Held.most <= 2 * text.SLICE and Held.now == 0


def test_null_and_empty_texts_in_slices(spark):
    p = language.learn(spark.createDataFrame([("en", "the cat and the dog " * 9), ("de", "der hund und die katze " * 9)], "lang string, text string"))
    df = spark.createDataFrame([(None,), ("",), ("the cat and the dog and the cat",)], "t string")
    got = df.select(language.detect(spark, p, F.col("t")).alias("d"), language.detect_mixed(spark, p, F.col("t")).alias("m")).collect()
    assert [(r.d.lang, r.d.reliable, r.m) for r in got] == [(None, False, {}), (None, False, {}), ("en", True, {"en": 1.0})]
