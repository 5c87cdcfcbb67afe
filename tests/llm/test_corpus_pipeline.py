"""The pipeline's stages against plain versions, on the smallest tables and on odd ones."""

from __future__ import annotations

import os

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tonelake.llm import decontaminate
from tonelake.llm.common import table

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_whole_run(spark):
    import sentencepiece

    from test_operators import component, plain_shingles

    docs = table(spark, SMALL, "documents")
    score8 = {r.doc_id for r in pipeline.drop_toxic(spark, docs, SMALL).collect()}
    after8 = docs.filter(F.col("doc_id").isin(*score8))
    after9 = {r.doc_id: r.text for r in pipeline.keep_quality(spark, after8, SMALL).collect()}
    sets = {i: plain_shingles(t) for i, t in after9.items()}
    near = {i: {j for j in sets if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    heads = {i: t for i, t in after9.items() if component(near, i) == i}
    kept = {r.doc_id: r.text for r in pipeline.keep_one_of_near_copies(spark, spark.createDataFrame([(i, t, None, None, None) for i, t in after9.items()], docs.schema), SMALL).collect()}
    assert set(heads) <= set(kept) and len(kept) <= len(heads) + 0.03 * len(after9)  # the search may miss a pair, and links no other
    heads = kept
    items = [decontaminate.normalise(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    clean = {i: t for i, t in heads.items() if not any(f" {s} " in f" {decontaminate.normalise(t)} " for s in items)}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: list(r.token_ids) for r in pipeline.run(spark, SMALL).collect()}
    assert got == {i: model.encode(t) for i, t in clean.items()} and 50 < len(got) < docs.count()


def test_stages_on_odd_tables(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", None, None, None), (None, "no id", None, None, None), (3, "x" * 50000, "en", None, 1), (4, "x" * 50000, "en", None, 1), (4, "another text of this id", "en", None, 1), (5, "word " * 250_000, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    for data in (docs, docs.filter("false")):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, data, SMALL)
            assert out.columns == pipeline.COLUMNS and out.count() <= data.count()
        assert pipeline.STAGES[-1][1](spark, data, SMALL).count() == data.count()
    kept = pipeline.keep_one_of_near_copies(spark, docs, SMALL).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3, 4, 5]
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "sentencepiece"]
