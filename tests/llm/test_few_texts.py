"""Every stage of the pipeline hands few whole texts at a time to Python workers, also when its caller writes the result."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline as pipeline
from tonelake.llm.common import table

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_stages_hold_few_texts(spark):
    before, docs = spark.conf.get(KEY), table(spark, SMALL, "documents").limit(5)
    try:
        for _, stage in pipeline.STAGES:
            for given, held in (("10000", "512"), ("0", "512"), ("100", "100")):
                spark.conf.set(KEY, given)
                stage(spark, docs, SMALL)
                assert spark.conf.get(KEY) == held
    finally:
        spark.conf.set(KEY, before)
