"""What near copies may take of disk: no second shuffle of texts, no shuffles that outlive their query, few trials of long texts."""

from __future__ import annotations

import random
import time

import numpy as np
from test_operators import words

from tonelake.llm import common, simhash_dedup


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {p for p in files.mkString("\n").split("\n") if "shuffle_" in p and p.endswith(".data")}


def test_texts_are_dealt_once_and_shuffles_go(spark):
    rng = random.Random(3)
    texts = [words(rng, 80, 4000) for _ in range(60)]
    docs = spark.createDataFrame([(k, t if k < 60 else t + " end") for k, t in enumerate(texts * 2)], "doc_id long, text string")
    before, tables, setting = shuffled(spark), spark.catalog.listTables(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    found = simhash_dedup.near_copies(docs)
    for _ in range(50):
        if not (new := shuffled(spark) - before):
            break
        time.sleep(0.2)
    assert not new
    assert "Bucketed: true" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in found.collect()) == list(range(60)) == sorted(r.doc_id for r in found.collect())
    assert spark.catalog.listTables() == tables and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_wide_sketches_rule_out_long_texts_and_no_similar_ones(spark):
    rng, rows, want = np.random.default_rng(4), [], []
    for n in (3, 60, 300, 1500, 5000):
        for m in (n, n * 9 // 10):
            for similarity in (0.0, 0.5, 0.8, 0.81, 0.95):
                common_ = min(m, -int(-similarity * (n + m) // (1 + similarity)))
                h = rng.integers(0, 1 << 63, n + m - common_, dtype=np.uint64)
                x, y = h[:n], h[n - common_:]
                real = common_ / len(h)
                sketches = [simhash_dedup.wide_sketch(s) for s in (x, y)]
                assert all(np.array_equal(simhash_dedup.folded(s, simhash_dedup.SKETCH), simhash_dedup.folded(simhash_dedup.folded(s, len(s) // 2), simhash_dedup.SKETCH)) for s in sketches if len(s) > simhash_dedup.SKETCH)
                rows.append((len(rows), *[s.tobytes() for s in sketches], n, m))
                want.append(True if real >= 0.8 else n >= 60 and real <= 0.51 and None)
    df = spark.createDataFrame(rows, "k int, x binary, y binary, n long, m long")
    out = {r.k: r.out for r in df.select("k", simhash_dedup.wide_apart(0.8)("x", "y", "n", "m").alias("out")).collect()}
    assert not any(out[k] for k, w in enumerate(want) if w)
    assert all(out[k] for k, w in enumerate(want) if w is None) and sum(w is None for w in want) > 10


def test_settings_come_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        with common.settings(spark, common.FEW_TEXTS):
            assert spark.conf.get(key) == "512"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(key) == before
