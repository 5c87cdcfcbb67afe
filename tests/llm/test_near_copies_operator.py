"""The pipeline's near copies are searched by the operator's fingerprints too, and each pair of them is checked exactly."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_operators import words

import corpus_pipeline as pipeline
from tonelake.llm import simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, texts):
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA)
    return sorted(r.doc_id for r in pipeline.keep_one_of_near_copies(spark, docs, "").collect())


def test_fingerprints_are_searched(spark, monkeypatch):
    """With the trials of shared shingles taken away, what fingerprints connect is still found."""
    rng = random.Random(2)
    base = [words(rng, 400, 4000) for _ in range(12)]
    texts = base + [t + " end" for t in base] + ["the end " + t for t in base[:4]]
    assert kept(spark, texts) == list(range(12))
    monkeypatch.setattr(simhash_dedup, "_propose", lambda similarity, every: lambda batches: iter([b for b in batches][:0]))
    distance = lambda i, j: (simhash_dedup.fingerprint_of(texts[i].encode(), 4) ^ simhash_dedup.fingerprint_of(texts[j].encode(), 4)).bit_count()
    within = [k for k in range(12, 28) if distance(k % 12, k) <= 4]
    assert len(within) > 5 and set(kept(spark, texts)) <= set(range(28)) - set(within)


def test_a_repeated_line_alone_makes_no_copy(spark):
    rng = random.Random(6)
    texts = ["again " * 200 + words(rng, 60, 4000) for _ in range(5)]
    one = {simhash_dedup.fingerprint_of(t.encode(), 4) for t in texts}
    assert max((a ^ b).bit_count() for a in one for b in one) <= 4  # the operator by itself links them
    assert kept(spark, texts) == list(range(5))


def test_pairs_connect_what_fingerprints_connect(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(63) for _ in range(20)]
    prints = [s ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) if k else s for s in seeds for k in range(6)] + seeds[:5] * 3
    items = spark.createDataFrame(list(enumerate(prints)), "item long, fp long").withColumn("other", F.lit(1))
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in simhash_dedup.alike(items, 4).collect():
        assert r.u < r.v and (prints[r.u] ^ prints[r.v]).bit_count() <= 4
        root[find(r.v)] = find(r.u)
    for i in range(len(prints)):
        for j in range(i):
            assert (prints[i] ^ prints[j]).bit_count() > 4 or find(i) == find(j)
