"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the last return the
columns of `documents`; the last returns the token ids of each remaining text.  Columns besides these are dropped, an
empty table gives an empty table, and nulls in lang, source and n_chars mean nothing to any stage.

From the first stage on the session hands Python workers at most 512 rows at a time (`hold_few_texts`), since whole texts by
the 10,000 of Spark's default take much memory on both sides.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm import decontaminate, quality, sentencepiece_codec, simhash_dedup, toxicity
from tonelake.llm.common import durable, hold_few_texts, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM, QUALITY_FROM = 0.5, 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go.  Null and empty texts have the lowest score there is;
    repeated rows go or stay together; without labels of both classes nothing goes."""
    hold_few_texts(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).filter(toxicity.score(spark, model, F.col("text")) < TOXIC_FROM)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score stays below the threshold go.  A null text counts as the empty one, which is scored
    as any other; repeated rows go or stay together; without labels of both classes nothing goes."""
    hold_few_texts(spark)
    machine = quality.learn(docs, table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).filter(quality.score(spark, machine, F.col("text")) >= QUALITY_FROM)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies (five-word shingles, Jaccard similarity 0.8 or more; tried is what op7's
    fingerprints link, and by an exact join all else) the row of the smallest id stays; rows that share an id but not their text are documents of their own, and rows without an id come last."""
    hold_few_texts(spark)
    return simhash_dedup.near_copies(docs.select(*COLUMNS))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, up to its edit budget, go.  Null and empty texts and items match nothing, so an
    empty benchmark leaves all rows."""
    hold_few_texts(spark)
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the whole text, and its language and source.  Null and empty texts have no ids; every row
    stays, also where ids are null or repeated."""
    hold_few_texts(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encode(docs, model, keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", to_pieces),
]

#: Two stages hold fitted models, which SQL can't express; tests compare the run with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
