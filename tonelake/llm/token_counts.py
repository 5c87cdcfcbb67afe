"""Token counts of whole texts through a digest cache.

Method: the SHA-256 of the normalised content and a digest of the tokenizer's file and settings key a Parquet cache of
counts.  The distinct digests are joined to the cache, only the misses are encoded, once each, and their counts are
appended; then every document takes its count by digest.  Normalising is what the byte-level vocabulary itself does
before it encodes, which is nothing: only null becomes the empty text, since anything more would change counts.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated results; a special
token's string inside a text counts as that one token, which is the default of the library the file is made for.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import exists, shared_dir

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Changes with the vocabulary file and with the way of counting."""
    with open(path, "rb") as f:
        return hashlib.sha256(b"plain-v1\0" + f.read()).hexdigest()


@lru_cache(maxsize=1)
def byte_level(path: str):
    """The byte-level BPE of a tokenizers .json file as a tiktoken encoding: the same ids, several times faster."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # printable stand-ins of bytes in such files: printable Latin-1 stands for itself, the rest follows from U+0100
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
    if any(t.get(flag) for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take in neighbouring characters are not supported")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in p): i for p, i in spec["model"]["vocab"].items() if p not in special}
    return tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=1)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def count_tokens(path: str, text: str | None) -> int:
    if not text:
        return 0
    try:
        return len(byte_level(path).encode(text, allowed_special="all"))
    except ValueError:  # its pattern engine gives up on white space runs of millions of characters
        return len(_library(path).encode(text, add_special_tokens=False).ids)


def token_ids(path: str, text: str | None):
    """Ids of a text in which special strings are ordinary text."""
    import numpy as np

    if not text:
        return np.zeros(0, np.uint32)
    try:
        return byte_level(path).encode_to_numpy(text, disallowed_special=())
    except ValueError:
        library = _library(path)
        library.encode_special_tokens = True
        try:
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
        finally:
            library.encode_special_tokens = False


def _count(path: str, digest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count_tokens(path, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest").cast(pa.binary()), pa.array([digest] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                ["digest", "tokenizer", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and whether the count was stored before (cached).

    cache_path: a Parquet folder that all machines share; made where it is missing, grown by the misses.  None: a new
    folder below the checkpoint folder, so nothing is known beforehand.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    cache_path = cache_path or shared_dir(spark, "token-counts")
    stored = _read_cache(spark, cache_path)
    known = stored.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    # grouped before the anti join: equal texts combine on the map side, and one hot text travels once a task
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    new = distinct.join(known, "digest", "left_anti")
    new.mapInArrow(_count(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    counts = (_read_cache(spark, cache_path).filter(F.col("tokenizer") == version)
              .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    before = known.select("digest", F.lit(True).alias("was"))
    rows = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return (rows.join(counts, "digest").join(before, "digest", "left")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
                    F.coalesce("was", F.lit(False)).alias("cached")))


def _read_cache(spark, path: str) -> DataFrame:
    """The cache as it is now: the list of files is fixed here, so later appends don't show."""
    return spark.read.schema(CACHE_SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE_SCHEMA)
