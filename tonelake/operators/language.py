"""Which language a text is in: naive Bayes over character trigrams, learnt from labelled texts; and of mixed texts the shares.

Texts are lower-cased, all but letters become one space, and each three consecutive characters are one trigram, hashed
to one of `BUCKETS` cells.  Learning is a grouped sum of counts per language and cell over all labelled texts, of which
each task sends its own sums, so the model (BUCKETS numbers a language) is all that the driver sees.  Scoring runs in
Arrow batches: a text's cells are looked up and summed with numpy, whole texts, a slice at a time.

`detect` gives the likeliest language of a whole text, whether it is reliable (its mean log odds per trigram over the
second language reach `margin`), `detect_mixed` the share of windows of `window` trigrams that go to each language.

Defined results: null texts, and texts with fewer than `least` letters, have no language (null, not reliable, no shares);
rows without a label or with an empty one teach nothing; repeated rows count again; of equal scores the first language
in code-point order wins; without any labelled text nothing has a language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions.text import in_slices

BUCKETS, SLICE = 1 << 14, 1 << 20
_other = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    logs: np.ndarray  # a row for each cell, a column for each language


def cells(text: str | None) -> np.ndarray:
    """The cells of a text's trigrams, in order; none for a text without letters."""
    plain = _other.sub(" ", text.lower()).strip() if text else ""
    if not plain:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    mixed = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in ((x.as_py(), t.as_py()) for x, t in zip(batch.column(0), batch.column(1), strict=True)):  # one text at a time
            held.setdefault(lang, np.zeros(BUCKETS, np.int64))
            held[lang] += np.bincount(cells(text), minlength=BUCKETS)
    for lang, own in held.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "cell", "n"])


def counts(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, cell, n) over all texts that have a language."""
    own = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang <> '' AND text IS NOT NULL")
    return own.mapInArrow(_counts, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 200) -> Profiles:
    """Profiles with add-one smoothing.  At most `most` languages may be labelled, since the model is collected."""
    rows = counts(labelled, lang_col, text_col)
    names = sorted(r.lang for r in rows.select("lang").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} languages")
    n = np.ones((BUCKETS, max(len(names), 1)))
    at = {x: k for k, x in enumerate(names)}
    for r in rows.collect():
        n[r.cell, at[r.lang]] += r.n
    return Profiles(tuple(names), np.log(n) - np.log(n.sum(0)))


def letters(text: str | None) -> int:
    return sum(map(len, _other.split(text))) if text else 0


def verdict(p: Profiles, text: str | None, margin: float, least: int) -> tuple[str | None, bool]:
    if letters(text) < least or not p.languages:
        return None, False
    own, total = cells(text), np.zeros(len(p.languages))
    for k in range(0, len(own), SLICE):
        total += p.logs[own[k : k + SLICE]].sum(0)
    first = int(total.argmax())
    rest = np.delete(total, first)
    return p.languages[first], bool(not len(rest) or (total[first] - rest.max()) / max(len(own), 1) >= margin)


def shares(p: Profiles, text: str | None, window: int, least: int) -> dict[str, float]:
    if letters(text) < least or not p.languages:
        return {}
    own = cells(text)
    step = max(1, SLICE // window) * window
    won = np.concatenate([np.add.reduceat(p.logs[part], np.arange(0, len(part), window), axis=0).argmax(1) for k in range(0, len(own), step) for part in [own[k : k + step]]])
    size = np.minimum(window, len(own) - np.arange(len(won)) * window)
    total = np.bincount(won, size, len(p.languages)) / len(own)
    return {p.languages[k]: float(x) for k, x in enumerate(total) if x}


def detect(spark: SparkSession, profiles: Profiles, text: Column, margin: float = 0.02, least: int = 20) -> Column:
    """struct(lang, reliable) of each whole text."""
    shared = spark.sparkContext.broadcast(profiles)  # BUCKETS numbers a language

    @F.arrow_udf("struct<lang string, reliable boolean>")
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("lang", pa.string()), ("reliable", pa.bool_())])
        return in_slices(texts, lambda t: dict(zip(("lang", "reliable"), verdict(shared.value, t, margin, least), strict=True)), kind)

    return run(text)


def detect_mixed(spark: SparkSession, profiles: Profiles, text: Column, window: int = 256, least: int = 20) -> Column:
    """map(language -> share of the text's trigrams in windows that it wins) of each whole text."""
    shared = spark.sparkContext.broadcast(profiles)

    @F.arrow_udf("map<string, double>")
    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda t: list(shares(shared.value, t, window, least).items()), pa.map_(pa.string(), pa.float64()))

    return run(text)
