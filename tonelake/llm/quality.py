"""Text quality by a factorisation machine.

Method: a text becomes hashed lower-case words (square roots of counts, scaled to length one), structure statistics
and metadata, its numbers of characters, words and lines; the machine adds a bias, a linear term and low-rank pairwise
interactions, which the identity sum_{i<j} <v_i, v_j> x_i x_j = (|sum x_i v_i|^2 - sum |x_i v_i|^2) / 2 scores in linear
time, for many texts at once.

Fitting runs on the driver, in batches of texts, over a sample bounded by `per_class` and `max_bytes`; scoring covers every whole text.
Defined results: null counts as the empty text, whose features are all zero but its statistics; without labels of both
classes every score is 0.5; repeated rows get equal scores.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.common import bounded_sample, class_shift

BUCKETS = 1 << 14
N_STATS = 20
CACHE = 100_000  # words kept; bounds a worker's memory


def _statistics(text: str, words: list[str], count: Counter) -> list[float]:
    n, w = max(len(text), 1), max(len(words), 1)
    lines = text.split("\n")
    alpha = sum(map(str.isalpha, text)) / n
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / w
    bigrams = len(set(zip(words, words[1:], strict=False))) / w
    return [
        np.log1p(len(text)) / 10, np.log1p(len(words)) / 10, len(count) / w, repeats, bigrams,
        max(count.values(), default=0) / w, sum(map(len, words)) / w / 10, min(max(map(len, words), default=0) / 50, 2),
        alpha, min(1.0, sum(w.isupper() for w in re.findall(r"\w+", text)) / w), min(1.0, 20 * text.count("|") / n),
        min(1.0, 10 * text.count("!") / n), min(1.0, 10 * text.count(".") / n), min(1.0, 10 * text.count(",") / n),
        min(1.0, 20 * (text.count("{") + text.count("}") + text.count("<") + text.count(">") + text.count("=")) / n),
        min(1.0, 10 * len(re.findall(r"\d", text)) / n), min(1.0, 100 * text.count("://") / n), len(lines) / w,
        len(set(lines)) / len(lines), min(1.0, 20 * text.count("�") / n + 20 * text.count("Ã") / n),
    ]


def features(text: str | None, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words first, then the statistics."""
    text = text or ""
    words = text.split()
    count = Counter(text.lower().split())
    if len(cache) > CACHE:
        cache.clear()
    at = np.empty(len(count), np.int64)
    for k, w in enumerate(count):
        b = cache.get(w)
        if b is None:
            b = cache[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
        at[k] = b
    x = np.sqrt(np.fromiter(count.values(), float, len(count)))
    x /= max(np.sqrt((x * x).sum()), 1e-9)
    return np.concatenate([at, np.arange(BUCKETS, BUCKETS + N_STATS)]), np.concatenate([x, _statistics(text, words, count)])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # one row a feature

    def margins(self, at: np.ndarray, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The margin of each text, whose features begin at begin[k], and the sum of its features' factors."""
        vx = self.factors[at] * x[:, None]
        total = np.add.reduceat(vx, begin, axis=0)
        single = np.add.reduceat((vx * vx).sum(1), begin)
        return self.bias + np.add.reduceat(self.linear[at] * x, begin) + 0.5 * ((total * total).sum(1) - single), total

    def scores(self, at: np.ndarray, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return _logistic(self.margins(at, x, begin)[0])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(at) for at, _ in found])
    return np.concatenate([at for at, _ in found]), np.concatenate([x for _, x in found]), np.cumsum(size) - size


def fit(rows: list[tuple[str, int]], rank: int = 8, epochs: int = 12, rate: float = 0.05, batch: int = 32) -> Machine:
    """AdaGrad on the logistic loss, a step for each batch of texts, in a fixed random order."""
    rng = np.random.default_rng(5)
    size = BUCKETS + N_STATS
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    n1 = sum(y for _, y in rows)
    if not 0 < n1 < len(rows):
        return Machine(0.0, np.zeros(size), np.zeros((size, rank)))
    cache: dict[str, int] = {}
    data, label = [features(t, cache) for t, _ in rows], np.array([y for _, y in rows], float)
    gl, gv, gb = np.full(size, 1e-2), np.full((size, rank), 1e-2), 1e-2
    order, batches = rng.permutation(len(data)), []
    for k in range(0, len(order), batch):
        some = order[k : k + batch]
        at, x, begin = _joined([data[i] for i in some])
        own, where = np.unique(at, return_inverse=True)
        text = np.repeat(np.arange(len(some)), np.diff(np.append(begin, len(at))))
        batches.append((at, x, begin, own, where, text, label[some]))
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            at, x, begin, own, where, text, y = batches[k]
            z, total = m.margins(at, x, begin)
            g = _logistic(z) - y
            gb += (g * g).sum()
            m.bias -= rate * g.sum() / np.sqrt(gb)
            gx, v = g[text] * x, m.factors[own]
            d = np.bincount(where, gx, len(own)) + 1e-5 * m.linear[own]
            squares = np.bincount(where, gx * x, len(own))
            dv = np.stack([np.bincount(where, gx * total[text, f], len(own)) for f in range(rank)], 1) - v * squares[:, None] + 1e-4 * v
            gl[own] += d * d
            m.linear[own] -= rate * d / np.sqrt(gl[own])
            gv[own] += dv * dv
            m.factors[own] -= rate * dv / np.sqrt(gv[own])
    return m


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 3000, max_bytes: int = 16_384) -> Machine:
    drawn = bounded_sample(docs, labels, label, per_class, max_bytes)
    machine = fit(drawn)
    machine.bias += class_shift(labels, label, drawn)
    return machine


def score(spark: SparkSession, machine: Machine, text: Column) -> Column:
    """The quality of each whole text, 0 to 1."""
    shared = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, int] = {}
        for texts in batches:
            out = []
            for k in range(0, len(texts), 64):
                out.append(shared.value.scores(*_joined([features(t, cache) for t in texts.iloc[k : k + 64]])))
            yield pd.Series(np.concatenate(out) if out else [], dtype=float)

    return run(text)
