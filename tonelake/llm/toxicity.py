"""Toxicity by compression distance.

Method: two zstandard dictionaries are trained, one on ordinary text and one on those runs of toxic text that toxic
documents hold far more often than ordinary ones.  A window is a run of letters, lower-cased and tiled so that the coder
has something to gain; it is compressed under either dictionary (raw content, so that no entropy table favours one), and
the two compressed lengths are compared.  Thresholds are calibrated for each window length: each (length, ordinary length,
toxic length) gets the log ratio of how often toxic and ordinary training documents hold such a window.  A document's
score is a logistic function of its largest ratio and of the sum over all its windows above the threshold.

Windows of 32 to 128 bytes of running text were tried first; with one toxic word in about sixty their lengths say too
little (the README has the figures), so a window ends where its word ends.

Ratios and the logistic function are fitted on documents that the step before didn't see: the sample is cut into `folds`
parts, each part is measured by dictionaries of the others, and the final dictionaries are trained on all.

Fitting runs on the driver over a sample bounded by `per_class` and `max_bytes`; scoring covers every whole text.
The sample may hold another share of either class than the training labels, so at every size the logarithm of the odds
of toxic among all training labels, over the odds among the rows drawn, is added to the fitted constant (zero where all
are drawn).  What zstandard trains on is bounded by parameters too: a toxic run counts as often as toxic documents hold
it, up to `toxic_repeats`, an ordinary one up to `ordinary_repeats`, and of the ordinary ones at most `ordinary_runs` are
taken.  Runs of `LONGEST` bytes and more share one row of the calibration table, as single long lengths are rare.
Defined results: null and empty texts, and texts without letters, get the lowest score there is; repeated rows
get equal scores; without labels of both classes every score is 0.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.common import bounded_sample, class_shift

LEVEL, TILES, LONGEST = 12, 4, 24
CACHE = 60_000  # windows kept in each of two generations; bounds a worker's memory, changes no result
windows_of = re.compile(r"[^\W\d_]+").findall


def _windows(text: str | None) -> set[str]:
    return set(windows_of(text.lower())) if text else set()


def _tile(word: str) -> bytes:
    return ((" " + word) * TILES + " ").encode("utf-8", "surrogatepass")


def _dictionary(samples: list[bytes], size: int) -> bytes:
    import zstandard

    random.Random(7).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the samples themselves
        return b"".join(dict.fromkeys(samples))[-size:] or b" " * 8


def _spread(samples: list[bytes], most: int) -> list[bytes]:
    """At most so many samples, from all over the list."""
    return samples if len(samples) <= most else random.Random(3).sample(samples, most)


def evidence(toxic: int, ordinary: int, n_toxic: int, n_ordinary: int) -> float:
    """The G statistic of a window held by so many of the documents of either class."""
    held, n = toxic + ordinary, n_toxic + n_ordinary
    term = lambda k, expected: 2 * k * math.log(k / expected) if k else 0.0
    return (term(toxic, held * n_toxic / n) + term(ordinary, held * n_ordinary / n)
            + term(n_toxic - toxic, (n - held) * n_toxic / n) + term(n_ordinary - ordinary, (n - held) * n_ordinary / n))


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    ratio: dict[tuple[int, int, int], float] = field(default_factory=dict)
    weights: tuple[float, float, float] = (-30.0, 0.0, 0.0)


class Scorer:
    def __init__(self, model: Model):
        import zstandard

        self.model, self.young, self.old, self.coders = model, {}, {}, []
        for raw in (model.ordinary, model.toxic):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def cell(self, word: str) -> tuple[int, int, int]:
        """The window's length, and its compressed lengths under the ordinary and the toxic dictionary."""
        raw = _tile(word)
        return min(len(raw) // TILES, LONGEST), *(len(c.compress(raw)) for c in self.coders)

    def ratio(self, word: str) -> float:
        r = self.young.get(word)
        if r is None:
            r = self.old.get(word)
            if r is None:
                r = self.model.ratio.get(self.cell(word), 0.0)
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[word] = r
        return r

    def score(self, text: str | None) -> float:
        w = self.model.weights
        a, b = features(map(self.ratio, _windows(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, w[0] + w[1] * a + w[2] * b))))


def features(ratios: Iterable[float]) -> tuple[float, float]:
    """The largest log ratio above the threshold of 1, and the logarithm of the sum of all others above it."""
    above = [r for r in ratios if r > 1]
    most = max(above, default=0.0)
    return most, math.log1p(math.fsum(above) - most)


@dataclass(frozen=True)
class Bounds:
    """What the dictionaries are trained on: their sizes in bytes, how often a run counts, how many ordinary runs there
    are at most, and the G statistic from which a toxic run is a sample."""

    toxic_size: int = 8192
    ordinary_size: int = 112_640
    toxic_repeats: int = 50
    ordinary_repeats: int = 8
    ordinary_runs: int = 300_000
    least_evidence: float = 8.0


def _train(rows: list[tuple[str, int]], bounds: Bounds) -> Model:
    """Dictionaries from labelled texts."""
    count, n = {0: Counter(), 1: Counter()}, Counter(y for _, y in rows)
    for t, y in rows:
        count[y].update(_windows(t))
    # in sorted order, so that a fit doesn't depend on how Python hashes strings
    telling = [(w, k) for w, k in sorted(count[1].items())
               if k >= 2 and k * n[0] > 8 * count[0][w] * n[1] and evidence(k, count[0][w], n[1], n[0]) >= bounds.least_evidence]
    toxic = [_tile(w) for w, k in telling for _ in range(min(k, bounds.toxic_repeats))]
    ordinary = [f" {w} ".encode("utf-8", "surrogatepass") for w, k in sorted(count[0].items()) for _ in range(min(k, bounds.ordinary_repeats))]
    return Model(_dictionary(_spread(ordinary, bounds.ordinary_runs), bounds.ordinary_size), _dictionary(toxic, bounds.toxic_size))


def _ratios(cells: list[tuple[Counter, int]]) -> dict[tuple[int, int, int], float]:
    seen, n = {0: Counter(), 1: Counter()}, {y: sum(k == y for _, k in cells) + 1 for y in (0, 1)}
    for own, y in cells:
        seen[y].update(set(own))
    return {c: math.log((k + 0.05) / n[1]) - math.log((seen[0][c] + 0.5) / n[0]) for c, k in seen[1].items()}


def fit(rows: list[tuple[str, int]], bounds: Bounds = Bounds(), folds: int = 4, shift: float = 0.0) -> Model:
    """shift: added to the fitted constant."""
    distinct = list(dict(rows).items())
    random.Random(11).shuffle(distinct)
    if len({y for _, y in distinct}) < 2:
        return Model()
    parts = [distinct[k::folds] for k in range(folds)]
    others = [[row for j, part in enumerate(parts) if j != k for row in part] for k in range(folds)]
    if any(len({y for _, y in rest}) < 2 for rest in others):
        parts, others = [distinct], [distinct]
    measured = []
    for own, rest in zip(parts, others, strict=True):
        scorer = Scorer(_train(rest, bounds))
        cell = {w: scorer.cell(w) for w in sorted(set().union(*(_windows(t) for t, _ in own)))}
        measured.append([(Counter(cell[w] for w in _windows(t)), y) for t, y in own])
    x, y = [], []
    for k, own in enumerate(measured):
        ratio = _ratios([row for j, part in enumerate(measured) if j != k or len(measured) == 1 for row in part])
        x += [(1.0, *features(r for c, n in cells.items() for r in [ratio.get(c, 0.0)] * n)) for cells, _ in own]
        y += [label for _, label in own]
    x, y, w = np.array(x), np.array(y, float), np.zeros(3)
    for _ in range(30):  # Newton steps of a logistic regression with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.05 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), grad)
    model = _train(distinct, bounds)
    model.ratio = _ratios([row for part in measured for row in part])
    model.weights = (float(w[0]) + shift, float(w[1]), float(w[2]))
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 4000, max_bytes: int = 16_384) -> Model:
    drawn = bounded_sample(docs, labels, label, per_class, max_bytes)
    return fit(drawn, shift=class_shift(labels, label, drawn))


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """The toxicity of each whole text, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value) if shared.value.toxic else None
        for texts in batches:
            yield pd.Series([scorer.score(t) if scorer else 0.0 for t in texts], dtype=float)

    return run(text)
