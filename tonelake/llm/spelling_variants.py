"""Spelling variants by two-dimensional range reporting on wavelet trees.

Method: two words differ by one code point exactly if for some place p they share what comes before p and what comes
after it.  In a set of words sorted forwards, all words with the same beginning are an interval, and sorted by their
reversals all with the same ending are one.  A wavelet tree over the permutation from forward to reverse ranks reports
the words that lie in both intervals.  Where the lengths are equal, each word asks about every place p (before p, after
p) and gets the words that differ there; a word of one more code point asks about every p that it might lose, which
gets the shorter word, if there is one.

Cells: with m the length of the shorter word and a = m // 2, a difference at p >= a leaves the first a code points
alone, another the last m - a.  So each word goes to four cells: as the shorter or equal word (m its own length) and as
the longer one (m one less), by its beginning and by its end, and a pair is found in one of them alone.  Cells are
indexed and asked independently; a large one is dealt into parts, each pair of parts a unit of work of bounded size,
so a frequent beginning or end is many tasks.  From a unit leave per word its number of near words and the best of them,
not pairs.  Roots are found by pointer doubling over the words that have a form.

Defined results: null and empty texts have no words, and null ids count as empty text in the damage; repeated rows
count again; ties go to the word that comes first in code-point order; a table without words gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import ascii_lower, durable, in_blocks, remove, stored

#: Queries that are looked up together, and code points that small units are gathered to: they bound a worker's memory.
BATCH, UNITS = 1 << 18, 1 << 20


class WaveletTree:
    """A permutation in levels of bits, most significant first; each level is stably sorted by the bits above it."""

    def __init__(self, values: np.ndarray):
        self.n, self.bits = len(values), max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros, now = [], [], values.astype(np.int64)
        for k in range(self.bits - 1, -1, -1):
            bit = (now >> k) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for each value in [least, most) at a position in [lo, hi), for all queries at once."""
        q, left = np.arange(len(lo)), np.zeros(len(lo), np.int64)  # left: the smallest value of the node
        for k, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            one_lo, one_hi = ones[lo], ones[hi]
            middle, end = left + (1 << k), left + (2 << k)
            down = (hi - lo > one_hi - one_lo) & (least[q] < middle) & (most[q] > left)
            up = (one_hi > one_lo) & (least[q] < end) & (most[q] > middle)
            lo, hi, q, left = (np.concatenate(x) for x in (
                ((lo - one_lo)[down], (zeros + one_lo)[up]), ((hi - one_hi)[down], (zeros + one_hi)[up]), (q[down], q[up]), (left[down], middle[up])))
        return q, left


def intervals(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of code points: their order, and for each row and prefix length the interval of that order that shares it."""
    n, width = codes.shape
    order = np.lexsort(codes.T[::-1])
    changed = np.zeros((n + 1, width + 1), bool)
    changed[1:n, 1:] = np.logical_or.accumulate(codes[order[1:]] != codes[order[:-1]], axis=1)
    changed[0] = changed[n] = True
    place = np.arange(n + 1)[:, None]
    first = np.maximum.accumulate(np.where(changed, place, 0), axis=0)[:n]
    last = np.minimum.accumulate(np.where(changed, place, n)[::-1], axis=0)[::-1][1:]
    lo, hi = np.empty_like(first), np.empty_like(last)
    lo[order], hi[order] = first, last
    return order, lo, hi


def near_in_units(words: list[str], unit: np.ndarray, indexed: np.ndarray, asking: np.ndarray, m: int, by_prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asking word, indexed word) of one unit that differ in one code point, for words of length m and m + 1.

    Indexed are the words of length m among `indexed`; words of length m ask for those of their length, words of length
    m + 1 for those that lack one of their code points.  by_prefix: differences at m // 2 and after, else those before.
    Many units are one index: the unit's number stands before the code points in both orders.
    """
    n, half = len(words), m // 2
    size = np.fromiter(map(len, words), np.int64, n)
    own = (size == m) & indexed
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not own.any():
        return us[0], vs[0]
    codes = np.frombuffer("".join(w.ljust(m + 1, "\0") for w in words).encode("utf-32-le"), "<i4").reshape(n, m + 1)
    back = codes[:, ::-1].copy()
    back[size == m] = np.roll(back[size == m], -1, axis=1)  # the padding comes last here as well
    first = unit.astype(np.int32)[:, None]
    order, lo, hi = intervals(np.concatenate((first, codes), axis=1))
    reverse, lo_back, hi_back = intervals(np.concatenate((first, back), axis=1))
    # from intervals over all words to intervals over the indexed ones
    before, before_back = np.concatenate(([0], np.cumsum(own[order]))), np.concatenate(([0], np.cumsum(own[reverse])))
    forward, backward = order[own[order]], reverse[own[reverse]]
    rank = np.empty(n, np.int64)
    rank[backward] = np.arange(len(backward))
    tree = WaveletTree(rank[forward])

    for equal, length in ((True, m), (False, m + 1)):
        some = np.flatnonzero(asking & (size == length))
        for p in range(half if by_prefix else 0, length if by_prefix else half):
            # of equal neighbours the first alone may be lost, so a shorter word is found once
            who = some if equal or not p else some[codes[some, p] != codes[some, p - 1]]
            a, b, c, d = before[lo[who, p + 1]], before[hi[who, p + 1]], before_back[lo_back[who, length - p]], before_back[hi_back[who, length - p]]
            alone = own[who].astype(np.int64) if equal else 0  # an indexed word of this length is in its own intervals
            open_ = (b - a > alone) & (d - c > alone)
            who, a, b, c, d = who[open_], a[open_], b[open_], c[open_], d[open_]
            for at in range(0, len(who), BATCH):
                part = slice(at, at + BATCH)
                q, value = tree.report(a[part], b[part], c[part], d[part])
                u, v = who[part][q], backward[value]
                us.append(u[u != v]), vs.append(v[u != v])
    return np.concatenate(us), np.concatenate(vs)


def best_of_units(words: list[str], n: np.ndarray, unit: np.ndarray, part: np.ndarray, a: np.ndarray, b: np.ndarray, m: int, by_prefix: bool) -> list[tuple]:
    """(word, near, best_n, best) for each word that has near words in its unit, where part a meets part b."""
    us, vs = [], []
    size = np.fromiter(map(len, words), np.int64, len(words))
    for asking, indexed in ((part == a, part == b), ((part == b) & (a != b), (part == a) & (a != b))):
        u, v = near_in_units(words, unit, indexed, asking, m, by_prefix)
        us += [u, v[size[u] > m]]  # equal lengths are found from both sides, others from the longer word alone
        vs += [v, u[size[u] > m]]
    u, v = np.concatenate(us), np.concatenate(vs)
    if not len(u):
        return []
    alphabetical = np.empty(len(words), np.int64)
    alphabetical[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((alphabetical[v], -n[v], u))
    u, v = u[order], v[order]
    first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
    near = np.diff(np.append(first, len(u)))
    return [(words[i], int(k), int(n[j]), words[j]) for i, j, k in zip(u[first], v[first], near, strict=True)]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, a, b) to the partial results of their units, of which small ones are worked on together."""
    kinds = {"word": pa.string(), "n_near": pa.int64(), "best_n": pa.int64(), "best": pa.string()}
    rows, unit, now, kind = [], -1, None, None

    def worked() -> Iterator[pa.RecordBatch]:
        if rows:
            words, n, part, a, b, units = zip(*rows, strict=True)
            found = best_of_units(words, *[np.array(x, np.int64) for x in (n, units, part, a, b)], *kind)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds.values(), strict=True)], list(kinds))
            rows.clear()

    for batch in batches:
        for m, by_prefix, cell, a, b, word, n, part in zip(*[batch.column(c).to_pylist() for c in ("m", "by_prefix", "cell", "a", "b", "word", "n", "part")], strict=True):
            if now != (cell, a, b):
                if kind != (m, by_prefix) or len(rows) >= UNITS // (m + 1):
                    yield from worked()
                now, kind, unit = (cell, a, b), (m, by_prefix), unit + 1
            rows.append((word, n, part, a, b, unit))
    yield from worked()


def word_counts(docs: DataFrame, least_length: int = 7, least_n: int = 2, damage: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of runs of Latin letters of at least `least_length` code points that occur `least_n` times or more.

    A-Z are lower-cased.  Where `damage` divides crc32("id:run"), the run loses the code point at crc32 % length."""
    run = F.explode(F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0)))
    own = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), run.alias("run"))
    h, size = F.crc32(F.concat("i", F.lit(":"), "run").cast("binary")), F.length("run")
    lost = F.concat(F.substring("run", F.lit(1), (F.col("h") % size).cast("int")), F.substring("run", (F.col("h") % size + 2).cast("int"), size))
    word = F.when(F.col("h") % damage == 0, lost).otherwise(F.col("run"))
    return (own.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n))


def in_cells(counts: DataFrame) -> DataFrame:
    """counts (word, n) with m, by_prefix and cell: four rows per word."""
    def cell(m, by_prefix: bool):
        half = F.floor(m / 2).cast("int")
        part = F.substring("word", F.lit(1), half) if by_prefix else F.substring("word", (F.length("word") - (m - half) + 1).cast("int"), (m - half).cast("int"))
        return F.struct(m.cast("int").alias("m"), F.lit(by_prefix).alias("by_prefix"), part.alias("part"))

    cells = F.array(*[cell(m, side) for m in (F.length("word"), F.length("word") - 1) for side in (True, False)])
    return (counts.withColumn("c", F.explode(cells)).filter("c.m > 0")
            .select("word", "n", "c.m", "c.by_prefix", F.concat_ws(":", F.col("c.m").cast("string"), F.col("c.by_prefix").cast("string"), "c.part").alias("cell")))


def near_words(counts: DataFrame, block: int = 1 << 19) -> DataFrame:
    """(word, n_near, best_n, best): for each word that has near words how many, and the most frequent of them.

    block: how many code points a part of a cell has, so long words make small parts."""
    words = F.greatest(F.lit(1), F.floor(F.lit(block) / (F.col("m") + 1)))
    units = in_blocks(in_cells(counts), "cell", F.col("word"), words)
    ordered = units.select("m", "by_prefix", "cell", "a", "b", "word", "n", "part").repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")
    found = ordered.mapInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form): where following forms ends.  Each round doubles the steps taken."""
    spark = forms.sparkSession
    now, path = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead, new = stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        remove(spark, path)
        now, path = ahead.select("word", "root"), new
        if ahead.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, times: int = 10, block: int = 1 << 19, **counting) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word that `word_counts` gives.

    form: the most frequent near word, if it occurs `times` times as often; root: the last form that forms lead to."""
    counts = durable(word_counts(docs, **counting), "words")
    own = counts.join(near_words(counts, block), "word", "left")
    has = F.col("best_n") >= times * F.col("n")
    own = durable(own.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    roots = last_forms(own.filter("form IS NOT NULL"))
    return own.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
