"""Benchmark decontamination by pigeonhole edit matching.

Method: a test item of n normalised characters, with a space at either end so that it begins and ends with a word, may
differ by k = floor(n * `rate`) edits; cut into k + 1 pieces, at least one piece of any match occurs unchanged.  All pieces of a block of items form one Aho-Corasick automaton, which
finds the piece hits in a single pass over each whole text; each hit fixes where in the text the item can lie, and
Myers' bit-parallel algorithm verifies the edit distance there, and from the match's end backwards tells its start.

Normalising folds case and turns every run of other characters than letters and digits into one space.  Test items
are read in blocks of `block_bytes`, each block broadcast on its own, so what is broadcast has a bound whatever the
size of the benchmark; each block takes a pass over the documents.  Defined results: null and empty texts and items
match nothing; the edits of an item follow from its length alone, so items under 1 / `rate` characters have none; of
several places of an item in one document the one of least distance, then the one that ends first, is told, with its
shortest extent; repeated rows and items give a result each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import remove, stored

_other = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _other.sub(" ", text.casefold()).strip() if text else ""


def myers(pattern: str, text: str, most: int, anchored: bool = False) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any part of the text, and where that part first ends; None if above `most`.
    anchored: only parts that begin where the text begins."""
    n = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high, enter = (1 << n) - 1, 1 << (n - 1), int(anchored)
    up, down, score, best = full, 0, n, (n, 0) if n <= most else None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (~(xh | up) & full), up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1 | enter) & full, (mh << 1) & full  # not anchored: nothing enters below, a match may begin anywhere
        up, down = mh | (~(xv | ph) & full), ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Index:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = []  # id, text, edits
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            text = normalise(raw)
            if not text:
                continue
            k, at = int(len(text) * rate), len(self.items)
            text = f" {text} "
            self.items.append((item_id, text, k))
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces.setdefault(text[a:b], []).append((at, a))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best place of each item; places count normalised characters."""
        text = normalise(raw)
        if not text or not self.items:
            return []
        text = f" {text} "
        best: dict[int, tuple[int, int]] = {}  # distance and end
        tried = set()
        for end, (length, uses) in self.automaton.iter(text):
            for at, offset in uses:
                _, item, k = self.items[at]
                start = end + 1 - length - offset
                if at in best and best[at] <= (0, start + len(item)):
                    continue
                if 0 <= start and text.startswith(item, start):
                    best[at] = (0, start + len(item))
                    continue
                if k == 0 or (at, start) in tried:
                    continue
                tried.add((at, start))
                low = max(0, start - k)
                found = myers(item, text[low : start + len(item) + k], k)
                if found and (at not in best or (found[0], low + found[1]) < best[at]):
                    best[at] = (found[0], low + found[1])
        out = []
        for at, (d, e) in sorted(best.items()):
            item_id, item, _ = self.items[at]
            s = e - (len(item) if d == 0 else myers(item[::-1], text[max(0, e - len(item) - d) : e][::-1], d, anchored=True)[1])
            out.append((item_id, d, s, max(s, e - 2)))  # without the spaces at either end
        return out

    def holds_any(self, raw: str | None) -> bool:
        """Whether `matches` has a place; ends at the first that is verified."""
        text = normalise(raw)
        if not text or not self.items:
            return False
        text, tried = f" {text} ", set()
        for end, (length, uses) in self.automaton.iter(text):
            for at, offset in uses:
                _, item, k = self.items[at]
                start = end + 1 - length - offset
                if 0 <= start and text.startswith(item, start):
                    return True
                if k and (at, start) not in tried:
                    tried.add((at, start))
                    if myers(item, text[max(0, start - k) : start + len(item) + k], k):
                        return True
        return False


def _search(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, rate)
        for batch in batches:
            rows = []
            for k, t in enumerate(batch.column("__text").to_pylist()):
                rows += [(k, *m) for m in index.matches(t)]
            if rows:
                at, item, distance, start, end = zip(*rows, strict=True)
                kept = batch.take(pa.array(at, pa.int64()))
                names = [n for n in batch.schema.names if n != "__text"]
                yield pa.RecordBatch.from_arrays([*(kept.column(n) for n in names), pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                                                 [*names, "item_id", "distance", "start", "end"])

    return run


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The test items, a bounded number of bytes at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    total = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.orderBy("i", "t").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_bytes: int = 4 << 20,
            id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start and end for every test item that a document holds."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    out = None
    for items in blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        part = src.mapInArrow(_search(shared, rate), f"doc_id {kind}, item_id long, distance int, start long, end long")
        out = part if out is None else out.unionByName(part)
    return out


def _holds_any(shared, rate: float):
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(shared.value, rate)
        for texts in batches:
            yield pd.Series([index.holds_any(t) for t in texts], dtype=bool)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_bytes: int = 4 << 20,
          text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs whose text holds no test item.  A worker holds one block of items at a time: between two blocks the
    rows that are left are written to the shared folder, and what a block rejects isn't looked at again.  Items of equal
    text are looked for once."""
    left, before, shared = docs, None, None
    once = benchmark.groupBy(F.col(item_text_col).alias("t")).agg(F.min(item_col).alias("i"))
    for items in blocks(once, "i", "t", block_bytes):
        if shared is not None:
            left, path = stored(left, "clean")
            shared.destroy()
            if before:
                remove(docs.sparkSession, before)
            before = path
        shared = docs.sparkSession.sparkContext.broadcast(items)
        left = left.filter(~_holds_any(shared, rate)(F.col(text_col)))
    return left


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_bytes: int = 4 << 20,
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"):
    """A column that tells whether a text holds any test item, for filters; a benchmark of more than one block, whose
    items every worker would hold at once, is an error (`clean` takes any size)."""
    first, *more = blocks(benchmark, item_col, item_text_col, block_bytes)
    if more:
        raise ValueError(f"the test items take more than {block_bytes} bytes; use clean")
    return _holds_any(docs.sparkSession.sparkContext.broadcast(first), rate)(F.col(text_col))
