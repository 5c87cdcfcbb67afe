"""Near-duplicates by SimHash with covering locality-sensitive hashing.

Method: whole texts are lower-cased (A-Z), cut at ASCII white space, and each run of `width` words, repeats included,
is hashed with XXH64 (seed 42); a fingerprint bit is set if more than half of the hashes have it.  For radius r, every
bit position gets a vector of r + 1 bits, and each of the 2^(r+1) - 1 nonzero vectors v gives a mask of the positions
whose vector has an odd inner product with v.  Of any r differing positions the vectors can't span all r + 1
dimensions, so some v is orthogonal to all of them and that mask keeps none of the differing bits: every pair within
the radius collides in some table.  The vectors are dealt evenly, so each mask keeps about half of the bits.

Equal fingerprints are one class from the start.  Classes that share a bucket are compared in blocks: a bucket of n
classes is dealt into n / `block` parts by hash and each pair of parts is one unit of work, so no task holds a whole
large bucket; from a unit only a spanning forest of its links leaves, not its pairs, and of these only pairs that
share no bucket of an earlier table.  Components come from rounds of star contraction over these links.

`near_copies` is for pipelines: what the method above links is a candidate, and an exact check by the Jaccard similarity
of sets of five-word shingles follows.  An exact join of these sets finds what fingerprints can't tell: two sets that
are similar enough share one of the first shingles of both, rare ones first, and such pairs are tried too.

Defined results: null and empty texts have no words and so the zero fingerprint, which links like any other; fewer
words than `width` are one shingle; repeated rows keep their own rows; ids may be repeated, and null ids come last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tonelake.llm.common import (
    FEW_TEXTS, SHUFFLES_REMOVED, ascii_lower, bucketed, connected_components, durable, hook, in_blocks, remove, settings, smallest_reached, stored, unsent,
)

ALL = (1 << 64) - 1


def _votes(hashes: list[int], votes: np.ndarray) -> None:
    votes += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(votes: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprint_of(text: bytes | None, width: int) -> int:
    import xxhash

    words = text.lower().split() if text else []  # for bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    joined, k = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    n, votes = len(words) - k + 1, np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # a very long text is counted piece by piece
        last = min(at + 65_536, n)
        _votes([digest(joined[a:b], 42) for a, b in zip(starts[at:last].tolist(), ends[at + k - 1 : last + k - 1].tolist(), strict=True)], votes)
    return _majority(votes, n)


def fingerprint(text: Column, width: int = 4) -> Column:
    """The SimHash of each whole text as a (signed) long."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t, width) for t in texts], np.uint64).view(np.int64))

    return run(text.cast("binary"))


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks; any `radius` positions are all outside one of them at least.

    Up to radius 5 the vectors are dealt to the positions in turn.  At radius 6 there are more vectors than positions;
    those with the highest bit set are taken, so that every mask keeps 32 of 64 bits at least and no bucket is large by rule.
    """
    vectors = (1 << (radius + 1)) - 1
    if vectors > 2 * bits:
        raise ValueError("more masks than twice the bits would leave some of them too few bits")
    of_bit = [1 + k % vectors for k in range(bits)] if vectors <= bits else [(1 << radius) + k for k in range(bits)]
    return [sum(1 << k for k in range(bits) if (of_bit[k] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _units(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], settle) -> Iterator[pa.RecordBatch]:
    """Hands `settle` the rows of whole units, which come sorted by their first three columns (bucket, a, b)."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]))
        rows = np.concatenate(held)
        edge = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1)))
        yield from settle(rows[: edge[-1]], edge[:-1])
        held = [rows[edge[-1] :]]
    if held and len(held[0]):
        yield from settle(held[0], np.zeros(1, np.int64))


def _first_shared(masks: list[int], x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether no table before t has the pair of fingerprints in one bucket."""
    differ, first = (x ^ y).view(np.uint64), np.ones(len(x), bool)
    for k in range(int(t.max(initial=0))):
        first &= (t <= k) | (differ & np.uint64(masks[k]) != 0)
    return first


def _compare(radius: int, masks: list[int]):
    def settle(rows: np.ndarray, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        size, us, vs = np.diff(np.append(edge, len(rows))), [], []
        pairs = edge[size == 2]  # most units hold two classes: all at once
        if len(pairs):
            x, y = rows[pairs, 4], rows[pairs + 1, 4]
            near = (np.bitwise_count((x ^ y).view(np.uint64)) <= radius) & ((rows[pairs, 1] == rows[pairs, 2]) | (rows[pairs, 3] != rows[pairs + 1, 3]))
            near[near] = _first_shared(masks, x[near], y[near], rows[pairs, 5][near])
            us.append(x[near]), vs.append(y[near])
        for s, n in zip(edge[size > 2], size[size > 2], strict=True):
            fp, part, a, b, t = np.ascontiguousarray(rows[s : s + n, 4]), rows[s : s + n, 3], rows[s, 1], rows[s, 2], rows[s, 5]
            values, one, two = fp.view(np.uint64), np.flatnonzero(part == a), np.flatnonzero(part == b)
            root, step = np.arange(n), max(1, 2_000_000 // max(len(two), 1))
            for at in range(0, len(one), step):
                some = one[at : at + step]
                i, j = np.nonzero(np.bitwise_count(values[some][:, None] ^ values[two][None, :]) <= radius)
                i, j = some[i], two[j]
                i, j = i[i != j], j[i != j]
                used = hook(root, i, j)
                i, j = i[used], j[used]
                first = _first_shared(masks, fp[i], fp[j], np.full(len(i), t))
                us.append(fp[i[first]]), vs.append(fp[j[first]])
        if sum(map(len, us)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return lambda batches: _units(batches, ("bucket", "a", "b", "part", "fp", "t"), settle)


def in_tables(items: DataFrame, masks: list[int]) -> DataFrame:
    """items (fp, ...) with the number t of each table and the bucket there."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("bucket")) for t, m in enumerate(masks)])
    return items.withColumn("place", F.explode(tables)).select(*items.columns, "place.t", "place.bucket")


def fingerprint_links(distinct: DataFrame, radius: int = 4, block: int = 2048) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) within the radius, enough to connect what is connected."""
    masks = covering_masks(radius)
    units = in_blocks(in_tables(distinct, masks), "bucket", F.col("fp"), block)
    ordered = units.select("bucket", "a", "b", "part", "fp", "t").repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return ordered.mapInArrow(_compare(radius, masks), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long) and component_id: the smallest doc_id that can be reached over links, itself included."""
    own = durable(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), width).alias("fp")), "fingerprints")
    distinct = durable(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    named = smallest_reached(distinct, durable(fingerprint_links(distinct.select("fp"), radius), "links"), "fp", "first_id")
    return own.join(unsent(named), "fp").select("doc_id", "fp", "component_id")


#: Longs of the sketch of a set of shingles; how many frequent shingles are told to all tasks at most.
SKETCH, FREQUENT = 8, 1 << 16
#: Powers of an odd number and of its inverse, modulo 2^64, for as many bytes as the longest piece of text had so far.
_odd = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {_odd: np.ones(1, np.uint64), pow(_odd, -1, 1 << 64): np.ones(1, np.uint64)}


def _powers_of(x: int, n: int) -> np.ndarray:
    if len(_powers[x]) < n:
        _powers[x] = np.multiply.accumulate(np.append(np.uint64(1), np.full(2 * n, x, np.uint64)))
    return _powers[x][:n]


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of `size` words; fewer words are one shingle, and no words none.

    A shingle is a stretch of the text with single spaces, and its polynomial a difference of two running sums.
    """
    words = text.lower().split() if text else []
    found, n = [np.zeros(0, np.uint64)], max(len(words) - size + 1, int(bool(words)))
    for at in range(0, n, 65_536):  # a very long text is taken piece by piece
        c = np.frombuffer(b" ".join(words[at : at + 65_536 + size - 1]), np.uint8)
        ends = np.append(np.flatnonzero(c == 32), len(c))
        here = max(len(ends) - size + 1, 1)
        a, b = np.append(0, ends[:-1] + 1)[:here], ends[-here:]
        total = np.append(np.uint64(0), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * _powers_of(_odd, len(c))))
        h = (total[b] - total[a]) * _powers_of(pow(_odd, -1, 1 << 64), len(c) + 1)[a]
        for shift, by in ((32, 0xD6E8FEB86659FD93), (29, 0xC2B2AE3D27D4EB4F), (32, 0x165667B19E3779F9)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        found.append(np.unique(h ^ (h >> np.uint64(31))))
    return np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]


def wide_sketch(h: np.ndarray) -> np.ndarray:
    """The parities of the shingles that fall on each of 2^k bits, two a shingle and 64 * SKETCH at least, as longs."""
    bits = max(64 * SKETCH, 1 << (2 * len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(sketch: np.ndarray, longs: int) -> np.ndarray:
    """The sketch of the same set on fewer bits."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, longs), axis=0)


def wide_apart(similarity: float):
    """Whether two sets of n and m shingles can't be similar, since their wide sketches differ in more bits than such
    sets do in shingles."""
    differ = (1 - similarity) / (1 + similarity)

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        out = np.zeros(len(x), bool)
        for k, (a, b) in enumerate(zip(x, y, strict=True)):
            a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            least = min(len(a), len(b))
            out[k] = np.bitwise_count(folded(a, least) ^ folded(b, least)).sum() > differ * (n[k] + m[k]) + 1e-6
        return pd.Series(out)

    return run


def _frequent(items: DataFrame, text: Column, size: int) -> np.ndarray:
    """Shingles that many texts have, rarest first: those of three or more of every eighth item, FREQUENT at most.  They
    only tell in which order shingles are looked at; what is found doesn't depend on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t.as_py(), size).view(np.int64))], ["s"])

    eighth = items.filter(F.pmod(F.xxhash64("item"), F.lit(8)) == 0).select(text.cast("binary").alias("t"))
    often = eighth.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter("n > 2")
    return often.orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toArrow().column(0).to_numpy()[::-1].view(np.uint64)


def _marks(text: Column, size: int, similarity: float, frequent: np.ndarray, width: int) -> Column:
    """Of each text its fingerprint, and of its set of shingles the size n, a sketch, a wide sketch, and its first shingles.

    All sets are looked at in one order: by hash, the frequent shingles after all others.  Two sets of Jaccard similarity
    s have s * n shingles of either in common at least, so they share one of the first n - s * n + 1 of both.  A bit of
    the sketch is the parity of the shingles that fall on it, so two sketches differ in no more bits than the sets in
    shingles.  The wide one has two bits a shingle at least, so it also tells long texts apart; the other is its fold.
    """
    order = np.argsort(frequent)
    known, place = frequent[order], order + 1

    @F.pandas_udf("struct<n long, fp long, sketch array<long>, wide binary, first array<long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n, sketches, wide, first = [], [], [], []
            for t in texts:
                h = shingle_hashes(t, size)
                n.append(len(h))
                bits = wide_sketch(h)
                wide.append(bits.tobytes())
                sketches.append(folded(bits, SKETCH).view("<i8"))
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, place[at], 0), kind="stable")]
                first.append(h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1].view(np.int64))
            fp = np.array([fingerprint_of(t, width) for t in texts], np.uint64).view(np.int64)
            yield pd.DataFrame({"n": n, "fp": fp, "sketch": sketches, "wide": wide, "first": first})

    return run(text.cast("binary"))


def _propose(similarity: float, every: bool):
    """Pairs of items that may be similar: in each bucket every item with the nearest and the first of the items before
    it, or with `every` one before it that has another head.  Sizes and sketches only rule out what can't be similar."""
    part, item, rank, size_of, head, sketch = 3, 4, 5, 6, 7, slice(8, 8 + SKETCH)
    differ = (1 - similarity) / (1 + similarity)

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The bits in which sketches differ, or -1 where the two sets can't be similar."""
        bits = sum(np.bitwise_count((x[..., k] ^ y[..., k]).view(np.uint64)).astype(np.int16) for k in range(sketch.start, sketch.stop))
        n, m = x[..., size_of], y[..., size_of]
        return np.where((bits <= differ * (n + m) + 1e-6) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6) & (x[..., head] != y[..., head]), bits, np.int16(-1))

    def batch(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x[:, item], y[:, item])), pa.array(np.maximum(x[:, item], y[:, item]))], ["u", "v"])

    def settle(rows: np.ndarray, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(np.append(edge, len(rows)))
        pairs = edge[size == 2]
        if len(pairs):
            x, y = rows[pairs], rows[pairs + 1]
            near = (apart(x, y) >= 0) & ((x[:, 1] == x[:, 2]) | (x[:, part] != y[:, part]))
            yield batch(x[near], y[near])
        for s, n in zip(edge[size > 2], size[size > 2], strict=True):
            unit = rows[s : s + n][np.lexsort((rows[s : s + n, item], rows[s : s + n, rank]))]
            a, b = unit[0, 1], unit[0, 2]
            for left, right in {(a, b), (b, a)}:
                one, two = np.flatnonzero(unit[:, part] == left), np.flatnonzero(unit[:, part] == right)
                step = max(1, 1_000_000 // max(len(two), 1))
                for at in range(0, len(one) if len(two) else 0, step):
                    some = one[at : at + step]
                    before = two[: np.searchsorted(two, some[-1])]
                    if not len(before):
                        continue
                    bits = apart(unit[some][:, None, :], unit[before][None, :, :])
                    bits[before[None, :] >= some[:, None]] = -1
                    if every:
                        i, j = np.nonzero(bits >= 0)
                        yield batch(unit[some[i]], unit[before[j]])
                        continue
                    for tried in (np.where(bits < 0, np.int16(32767), bits).argmin(1), (bits >= 0).argmax(1)):
                        hit = bits[np.arange(len(bits)), tried] >= 0
                        yield batch(unit[some[hit]], unit[before[tried[hit]]])

    columns = ("bucket", "a", "b", "part", "item", "rank", "n", "head", *[f"s{k}" for k in range(SKETCH)])
    return lambda batches: _units(batches, columns, settle)


def single_spaced(text: Column) -> Column:
    """A text in lower case (A-Z) with one space between its words; null as the empty text."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+", " "))


def shingle_set(words: Column, size: int) -> Column:
    """The hashes of the distinct shingles of a text that is given as words with single spaces between them.

    The list of words is laid beside itself, shifted by one place each time, so a text takes time in proportion to its length.
    """
    w = F.split(words, " ")
    n = F.greatest(F.size(w) - (size - 1), F.lit(1))
    rows = F.arrays_zip(*[F.slice(w, k + 1, n).alias(f"w{k}") for k in range(size)])
    return F.when(words == "", F.array().cast("array<long>")).otherwise(F.array_distinct(F.transform(rows, lambda shingle: F.xxhash64(shingle))))


def alike(items: DataFrame, radius: int) -> DataFrame:
    """Pairs (u, v), u < v, of items (item, fp) that connect what fingerprints connect: each item with the first one of its
    fingerprint, and the first ones of fingerprints that are linked."""
    classes = durable(items.groupBy("fp").agg(F.min("item").alias("first")), "classes")
    links = durable(fingerprint_links(classes.select("fp"), radius), "links")
    same = items.join(unsent(classes), "fp").filter("item > first").select(F.col("first").alias("u"), F.col("item").alias("v"))
    ends = (links.join(unsent(classes.select(F.col("fp").alias("u"), F.col("first").alias("x"))), "u")
            .join(unsent(classes.select(F.col("fp").alias("v"), F.col("first").alias("y"))), "v"))
    return same.unionByName(ends.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, block: int = 16_384, id_col: str = "doc_id", text_col: str = "text",
                width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs without exact and near copies: one row of each group stays, that of the smallest id.

    Texts that are equal but for ASCII case and white space are one item.  Items whose sets of `words`-word shingles are
    equal up to the similarity (Jaccard) are linked, and groups are what links connect; no link between groups is missed.
    Tried are pairs that the fingerprints of `width`-word shingles connect within the radius, as in `near_duplicates`, which
    by itself would also link texts that have little but one repeated line in common; and all others that may be similar.
    Every two items that may be similar share a bucket, which is one of their first shingles (`_marks`).  In each bucket
    every item is first tried with the nearest and the first of the items before it, so that a large group of copies
    gives a few trials an item; items come in the order of their ids where these are numbers, since what was copied often
    is older than its copies.  Then in buckets whose items are not all connected by what was found, every pair of items
    that are not is tried.  Of rows that are equal in id and text one stays; nulls come after all ids.
    """
    with settings(docs.sparkSession, SHUFFLES_REMOVED):
        items, copies = _items_and_copies(docs, words, similarity, block, id_col, text_col, width, radius)
    return items.join(copies.hint("shuffle_hash"), "digest", "left_anti").select("row.*")


def _items_and_copies(docs: DataFrame, words: int, similarity: float, block: int, id_col: str, text_col: str, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Stored: the items, dealt by their digests, and the digests of those that are copies of others."""
    spark = docs.sparkSession
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    digest = F.unhex(F.md5(single_spaced(F.col(text_col)).cast("binary")))
    items = bucketed(docs.select(digest.alias("digest"), row.alias("least")).groupBy("digest").agg(F.min("least").alias("least"))
                     .select(F.monotonically_increasing_id().alias("item"), "digest", "least.id", "least.row"), "digest", "items")
    text = F.col("row")[text_col]
    numeric = isinstance(items.schema["id"].dataType, IntegralType)
    rank = F.coalesce(F.col("id").cast("long"), F.lit((1 << 63) - 1)) if numeric else F.col("item")
    with settings(spark, FEW_TEXTS):
        mark = _marks(text, words, similarity, _frequent(items, text, words), width)
        whole, path = stored(items.select("item", "digest", "id", rank.alias("rank"), mark.alias("m")).select("item", "digest", "id", "rank", "m.*"), "marks")
    each = whole.select(F.explode("first").alias("bucket"), "item").withColumn("__n", F.count("*").over(Window.partitionBy("bucket")))
    members = durable(each.filter("__n > 1").select("bucket", "item"), "members")
    marked = durable(whole.drop("first"), "marks")
    remove(spark, path)
    sketch = [F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)]

    def trials(members: DataFrame, heads: DataFrame, every: bool) -> DataFrame:
        units = in_blocks(members, "bucket", F.col("item"), block).select("bucket", "a", "b", "part", "item")
        known = marked.select("item", "rank", "n", *sketch).join(unsent(heads), "item")
        ordered = units.join(unsent(known), "item").repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
        return ordered.mapInArrow(_propose(similarity, every), "u long, v long").distinct()

    def likely(trials: DataFrame) -> DataFrame:
        """Without the pairs that wide sketches rule out.  Sets of up to 128 shingles have no wider one."""
        wide = [unsent(marked.select(F.col("item").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))) for x in "uv"]
        return trials.join(wide[0], "u").join(wide[1], "v").filter(~wide_apart(similarity)("wu", "wv", "nu", "nv")).select("u", "v")

    def similar(trials: DataFrame) -> DataFrame:
        tried = trials.select(F.explode(F.array("u", "v")).alias("item")).distinct().join(unsent(marked.select("item", "digest")), "item").select("digest")
        sets, path = stored(items.join(tried.hint("shuffle_hash"), "digest", "left_semi").select("item", shingle_set(single_spaced(text), words).alias("s")), "shingles")
        both = (trials.join(unsent(sets.select(F.col("item").alias("u"), F.col("s").alias("su"))), "u")
                .join(unsent(sets.select(F.col("item").alias("v"), F.col("s").alias("sv"))), "v"))
        common = F.size(F.array_intersect("su", "sv"))
        links = durable(both.filter(common >= similarity * (F.size("su") + F.size("sv") - common)).select("u", "v"), "links")
        remove(spark, path)
        return links

    near = alike(marked.select("item", "fp"), radius)
    some = durable(trials(members, marked.select("item", F.col("item").alias("head")), False).unionByName(near).distinct(), "trials")
    links = similar(durable(likely(some), "likely"))
    heads = durable(smallest_reached(marked.select("item", "id"), links, "item", "id").select("item", "head"), "heads")
    open_ = (members.join(unsent(heads), "item").groupBy("bucket").agg(F.min("head").alias("x"), F.max("head").alias("y"), F.count("*").alias("n"))
             .filter("x <> y and n > 2").select("bucket"))
    left = durable(members.join(unsent(open_), "bucket", "left_semi"), "open")
    rest = durable(trials(left, heads, True).join(unsent(some), ["u", "v"], "left_anti"), "trials")
    links = links.unionByName(similar(durable(likely(rest), "likely")))
    found = smallest_reached(marked.select("item", "digest", "id"), links, "item", "id").filter("head <> item")
    return items, durable(found.select("digest"), "copies")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
