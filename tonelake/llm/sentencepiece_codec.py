"""SentencePiece encoding and decoding over whole texts.

Method: a suffix array over the batch text.  The texts of a batch are normalised as the model asks and cut before
each word mark (no piece holds a mark after another character, so no merge crosses such a cut); the distinct parts
are concatenated, a suffix array is built by prefix doubling up to the longest piece, every piece of the vocabulary
is binary-searched in it for its range of occurrences, and the occurrences become edges, sorted by position and there
by length.  Relaxing follows the merge order of BPE models: in each round every part takes its best edge that joins two
neighbouring symbols (highest score, then leftmost), until no edge joins any.  A shortest path over summed scores,
as for unigram models, doesn't give what the library gives for a BPE model, so it is not used here.

An index covers at most BATCH_CHARS characters of parts at a time, so a long text needs no more memory than others; only
a single part (a run of characters without a word mark) above that is indexed whole.

Defined results: null counts as empty text and encodes to no ids; characters outside the vocabulary become byte
pieces; `decode` gives the text back with the word mark as a space, as the library does.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
LONG_PART = 64  # characters from which a part is merged with a heap instead of in rounds
BATCH_CHARS = 1_000_000  # characters that are indexed at a time; bounds a worker's memory


class Vocabulary:
    """The pieces of a model, as the index needs them."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.byte_id = np.full(256, m.unk_id(), np.int32)
        for i in range(n):
            if m.is_byte(i):
                self.byte_id[int(pieces[i][3:5], 16)] = i
        self.depth = max(len(pieces[i]) for i in plain)
        if self.depth > 16:
            raise ValueError("pieces of more than 16 characters are not supported")
        self.whole = any(MARK in pieces[i].lstrip(MARK) for i in plain)
        self.score = np.array([m.get_score(i) for i in range(n)], np.float64)
        # dense character codes from 1; 0 stands for what no piece holds
        alphabet = np.array(sorted({ord(c) for i in plain for c in pieces[i]}), np.int64)
        self.code = np.zeros(0x110000, np.uint16)
        self.code[alphabet] = np.arange(1, len(alphabet) + 1)
        self.ids, self.length, self.chars = np.array(plain, np.int32), np.array([len(pieces[i]) for i in plain]), np.zeros((len(plain), 16), np.uint64)
        for k, i in enumerate(plain):
            self.chars[k, : self.length[k]] = self.code[[ord(c) for c in pieces[i]]]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else p.replace(MARK, " ").encode() if not m.is_unknown(i) else b" \xe2\x81\x87 " for i, p in enumerate(pieces)]


def _pack(c: np.ndarray) -> np.ndarray:
    return (c[..., 0] << np.uint64(48)) | (c[..., 1] << np.uint64(32)) | (c[..., 2] << np.uint64(16)) | c[..., 3]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys, the sorted keys, and the rank of each among the distinct ones."""
    order = np.argsort(keys)
    srt = keys[order]
    new = np.empty(len(srt), np.uint64)
    new[0], new[1:] = 0, srt[1:] != srt[:-1]
    rank = np.empty(len(srt), np.uint64)
    rank[order] = np.cumsum(new, dtype=np.uint64)
    return order, srt, rank


class Edges:
    """Pieces sorted by position and, where several start, by length; `at` finds those of given positions and lengths."""

    def __init__(self, n: int, by_length: list[list[tuple[np.ndarray, np.ndarray]]]):
        count = np.zeros(n + 1, np.int32)
        self.lengths = np.zeros(n, np.uint32)  # bit k: a piece of k characters starts here
        for k, found in enumerate(by_length):
            for position, _ in found:
                count[position + 1] += 1  # a position has one piece of a length at most
                self.lengths[position] |= np.uint32(1 << k)
        self.first = np.cumsum(count, dtype=np.int64)
        self.ids = np.empty(int(self.first[-1]) + 1, np.int32)
        self.ids[-1] = -1
        filled = self.first[:-1].copy()
        for found in by_length:
            for position, ids in found:
                self.ids[filled[position]] = ids
                filled[position] += 1

    def at(self, position: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The id of the piece of that length that starts there, else -1."""
        own = self.lengths[position]
        bit = np.uint32(1) << length.astype(np.uint32)
        return np.where(own & bit, self.ids[self.first[position] + np.bitwise_count(own & (bit - np.uint32(1)))], -1)

    def one(self, position: int, length: int) -> int:
        own = int(self.lengths[position])
        return int(self.ids[self.first[position] + (own & ((1 << length) - 1)).bit_count()]) if own >> length & 1 else -1


def piece_edges(v: Vocabulary, codes: np.ndarray) -> Edges:
    n = len(codes)
    pad = np.zeros(n + 16, np.uint64)
    pad[:n] = codes
    by_length: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(17)]
    top = np.uint64(0xFFFF)
    shift = lambda r, k: np.concatenate([r[k:] + np.uint64(1), np.zeros(min(k, len(r)), np.uint64)])  # noqa: E731  0: past the end
    key4 = (pad[:n] << np.uint64(48)) | (pad[1 : n + 1] << np.uint64(32)) | (pad[2 : n + 2] << np.uint64(16)) | pad[3 : n + 3]
    levels = [(4, *_ranked(key4))]
    for width in (4, 8):
        r = levels[-1][3]
        levels.append((2 * width, *_ranked((r << np.uint64(32)) | shift(r, width))))
    distinct = [srt[np.append(True, srt[1:] != srt[:-1])] for _, _, srt, _ in levels[:2]]

    def bounds(level: int, chars: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Smallest and largest key at the level of suffixes that start with chars, and whether there are any."""
        at = np.arange(chars.shape[1])
        high = np.where(at >= used[:, None], top, chars)
        if level == 0:
            return _pack(chars), _pack(high), np.ones(len(chars), bool)
        half = 4 * level
        head, head_high, ok = bounds(level - 1, chars[:, :half], np.minimum(used, half))
        rank = np.searchsorted(distinct[level - 1], head, "left")
        rank_high = np.searchsorted(distinct[level - 1], head_high, "right")  # one past
        ok &= rank_high > rank
        low2, high2, ok2 = bounds(level - 1, chars[:, half:], np.maximum(used - half, 0))
        first = np.searchsorted(distinct[level - 1], low2, "left").astype(np.uint64)
        last = np.searchsorted(distinct[level - 1], high2, "right").astype(np.uint64)  # one past the largest rank
        base = rank.astype(np.uint64) << np.uint64(32)
        short = used <= half  # then any second half will do
        low = np.where(short, base, base | (first + np.uint64(1)))
        high = np.where(short, ((np.maximum(rank_high, 1) - 1).astype(np.uint64) << np.uint64(32)) | np.uint64(0xFFFFFFFF), base | last)
        return low, high, ok & (short | (ok2 & (last > first)))

    for level, (width, order, srt, _) in enumerate(levels):
        mine = np.flatnonzero((v.length <= width) & (v.length > (width // 2 if level else 0)))
        if not len(mine):
            continue
        low, high, ok = bounds(level, v.chars[mine, :width], v.length[mine])
        a, b = np.searchsorted(srt, low, "left"), np.searchsorted(srt, high, "right")
        count = np.where(ok, np.maximum(b - a, 0), 0)
        for size in np.unique(v.length[mine]):
            some = np.flatnonzero((v.length[mine] == size) & (count > 0))
            n_some = count[some]
            which = np.repeat(some, n_some)
            inside = np.arange(n_some.sum()) - np.repeat(np.cumsum(n_some) - n_some, n_some)
            by_length[size].append((order[a[which] + inside], v.ids[mine][which]))
    return Edges(n, by_length)


def _heap_merge(v: Vocabulary, edges: Edges, n: int, a: int, b: int) -> list[int]:
    """Starts of the symbols of one long part [a, b)."""
    nxt, prv = list(range(a + 1, b + 1)), list(range(a - 1, b - 1))
    live, heap = bytearray(b"\1") * (b - a), []

    def offer(i: int) -> None:
        j = nxt[i - a]
        if j < b:
            k = nxt[j - a]
            if k - i <= 16 and k <= n and (p := edges.one(i, k - i)) >= 0:
                heapq.heappush(heap, (-v.score[p], i, j, k))

    for i in range(a, b - 1):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if live[i - a] and nxt[i - a] == j and j < b and live[j - a] and nxt[j - a] == k:
            live[j - a], nxt[i - a] = 0, k
            if k < b:
                prv[k - a] = i
            offer(i)
            if prv[i - a] >= a:
                offer(prv[i - a])
    return [i for i in range(a, b) if live[i - a]]


def encode_parts(v: Vocabulary, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all parts in a row, and the number of ids of each; BATCH_CHARS characters of parts at a time."""
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    ids, count, at = [], [], 0
    while at < len(parts):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_CHARS, "right")))
        for out, x in zip((ids, count), _encode_parts(v, parts[at:last]), strict=True):
            out.append(x)
        at = last
    return np.concatenate(ids), np.concatenate(count)


def _encode_parts(v: Vocabulary, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(size + 1) - size - 1  # a separator that no piece holds follows each part
    points = np.frombuffer("\0".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = v.code[points]
    codes[begin + size] = 0
    edges = piece_edges(v, codes)
    score = np.append(v.score, -np.inf)
    long = np.flatnonzero(size > LONG_PART)
    inside = np.ones(len(codes), bool)
    inside[begin + size] = False
    for k in long:
        inside[begin[k] : begin[k] + size[k]] = False
    start = np.flatnonzero(inside)  # symbols of the parts that still merge
    part = np.repeat(np.arange(len(parts)), np.where(size > LONG_PART, 0, size))
    done = [np.concatenate([np.asarray(_heap_merge(v, edges, len(codes), begin[k], begin[k] + size[k]), np.int64) for k in long])] if len(long) else []
    ends = begin + size
    while len(start):
        end = np.append(start[1:], 0)
        last = np.append(part[1:] != part[:-1], True)
        end[last] = ends[part[last]]
        reach = np.append(end[1:], 0) - start
        pair = ~last & (reach <= 16)
        best = np.full(len(start), -np.inf)
        best[pair] = score[edges.at(start[pair], reach[pair])]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        top = np.repeat(np.maximum.reduceat(best, first), np.diff(np.append(first, len(start))))
        busy = top > -np.inf
        if not busy.all():
            done.append(start[~busy])
        hit = np.flatnonzero(busy & (best == top))
        hit = hit[np.append(True, part[hit[1:]] != part[hit[:-1]])] if len(hit) else hit
        keep = busy
        keep[hit + 1] = False
        start, part = start[keep], part[keep]
    start = np.sort(np.concatenate(done)) if done else np.zeros(0, np.int64)
    owner = np.searchsorted(begin, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(codes)), ends[owner])
    ids = edges.at(start, end - start)
    count = np.bincount(owner, minlength=len(parts))
    if (bad := np.flatnonzero(ids < 0)).size:  # single characters that no piece holds: their bytes
        widths, spelled = np.ones(len(ids), np.int64), []
        for k in bad:
            raw = chr(points[start[k]]).encode("utf-8", "surrogatepass")
            widths[k] = len(raw)
            spelled.append(np.frombuffer(raw, np.uint8))
        out = np.repeat(ids, widths)
        out[out < 0] = v.byte_id[np.concatenate(spelled)]
        np.add.at(count, owner[bad], widths[bad] - 1)
        ids = out
    return ids, count


def encode_texts(v: Vocabulary, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text, through one index over the distinct parts of all of them."""
    cut = re.compile("(?s).+" if v.whole else f"{MARK}*[^{MARK}]+|{MARK}+")
    parts, owner = [], np.zeros(len(texts) + 1, np.int64)
    for k, t in enumerate(texts):
        parts += cut.findall(v.model.normalize(t)) if t else []
        owner[k + 1] = len(parts)
    if not parts:
        return [np.zeros(0, np.int32)] * len(texts)
    seen: dict[str, int] = {}
    which = np.fromiter((seen.setdefault(p, len(seen)) for p in parts), np.int64, len(parts))
    ids, count = encode_parts(v, list(seen))
    begin = np.cumsum(count) - count
    n = count[which]
    flat = ids[np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    at = np.append(0, np.cumsum(n))[owner]
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def decode_ids(v: Vocabulary, ids) -> str:
    text = b"".join([v.bytes[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _in_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows in order, some of them at a time: up to BATCH_CHARS bytes of text, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column("__text")), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if k > at and held + n > BATCH_CHARS:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < len(size):
        yield batch.slice(at)


def _encoded(path: str, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(path)
        is_byte = np.zeros(len(v.score), bool)
        is_byte[v.byte_id] = True
        for batch in (part for whole in batches for part in _in_slices(whole)):
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            out = encode_texts(v, texts)
            rest = [batch.column(c) for c in batch.schema.names if c != "__text"]
            names = [c for c in batch.schema.names if c != "__text"]
            if what == "ids":
                offsets = np.append(0, np.cumsum([len(x) for x in out])).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*rest, ids], [*names, "token_ids"])
            else:
                yield pa.RecordBatch.from_arrays([
                    *rest,
                    pa.array([len(x) for x in out], pa.int64()),
                    pa.array([int(is_byte[x].sum()) for x in out], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in out], pa.int64()),
                    pa.array([decode_ids(v, x.tolist()) == t.replace(MARK, " ") for x, t in zip(out, texts, strict=True)], pa.bool_()),
                ], [*names, "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"])

    return run


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and token_ids array<int> of each whole text."""
    src = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text")
    return src.mapInArrow(_encoded(model_path, "ids"), f"{schema}, token_ids array<int>")


def encode_report(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, n_byte_tokens, CRC-32 of the ids as little-endian int32, and whether decoding the
    ids gives the text back (with U+2581 as a space)."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), F.col(text_col).alias("__text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_encoded(model_path, "report"), f"doc_id {kind}, n_bytes long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "token_ids", out_col: str = "text") -> DataFrame:
    """Adds the decoded text; null ids give null."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = Vocabulary(model_path)
        for ids in batches:
            yield pd.Series([None if x is None else decode_ids(v, x) for x in ids], dtype=object)

    return encoded.withColumn(out_col, text(F.col(ids_col)))
