"""Token-id output: documents packed into fixed rows of ids by best-fit decreasing.

Method: each text is encoded and an end-of-document id follows it; what is longer than a row is split, losslessly,
into full rows and a rest.  The pieces of a block are taken in descending
length, and each goes to the open row with the least room that still holds it.  That row is found with a segment tree
over room sizes 0..row length, whose nodes count the rows that have such room: one descent per piece.  A packed row
carries the id matrix row (little-endian uint16 or uint32, padded), the cumulative segment lengths and the position of
every id inside its segment, which restarts from 0 at each segment; `parts` tells which piece of its document it is.

Blocks, not the whole corpus, are packed.  A row's block is a hash of its id and text modulo the number of blocks, which
follows from the bytes of all texts, and rows come to a task in the order of block and hash; so the result depends on the
rows alone, not on how the input is split or how many cores there are.  Texts are shuffled once for this, many blocks to a
partition.  A block of more than `BLOCK_TOKENS` is packed in parts, so memory is bounded also where one row is repeated
very often (equal rows have one hash, so they are one task's work).  The waste of a block is below one row beyond what
best fit leaves.

Defined results: a null or empty text is a document of one id, the end id; repeated rows are packed as often as they
occur; ties of length go by document id, then by part; ids are whole numbers or null, and what can't be cast to one fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TOKENS = 4_000_000
BLOCK_BYTES = 1 << 20  # of text, on average


class RoomTree:
    """How many open rows have each room, as a segment tree; finds the least room that is large enough."""

    def __init__(self, largest: int):
        self.size = 1 << largest.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(largest + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i, count = self.size + room, self.count
        while i:
            count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The room and number of the row with the least room >= need, which leaves the tree."""
        i, count = self.size + need, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a right neighbour has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; lengths must be in descending order and at most the capacity."""
    tree, rows = RoomTree(capacity), []
    for k, n in enumerate(lengths):
        found = tree.take(n)
        if found is None:
            rows.append([k])
            room, row = capacity, len(rows) - 1
        else:
            room, row = found
            rows[row].append(k)
        if room > n:
            tree.add(room - n, row)
    return rows


def _pack(tokenizer_path: str, seq_len: int, end_id: int, pad_id: int, dtype: str):
    def packed(pieces: list[tuple[int, int, np.ndarray]], block: str) -> pa.RecordBatch:
        pieces.sort(key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1]))
        rows = best_fit_decreasing([len(p[2]) for p in pieces], seq_len)
        ids = np.full((len(rows), seq_len), pad_id, dtype)
        pos = np.zeros((len(rows), seq_len), "<u4")
        cum, owners, parts = [], [], []
        for r, row in enumerate(rows):
            at, ends = 0, [0]
            for k in row:
                own = pieces[k][2]
                ids[r, at : at + len(own)] = own
                pos[r, at : at + len(own)] = np.arange(len(own))
                at += len(own)
                ends.append(at)
            cum.append(ends)
            owners.append([pieces[k][0] for k in row])
            parts.append([pieces[k][1] for k in row])
        return pa.RecordBatch.from_arrays([
            pa.array([block] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()),
            pa.array([c[-1] for c in cum], pa.int32()), pa.array(owners, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32())),
            pa.array(cum, pa.list_(pa.int32())), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in pos], pa.binary()),
        ], ["block", "row", "n_tokens", "doc_ids", "parts", "cu_seqlens", "ids", "position_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tonelake.llm.token_counts import token_ids

        pieces, held, at_block, chunk = [], 0, None, 0
        for batch in batches:
            for block, doc, text in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "text")), strict=True):
                if pieces and (block != at_block or held >= BLOCK_TOKENS):
                    yield packed(pieces, f"{at_block:09d}-{chunk:04d}")
                    pieces, held, chunk = [], 0, chunk + 1
                if block != at_block:
                    at_block, chunk = block, 0
                ids = np.append(token_ids(tokenizer_path, text), end_id)
                if ids.max() > np.iinfo(dtype).max:
                    raise ValueError(f"token ids above {np.iinfo(dtype).max} need more bytes an id")
                ids = ids.astype(dtype)
                for part, at in enumerate(range(0, len(ids), seq_len)):
                    pieces.append((doc, part, ids[at : at + seq_len]))
                held += len(ids)
        if pieces:
            yield packed(pieces, f"{at_block:09d}-{chunk:04d}")

    return run


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 50256, pad_id: int = 0,
         id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per packed sequence: block, row, n_tokens, doc_ids, parts, cu_seqlens, ids and position_ids (binary)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dtype = {2: "<u2", 4: "<u4"}[id_bytes]
    total = src.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    dealt = src.withColumn("__h", F.xxhash64("doc_id", "text")).withColumn("block", F.pmod("__h", F.lit(max(1, -(-total // block_bytes)))))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "__h", "doc_id", "text").drop("__h")
    return dealt.mapInArrow(_pack(tokenizer_path, seq_len, end_id, pad_id, dtype), "block string, row long, n_tokens int, "
                          "doc_ids array<long>, parts array<int>, cu_seqlens array<int>, ids binary, position_ids binary")


def write_packed(docs: DataFrame, tokenizer_path: str, path: str, **options) -> None:
    """The packed rows as Parquet files, which every reader of the shared store can open."""
    pack(docs, tokenizer_path, **options).write.mode("overwrite").parquet(path)
