"""Resharding by minimum-cost flow: the new shards hold near equal bytes, and as few bytes as can be change shards.

Method: the old shards' sizes are supplies and the new shards' capacities demands of a flow network; staying costs
nothing and a byte that moves from shard i to shard j costs `cost(i, j)`, one by default.  The cheapest flow, found by
successive shortest paths, says how many bytes go from where to where.  Each old shard is cut into blocks, in number
proportional to its bytes and `blocks` in all; the blocks are laid out one after the other, and each destination gets
one run of them.  Only a block at the edge of a run is split, by its documents, so a shard misses its capacity by at
most half a document at each edge.  Documents are dealt by size, those above 1/8, 1/64 and 1/512 of a shard first, and
smaller ones make up for what larger ones missed.  Shards that neither give nor take keep their files.

The driver holds one number per pair of shards.  Sums over blocks and places inside a block are grouped and window
operations on hashed blocks, so an old shard with a third of all rows is dealt to many tasks.

Defined results: a null text is empty and takes `overhead` bytes; a null old shard counts as shard 0; repeated rows
are rows of their own; rows that are equal in all columns may change places with each other; null ids are ids as others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.llm.common import durable, exists, remove

LAW = "bytes"


def cheapest_flow(supply: list[int], demand: list[int], cost: Callable[[int, int], int]) -> list[list[int]]:
    """flow[i][j] of least total cost that empties every supply and fills every demand (their sums must be equal)."""
    n, m = len(supply), len(demand)
    left, room, flow = list(supply), list(demand), [[0] * m for _ in range(n)]
    while any(left):
        # shortest paths from all open supplies over the residual network: nodes 0..n-1 old, n..n+m-1 new shards
        dist = [0 if i < n and left[i] else None for i in range(n + m)]
        came = [-1] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    c = cost(i, j)
                    if dist[i] is not None and (dist[n + j] is None or dist[i] + c < dist[n + j]):
                        dist[n + j], came[n + j], changed = dist[i] + c, i, True
                    if flow[i][j] and dist[n + j] is not None and (dist[i] is None or dist[n + j] - c < dist[i]):
                        dist[i], came[i], changed = dist[n + j] - c, n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: (dist[n + j], j))
        path = [n + end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        steps = list(zip(path[1:], path[:-1], strict=True))  # (from, to), last step first
        amount = min([left[path[-1]], room[end], *(flow[b][a - n] for a, b in steps if a >= n)])
        for a, b in steps:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[-1]] -= amount
        room[end] -= amount
    return flow


def capacities(total: int, shards: int) -> list[int]:
    return [total * (k + 1) // shards - total * k // shards for k in range(shards)]


def fitted(lengths: list[int], total: int) -> list[int]:
    """Lengths of the same proportions, rounded so that they sum to the total."""
    lengths = [max(0, x) for x in lengths]
    given = sum(lengths)
    if not given:
        return [total, *[0] * (len(lengths) - 1)]
    at, out, seen = 0, [], 0
    for x in lengths:
        seen += x
        out.append(seen * total // given - at)
        at += out[-1]
    return out


def _deal(rows: DataFrame, bytes_of: list[int], runs: list[list[int]], blocks: int) -> DataFrame:
    """rows with shard, block and inside (the place among the rows of its block and shard).

    runs[i][j]: how many of the bytes_of[i] bytes of old shard i go to shard j; what stays comes first.
    """
    starts, owners = [], []
    for i, row in enumerate(runs):
        at, begin, owner = 0, [], []
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                begin.append(at)
                owner.append(j)
                at += row[j]
        starts.append(begin or [0])
        owners.append(owner or [0])
    total = max(sum(bytes_of), 1)
    of_shard = lambda values: F.element_at(F.array(*values), F.col("old_shard") + 1)
    count = of_shard([F.lit(max(1, -(-b * blocks // total))) for b in bytes_of])
    placed = rows.withColumn("block", F.pmod("h", count).cast("int"))

    sums = placed.groupBy("old_shard", "block").agg(F.sum("size").alias("b"))  # `blocks` rows and one per old shard
    base = F.sum("b").over(Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select("old_shard", "block", F.coalesce(base, F.lit(0)).alias("base"))
    unit = Window.partitionBy("old_shard", "block").orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    # a row belongs to the run in which its middle lies
    at = F.col("base") + F.coalesce(F.sum("size").over(unit), F.lit(0)) + F.floor(F.col("size") / 2)
    begins = of_shard([F.array(*[F.lit(x).cast("long") for x in b]) for b in starts])
    owner = of_shard([F.array(*map(F.lit, o)) for o in owners])
    inside = F.row_number().over(Window.partitionBy("old_shard", "block", "shard").orderBy("at")) - 1
    return (placed.join(F.broadcast(before), ["old_shard", "block"]).withColumn("at", at)
            .withColumn("shard", F.element_at(owner, F.size(F.filter(begins, lambda s: s <= F.col("at")))))
            .withColumn("inside", inside)
            .select("doc_id", "size", "text_crc32", "old_shard", "tier", "h", "block", "shard", "inside"))


def _row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def assign(docs: DataFrame, old_shard: Column, old_shards: int, shards: int = 24, blocks: int = 12_288, overhead: int = 8,
           cost: Callable[[int, int], int] = lambda i, j: int(i != j), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot (0, 1, ... inside each shard) and row_hash for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    old = F.pmod(F.coalesce(old_shard, F.lit(0)), F.lit(old_shards)).cast("int")
    rows = durable(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
                               F.crc32(text.cast("binary")).alias("text_crc32"), old.alias("old_shard"), _row_hash(docs).alias("h")), "reshard")
    total = rows.agg(F.sum("size")).first()[0] or 0
    tier = sum(((F.col("size") <= F.lit(total // shards // 8 ** k)).cast("int") for k in (1, 2, 3)), F.lit(0))
    rows = rows.withColumn("tier", tier)
    held: dict[int, list[int]] = {}
    for r in rows.groupBy("tier", "old_shard").agg(F.sum("size").alias("b")).collect():
        held.setdefault(r.tier, [0] * old_shards)[r.old_shard] = r.b
    left = cheapest_flow([sum(own) for own in zip(*held.values(), strict=True)] or [0] * old_shards, capacities(total, shards), cost)

    told = None
    for k in sorted(held):
        part = durable(_deal(rows.filter(F.col("tier") == k), held[k], [fitted(f, b) for f, b in zip(left, held[k], strict=True)], blocks), "reshard-tier")
        if k < 3:
            for r in part.groupBy("old_shard", "shard").agg(F.sum("size").alias("b")).collect():
                left[r.old_shard][r.shard] -= r.b
        told = part if told is None else told.unionByName(part)
    if told is None:
        told = _deal(rows, [0] * old_shards, left, blocks)

    # at most one row per run and block of each tier
    segments = told.groupBy("shard", "tier", "old_shard", "block").agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("tier", "old_shard", "block").rowsBetween(Window.unboundedPreceding, -1))
    slots = segments.select("shard", "tier", "old_shard", "block", F.coalesce(first, F.lit(0)).alias("first"))
    return (told.join(F.broadcast(slots), ["shard", "tier", "old_shard", "block"])
            .select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("inside")).cast("long").alias("slot"), F.col("h").alias("row_hash")))


def rewrite(docs: DataFrame, plan: DataFrame, path: str, rows_per_file: int = 1_000_000, id_col: str = "doc_id") -> list[int]:
    """Write the rows of the shards that gain or lose rows below path/shard=N; returns these shards.

    docs: the rows that `assign` was given, with the same columns; plan: its result.  Columns of docs that are named shard
    or slot are written as shard_of_row and slot_of_row.  The files of other shards stay as
    they are, and a shard that loses all its rows loses its folder.  Repeated rows and null ids are written as often as
    they occur: what is joined is the distinct rows to the plan's rows.  A run that is repeated leaves the same files;
    where docs are read from `path` itself, write elsewhere and exchange the folders, since a run that breaks off
    between two shards would have replaced part of its own input.
    """
    spark = docs.sparkSession
    moved = plan.filter("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    hit = sorted(r.shard for r in moved.collect())  # as many numbers as shards
    chosen = plan.filter(F.col("shard").isin(hit)).select(F.col("doc_id").alias("__id"), "row_hash", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    distinct = docs.select(F.col(id_col).alias("__own"), _row_hash(docs).alias("__hash"), row.alias("__row")).groupBy("__own", "__hash").agg(F.first("__row").alias("__row"))
    out = chosen.join(distinct, F.col("__id").eqNullSafe(F.col("__own")) & (F.col("row_hash") == F.col("__hash")))
    own = [F.col("__row")[c].alias(f"{c}_of_row" if c in ("shard", "slot") else c) for c in docs.columns]
    out = durable(out.select(F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), *own), "reshard-rows")
    (out.repartition("shard", F.floor(F.col("slot") / rows_per_file)).sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path))
    filled = {r.shard for r in chosen.select(F.col("__shard").alias("shard")).distinct().collect()}
    for k in hit:
        if k not in filled and exists(spark, f"{path}/shard={k}"):
            remove(spark, f"{path}/shard={k}")
    return hit
