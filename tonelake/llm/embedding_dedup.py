"""Near-duplicate embeddings by an exact metric range join.

Method: vectors of equal label are put on the unit sphere, where cosine >= c means a Euclidean distance of at most
r = sqrt(2 - 2c).  Pivots partition the vectors of a label and length: each vector's home is its nearest pivot.  If y
with home j lies within r of x with home i, the triangle inequality gives d(y, p_i) <= d(y, p_j) + 2r, and the plane
between the two pivots d(y, p_i)^2 - d(y, p_j)^2 <= 2r d(p_i, p_j), which says more; so y is also sent, as a guest, to
every cell of a lower number for which both hold, and each pair meets in exactly one cell.  Cells join independently; a
large cell is dealt into parts, and each pair of parts is a unit of its own.  Inside a unit the triangle inequality is
used once more: only vectors whose distances to the cell's pivot differ by r or less are compared.  A unit returns how
many vectors each of its vectors links to and a spanning forest of its links, not the pairs.

Equal vectors of a label are one class from the start, with its size as its weight.  A label of n classes has
sqrt(n) * `density` pivots, `max_pivots` at most in all, which bounds what is broadcast.  They are chosen among four
times as many classes of smallest hash: those with the most others near, apart from each other.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label
or an id, link with nothing and are their own component; vectors of different lengths never link; rows that repeat a
vec_id count as so many vectors, and each has the links of its own vector and label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import durable, hook, in_blocks, smallest_reached

SLACK = 1e-6  # distances near zero are exact to about 1e-8


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows, with a digest for those that can link, and the distinct vectors of each label among them, numbered."""
    v = F.col(vector_col).cast("array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sound = (F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    rows = rows.withColumn("norm", F.when(F.coalesce(sound, F.lit(False)), norm))
    usable = F.col("vec_id").isNotNull() & F.coalesce((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False))
    rows = rows.select("vec_id", "label", "v", F.when(usable, F.unhex(F.md5(F.struct("label", "v").cast("string").cast("binary")))).alias("digest"))
    classes = (rows.filter("digest is not null").groupBy("digest", "label", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"))
               .withColumn("cid", F.monotonically_increasing_id()))
    return rows, classes


def _pivots(classes: DataFrame, density: float, max_pivots: int, reach: float) -> dict:
    """(label, length) -> its pivots.  What is collected is bounded by 8 * max_pivots vectors."""
    classes = classes.withColumn("n", F.size("v"))
    size = (classes.groupBy("label", "n").agg(F.count("*").alias("rows"))
            .withColumn("k", F.ceil(F.sqrt("rows") * density)).filter("k >= 2"))
    total = size.agg(F.sum("k")).first()[0]
    if not total:
        return {}
    share = min(1.0, max_pivots / float(total))
    # a class is looked at with probability 4k / rows, by its hash; the outer limit holds the bound for any hash values
    chance = 4 * F.col("k") * share / F.col("rows")
    seen = (classes.join(size, ["label", "n"]).filter(F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < chance * (1 << 30))
            .orderBy(F.xxhash64("digest"), "digest").limit(8 * max_pivots).select("label", "n", "k", "v").collect())
    of: dict = {}
    for r in seen:
        of.setdefault((r.label, r.n), (max(1, int(r.k * share)), []))[1].append(np.array(r.v) / np.linalg.norm(r.v))
    return {key: _dense(np.array(x), k, reach) for key, (k, x) in of.items()}


def _dense(x: np.ndarray, k: int, reach: float) -> np.ndarray:
    """Up to k rows of x, those with the most rows within reach first, none within reach of another."""
    near = x @ x.T >= 1 - reach * reach / 2
    taken, free = [], np.ones(len(x), bool)
    for i in np.argsort(-near.sum(1), kind="stable"):
        if free[i] and len(taken) < k:
            taken.append(i)
            free &= ~near[i]
    return x[taken]


def homes_and_guests(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, cell, whether the cell is its home, distance to the cell's pivot)."""
    d = np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0))
    own = d.argmin(1)
    least = d[np.arange(len(x)), own][:, None]
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[own]
    inside = (d <= least + 2 * r) & (d * d - least * least <= 2 * r * between + SLACK) & (np.arange(len(pivots)) < own[:, None])
    inside[np.arange(len(x)), own] = True
    who, cell = np.nonzero(inside)
    return who, cell, cell == own[who], d[who, cell]


def _assign(shared, r: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            flat, ends = vectors.flatten().to_numpy(), np.append(0, np.cumsum(vectors.value_lengths().to_numpy()))
            keys = list(zip(batch.column("label").to_pylist(), np.diff(ends).tolist(), strict=True))
            rows: dict = {}
            for k, key in enumerate(keys):
                rows.setdefault(key, []).append(k)
            for (label, n), own in rows.items():
                pivots = shared.value.get((label, n))
                step = max(1, 1_000_000 // (1 if pivots is None else len(pivots)))
                for at in range(0, len(own), step):
                    some = np.array(own[at : at + step])
                    x = flat[ends[some][:, None] + np.arange(n)]
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    if pivots is None:
                        who, cell, home, d = np.arange(len(x)), np.zeros(len(x), int), np.ones(len(x), bool), np.zeros(len(x))
                    else:
                        who, cell, home, d = homes_and_guests(x, pivots, r)
                    out = batch.select(["cid", "weight"]).take(pa.array(some[who]))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1, dtype=np.int32) * n, pa.int32()), pa.array(x[who].ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{label}/{n}/{c}" for c in cell.tolist()], pa.string()), pa.array(home), pa.array(d), *out.columns, lists],
                        ["cell", "home", "d", "cid", "weight", "v"])

    return run


def _unit(cosine: float, r: float):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        a, b = int(df["a"].iloc[0]), int(df["b"].iloc[0])
        part, d = df["part"].to_numpy(), df["d"].to_numpy()
        by_distance = lambda rows: rows[np.argsort(d[rows], kind="stable")]
        one, two = by_distance(np.flatnonzero(part == a)), by_distance(np.flatnonzero(part == b))
        x, home = np.stack(df["v"].to_numpy()), df["home"].to_numpy()
        cid, weight = df["cid"].to_numpy(), df["weight"].to_numpy()
        count, root, links = np.zeros(len(df), np.int64), np.arange(len(df)), []
        for at in range(0, len(one), 256):
            some = one[at : at + 256]
            low, high = np.searchsorted(d[two], d[some[0]] - r, "left"), np.searchsorted(d[two], d[some[-1]] + r, "right")
            other = two[low:high]
            near = (x[some] @ x[other].T >= cosine) & (home[some][:, None] | home[other][None, :])
            if a == b:
                near &= other[None, :] > some[:, None]
            i, j = np.nonzero(near)
            i, j = some[i], other[j]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            used = hook(root, i, j)
            links.append((cid[i[used]], cid[j[used]]))
        hit = np.flatnonzero(count)
        u, v = (np.concatenate([p[k] for p in links]) if links else np.zeros(0, np.int64) for k in (0, 1))
        return pd.DataFrame({"u": np.concatenate([cid[hit], u]), "v": pd.array([*([None] * len(hit)), *v.tolist()], "Int64"),
                             "n": np.concatenate([count[hit], np.zeros(len(u), np.int64)])})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98, density: float = 0.25, max_pivots: int = 1024, block: int = 4096,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    spark = vectors.sparkSession
    rows, classes = _classes(vectors, id_col, vector_col, label_col)
    classes = durable(classes, "vector-classes")
    r = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    shared = spark.sparkContext.broadcast(_pivots(classes, density, max_pivots, 2 * r))
    placed = durable(classes.select("label", "v", "cid", "weight").mapInArrow(
        _assign(shared, r), "cell string, home boolean, d double, cid long, weight long, v array<double>"), "vector-cells")
    units = in_blocks(placed, "cell", F.col("cid"), block)
    found = durable(units.groupBy("cell", "a", "b").applyInPandas(_unit(cosine, r), "u long, v long, n long"), "vector-links")
    counts = found.filter("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("n"))
    told = smallest_reached(classes.select("digest", "cid", "first_id", "weight"), found.filter("v is not null").select("u", "v").distinct(), "cid", "first_id")
    told = told.join(counts, "cid", "left").select("digest", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    joined = rows.filter("digest is not null").select("vec_id", "digest").join(told, "digest").select("vec_id", "n_links", "component_id")
    alone = rows.filter("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
