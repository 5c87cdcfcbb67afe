"""Helpers that several training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that driver and executors share; it goes when the application ends.

    Only where the session names no such folder and runs in one process (tests) a temporary one is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="tonelake-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tonelake-{name}-{uuid.uuid4().hex}"
    fs, folder = _file_system(spark, path)
    fs.deleteOnExit(folder)
    return path


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _file_system(spark, path)
    return fs.exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    fs, folder = _file_system(spark, path)
    fs.delete(folder, True)


def stored(df: DataFrame, name: str = "step") -> tuple[DataFrame, str]:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage, survives executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    return stored(df, name)[0]


def bucketed(df: DataFrame, key: str, name: str = "step") -> DataFrame:
    """As `durable`, with the rows dealt by key: a join by it moves only the other side.  The catalog holds the layout until
    it is read."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    named = f"tonelake_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(named)
    rows = spark.table(named)
    spark.sql(f"DROP TABLE {named}")
    return rows


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Spark's settings for what is made and run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: The shuffle files of a query go when it has ended, not when the driver next collects its garbage: for steps that store
#: what they find, and so never read their shuffles again.
SHUFFLES_REMOVED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: So many rows go to a worker at once: for whole texts, of which Spark's own 10,000 take much memory on both sides.
FEW_TEXTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512"}


def hold_few_texts(spark: SparkSession) -> None:
    """As FEW_TEXTS, for the rest of the session: for steps whose result the caller writes.  A smaller number stays."""
    for k, v in FEW_TEXTS.items():
        if not 0 < int(spark.conf.get(k)) <= int(v):
            spark.conf.set(k, v)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def train_fold(doc_id: Column) -> Column:
    """True for rows from which labels may be learnt; the other fifth is held out."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def training_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(i, y) of the training fold.  Repeated label rows count once, with the larger label."""
    return (labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y"))
            .filter(F.col("i").isNotNull() & F.col("y").isin(0, 1) & train_fold(F.col("i")))
            .groupBy("i").agg(F.max("y").alias("y")))


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int,
                   id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most `per_class` training rows of either class as (text, label), for fitting on the driver.

    The rows are those with the smallest hash of the id among the labelled documents of at most `max_bytes`, so the
    choice depends on neither partitioning nor order, and a class is short only where it has no more such documents.
    Longer texts are left to scoring; of a repeated id the smallest text counts; null texts are empty.
    """
    own = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).filter(F.octet_length("t") <= max_bytes)
    known = durable(training_labels(labels, label, id_col).join(own.select("i").distinct(), "i", "left_semi"), "labelled")
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * per_class rows of two numbers: broadcasting them is bounded by the parameter
    rows = own.join(F.broadcast(picked), "i").groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    return [(r.t, r.y) for r in sorted(rows.collect(), key=lambda r: r.i)]


def class_shift(labels: DataFrame, label: str, drawn: list[tuple[str, int]], id_col: str = "doc_id") -> float:
    """The log odds of class 1 among all training labels, less those among the rows that were drawn; a constant that
    was fitted on these rows is corrected by it.  Zero where a class is missing, or all rows of both are drawn."""
    every = {r.y: r["count"] for r in training_labels(labels, label, id_col).groupBy("y").count().collect()}
    own = Counter(y for _, y in drawn)
    if not (every.get(0) and every.get(1) and own[0] and own[1]):
        return 0.0
    return math.log(every[1] / own[1]) - math.log(every[0] / own[0])


#: Rows of a stored table up to which a join may send it to all tasks.  Spark decides by the bytes of the files, of which
#: a row takes few, while it takes a hundred and more in the driver's memory.
SENT_ROWS = 100_000


def unsent(df: DataFrame) -> DataFrame:
    """df for a join that sends neither side to all tasks through the driver, however small Spark takes them to be."""
    return df.hint("merge")


def unsent_if_long(df: DataFrame, rows: int) -> DataFrame:
    return unsent(df) if rows > SENT_ROWS else df


def in_blocks(members: DataFrame, bucket: str, item: Column, block: int | Column, least: int = 2) -> DataFrame:
    """members (bucket, ...) with columns unit, a, b, part: each row once for each pair (a, b) of parts that its own
    part takes part in.  Buckets of fewer than `least` rows, which hold no pair, are left out.

    Members often are exploded rows, whose number no estimate knows, so neither side of the join is sent to all tasks."""
    sizes = members.groupBy(bucket).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
    parts = F.ceil(F.col("__n") / block).cast("int")
    own = F.pmod(F.xxhash64(item, F.lit("part")), parts).cast("int")
    return (members.join(unsent(sizes), bucket).select("*", parts.alias("__parts"), own.alias("part"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
            .withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other"))
            .drop("__n", "__parts", "other"))


def hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the trees of links i[k]-j[k]; the numbers k of links that joined two trees, which make a spanning forest.

    root: for each item the smallest item known to be in its tree; changed in place.
    """
    used, at = [], np.arange(len(i))
    while len(at):
        a, b = root[i[at]], root[j[at]]
        apart = a != b
        at, a, b = at[apart], a[apart], b[apart]
        if not len(at):
            break
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        high = high[order]
        first = np.append(True, high[1:] != high[:-1])
        root[high[first]] = low[order][first]
        used.append(at[order[first]])
        while not np.array_equal(up := root[root], root):
            root[:] = up
    return np.concatenate(used) if used else np.zeros(0, np.int64)


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component_id) for every id in links (u, v): the smallest id that can be reached.

    Ids may be of any type that has an order, structs too.  Alternating large-star and small-star rounds, until every
    component is a star around its smallest id.  Each round is a few grouped minima, which combine before the shuffle,
    and equi-joins; it is written to the shared folder, where the round before goes.
    """
    spark = links.sparkSession
    big, small = F.greatest("u", "v"), F.least("u", "v")
    e, path = stored(links.filter("u <> v").select(big.alias("u"), small.alias("v")).distinct(), "links")
    while True:
        n = e.count()
        inner = unsent_if_long(e.select(F.col("v").alias("u"), F.lit(True).alias("low")).distinct(), n)
        if e.groupBy("u").agg(F.count("*").alias("n")).join(inner, "u", "left").filter("n > 1 or low").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(unsent_if_long(low, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = (large.join(unsent_if_long(low, n), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
                .select("s.u", "s.v").filter("u <> v").select(big.alias("u"), small.alias("v")).distinct())
        before = path
        e, path = stored(star, "links")
        remove(spark, before)
    return (e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
            .unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()))


def smallest_reached(items: DataFrame, links: DataFrame, key: str, first_id: str) -> DataFrame:
    """items (key, first_id, ...) with component_id: the smallest first_id that can be reached over links (u, v) of keys,
    and head: the key of the item that has it.

    The nodes are ordered by first_id, nulls last, so a component's smallest node holds the answer and no group of a
    component's members is ever gathered.
    """
    n = items.count()
    node = F.struct(F.col(first_id).isNull().alias("none"), F.col(first_id).alias("first"), F.col(key).alias("key"))
    nodes = unsent_if_long(items.select(F.col(key).alias("k"), node.alias("node")), n)
    ends = (links.join(nodes.select(F.col("k").alias("u"), F.col("node").alias("nu")), "u")
            .join(nodes.select(F.col("k").alias("v"), F.col("node").alias("nv")), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v")))
    heads = connected_components(ends).select(F.col("id.key").alias(key), F.col("component_id.first").alias("component_id"), F.col("component_id.key").alias("head"))
    return (items.join(unsent_if_long(heads, n), key, "left").withColumn("component_id", F.when(F.col("head").isNotNull(), F.col("component_id")).otherwise(F.col(first_id)))
            .withColumn("head", F.coalesce("head", key)))
