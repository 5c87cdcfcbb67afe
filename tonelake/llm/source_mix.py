"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Method: sources share all words by weight; a source's target stops at `repeats` times its words, and what is above is
shared again, which is a water level over (limit / weight).  The whole mix is so many blocks of `block` words.  They go
to the sources by the highest quotients target / (2 * seats + 1), and each source's blocks go to its shards by the
highest quotients of the shards' words, so every shard has an integer quota before any text is chosen.  In a shard the
documents stand in seeded order, end to end and around again; the quota is the run of so many blocks from a seeded
place on, so documents are taken whole but for the two at its ends, and whole rounds first.

Quotas by highest quotients need no list of all quotients: with n parties and N seats the first floor(e * f + 1/2)
seats of a party of exact share e are certain for f = 1 - n / (2N); at most n seats remain, and the quotients that can
get one of them are at most 4n.

What is shuffled is one row of numbers per document; texts stay where they are.  The number of shards of a source
follows its rows and words, so a source with a third of all rows is many shards.  Rows that are equal in source, id and
size are one row with a count until the end.  Windows without a key see one row per source (and at most four per source
for the quotients), windows by source one row per shard.

Defined results: null and empty texts have size zero and nothing is taken of them; the null source is a source and comes
last; a source without words has target zero; repeated rows are documents of their own; null ids are ids as others;
an empty table gives an empty table.  Rows that are equal in source, id and size may change places with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.llm.common import durable

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, what: Column) -> Column:
    """32 hexadecimal digits that depend on the seed and on a text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), what).cast("binary"))


def number(digest: Column) -> Column:
    """The first eight hexadecimal digits as a long."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def apportion(parties: DataFrame, group: list[str], order: list[str], weight: str, seats: str) -> DataFrame:
    """parties with `quota`: how many of its group's `seats` each gets by the highest quotients weight / (2 * q + 1).

    order: the columns that name a party within its group, of which the earlier gets a seat on equal quotients.  Parties
    of weight zero get none; a group without weight gives no seats.
    """
    all_of = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    base = (parties.withColumn("__w", F.greatest(F.col(weight).cast("double"), F.lit(0.0)))
            .withColumn("__sum", F.sum("__w").over(all_of)).withColumn("__n", F.count("*").over(all_of))
            .withColumn("__e", F.when(F.col("__w") > 0, F.col("__w") * F.col(seats) / F.col("__sum")).otherwise(F.lit(0.0)))
            .withColumn("__f", F.greatest(F.lit(0.0), 1 - F.col("__n") / (2 * F.nullif(F.col(seats), F.lit(0)))))
            .withColumn("__sure", F.when(F.col("__w") > 0, F.floor(F.col("__e") * F.coalesce("__f", F.lit(0.0)) + 0.5)).otherwise(F.lit(0)))
            .withColumn("__left", F.when(F.col("__sum") > 0, F.col(seats) - F.sum("__sure").over(all_of)).otherwise(F.lit(0))))
    more = F.when((F.col("__w") > 0) & (F.col("__left") > 0), F.ceil(F.col("__e") * 2 * F.col("__n") / F.nullif(F.col(seats), F.lit(0))) + 1).otherwise(F.lit(0)).cast("int")
    bids = base.withColumn("__k", F.explode(F.sequence(F.lit(0), more)))  # bid 0 is no bid: it keeps the party's row
    quotient = F.when(F.col("__k") > 0, F.col("__w") / (2 * (F.col("__sure") + F.col("__k")) - 1))
    ranked = bids.withColumn("__r", F.row_number().over(all_of.orderBy(quotient.desc_nulls_last(), *order, "__k")))
    won = F.count(F.when((F.col("__k") > 0) & (F.col("__r") <= F.col("__left")), True))
    return (ranked.groupBy(*parties.columns, "__sure").agg(won.alias("__won"))
            .withColumn("quota", (F.col("__sure") + F.col("__won")).cast("long")).select(*parties.columns, "quota"))


def targets(sources: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """sources (none, name, source_size, n_docs) with weight, total and target."""
    everything, by_level = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("__level", "none", "name")
    rank = F.row_number().over(everything.orderBy("none", "name")) - 1
    own = (sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
           .withColumn("total", F.sum("source_size").over(everything))
           .withColumn("__limit", repeats * F.col("source_size")).withColumn("__level", F.col("__limit") / F.col("weight"))
           .withColumn("__full", F.coalesce(F.sum("__limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("__rest", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    # in the order of their levels sources are full as long as their limit is below their share of what is left
    own = own.withColumn("__stops", F.col("__limit") * F.col("__rest") < (F.col("total") - F.col("__full")) * F.col("weight"))
    own = (own.withColumn("__left", F.col("total") - F.sum(F.when(F.col("__stops"), F.col("__limit")).otherwise(F.lit(0))).over(everything))
           .withColumn("__open", F.sum(F.when(F.col("__stops"), F.lit(0)).otherwise(F.col("weight"))).over(everything)))
    share = F.col("__left").cast("double") * F.col("weight") / F.col("__open")
    return own.withColumn("target", F.when(F.col("__stops"), F.col("__limit").cast("double")).otherwise(share)).select(*sources.columns, "weight", "total", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, block: int = 16, seed: int = 13, shard_rows: int = 4096,
        shard_words: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shard and start for every row.

    start: at which of the document's words, around its shard, the taken words begin; null where nothing beyond whole
    rounds is taken.  weights: in turn for the sources in code-point order, the null source last.
    """
    source = F.col(source_col).cast("string")
    sizes = durable(docs.select(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"), F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"))
                    .groupBy("none", "name", "doc_id", "size").agg(F.count("*").alias("copies")), "mix-sizes")
    words = F.col("size") * F.col("copies")
    sources = durable(sizes.groupBy("none", "name").agg(F.sum(words).alias("source_size"), F.sum("copies").alias("n_docs")), "mix-sources")
    blocks = F.round(F.col("total") / block).cast("long")
    plan = apportion(targets(sources, weights, repeats).withColumn("blocks", blocks), [], ["none", "name"], "target", "blocks")
    shards = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / shard_rows), F.ceil(F.col("source_size") / shard_words)).cast("long")
    plan = durable(plan.select("none", "name", "source_size", "target", F.col("quota").alias("source_quota"), shards.alias("shards")), "mix-plan")

    place = seeded(seed, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    rows = sizes.join(plan, ["none", "name"]).withColumn("place", place).withColumn("shard", F.pmod(number(F.col("place")), F.col("shards")))
    held = rows.groupBy("none", "name", "shard", "source_quota").agg(F.sum(words).alias("shard_size"))
    quotas = apportion(held, ["none", "name"], ["shard"], "shard_size", "source_quota")
    size = F.nullif(F.col("shard_size"), F.lit(0))
    take = F.least(F.col("quota") * block, repeats * F.col("shard_size"))
    first = F.pmod(number(seeded(seed, F.concat_ws(":", F.col("none").cast("string"), F.col("name"), F.col("shard").cast("string")))), size)
    quotas = durable(quotas.select("none", "name", "shard", "shard_size", F.coalesce(F.floor(take / size), F.lit(0)).cast("long").alias("rounds"),
                                   F.coalesce(F.pmod(take, size), F.lit(0)).alias("run"), F.coalesce(first, F.lit(0)).alias("first")), "mix-quotas")

    before = Window.partitionBy("none", "name", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = (rows.withColumn("at", F.coalesce(F.sum(words).over(before), F.lit(0))).join(quotas, ["none", "name", "shard"])
            .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
            .withColumn("at", F.col("at") + F.col("copy") * F.col("size")))
    # the run from `first` on may pass the shard's end and go on at its beginning
    end, tail = F.col("first") + F.col("run"), F.col("first") + F.col("run") - F.col("shard_size")
    overlap = lambda a, b: F.greatest(F.lit(0).cast("long"), F.least(F.col("at") + F.col("size"), b) - F.greatest(F.col("at"), a))
    laid = laid.withColumn("__one", overlap(F.col("first"), F.least(end, F.col("shard_size")))).withColumn("__two", overlap(F.lit(0).cast("long"), tail))
    start = F.when(F.col("__one") > 0, F.greatest(F.lit(0).cast("long"), F.col("first") - F.col("at"))).when(F.col("__two") > 0, F.lit(0).cast("long"))
    return laid.select("doc_id", F.when(~F.col("none"), F.col("name")).alias("source"), "size", "source_size", "target",
                       (F.col("rounds") * F.col("size") + F.col("__one") + F.col("__two")).alias("taken"), "shard", start.alias("start"))
