"""Lemma search as a join: texts cut to pieces, windows of pieces joined with the rules, in the JVM alone.

A text is cut into runs of word characters and single other characters, in chunks that are rows of their own, so that a
very long text is many rows of bounded size.  A hit has no word character beside it, so it begins and ends with pieces,
and a rule is found as a window of as many pieces as it has.  Only hits are shuffled.

Of overlapping hits those stay that `detector.Detector` keeps: by end, then the longer one, each that begins at or after
the end of the last one kept.  A null or empty text has no hits; a null or repeated id is one text to the overlap
rule, so ids must tell texts apart.  Word characters are those of the JVM's Unicode version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonelake.functions.text import WORD, pieces, sums
from tonelake.sources.rulepack import Pack

ROWS = 128  # pieces a row
BROADCAST = 8 << 20  # bytes of terms up to which a pack is sent to all tasks
ZONES = ("code_fence", "code_inline", "quote")


def rules(spark: SparkSession, pack: Pack) -> tuple[DataFrame, list[int], bool]:
    """One row per term that isn't on the stop list: term, category, severity and its number of pieces; all numbers there
    are; and whether a term begins or ends with what is no word character.

    The numbers are worked out once: as an expression of the term Spark would work them out for all that is joined with it."""
    first = {}
    for x in pack.lemmas:
        if x.term and x.term not in pack.stop:
            first.setdefault(x.term, (x.term, x.category, x.severity))
    df = spark.createDataFrame(list(first.values()), "term string, category string, severity int")
    rows = df.select("*", F.size(pieces(F.col("term"))).alias("n"), (~F.col("term").rlike(f"(?s)^[{WORD}](.*[{WORD}])?$")).alias("open")).collect()
    df = spark.createDataFrame([tuple(r)[:4] for r in rows], "term string, category string, severity int, n int")
    small = sum(len(t.encode()) for t in first) <= BROADCAST
    return F.broadcast(df) if small else df, sorted({r.n for r in rows}) or [1], any(r.open for r in rows)


def candidates(docs: DataFrame, key: str, text: str, pack: Pack) -> DataFrame:
    """(key, term, category, severity, span_start, span_end) of every place of every lemma, overlapping ones too."""
    return _candidates(docs, key, text, pack)[0]


def _candidates(docs: DataFrame, key: str, text: str, pack: Pack) -> tuple[DataFrame, int]:
    """The same, and the number of pieces of the longest rule.

    A chunk's pieces are exploded and joined with the rules in generated code; the way from a chunk's begin to a piece is
    only measured for pieces that are hits."""
    found, lengths, neighbours = rules(docs.sparkSession, pack)
    more = lengths[-1] - (0 if neighbours else 1)  # pieces of the next chunk that this one's windows and their neighbours take
    cut = docs.select(F.col(key).alias("key"), F.col(text).alias("t")).select("key", pieces(F.col("t")).alias("p"))
    firsts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size("p") - 1) / ROWS).cast("int"), F.lit(0))), lambda k: k * ROWS)
    cut = cut.select("key", "p", firsts.alias("k"))
    cut = cut.select("key", "p", "k", F.transform("k", lambda k: F.slice("p", k + 1, F.lit(ROWS + more))).alias("c"))
    sizes = F.transform("c", lambda c: F.octet_length(F.array_join(F.slice(c, F.lit(1), F.lit(ROWS)), "")))
    before = [F.transform("k", lambda k: F.when(k > 0, F.element_at("p", F.greatest(k, F.lit(1))))).alias("before")] if neighbours else []
    rows = cut.select("key", F.explode(F.arrays_zip("c", sums(sizes).alias("base"), *before)).alias("r")).select("key", "r.*")
    each = rows.select("*", F.posexplode("c").alias("i", "piece")).filter(F.col("i") < ROWS)
    if len(lengths) > 1:
        each = each.withColumn("n", F.explode(F.array(*map(F.lit, lengths))))
    else:
        each = each.withColumn("n", F.lit(lengths[0]))
    term = F.col("piece") if lengths == [1] else F.when(F.col("n") == 1, F.col("piece")).otherwise(F.array_join(F.slice("c", F.col("i") + 1, F.col("n")), ""))
    sides = [F.when(F.col("i") == 0, F.col("before")).otherwise(F.try_element_at("c", F.greatest("i", F.lit(1)))).alias("l"), F.try_element_at("c", F.col("i") + F.col("n") + 1).alias("r")] if neighbours else []
    at = F.col("base") + F.octet_length(F.array_join(F.slice("c", F.lit(1), F.col("i")), ""))
    # near a text's end a window is shorter than asked for; it holds no rule of that many pieces
    hit = each.select("key", term.alias("term"), "n", at.alias("a"), *sides).join(found, ["term", "n"])
    if neighbours:  # a rule that begins or ends with another character needs one that is no word's beside it
        hit = hit.filter(~F.coalesce(F.col("l").rlike(f"[{WORD}]"), F.lit(False)) & ~F.coalesce(F.col("r").rlike(f"[{WORD}]"), F.lit(False)))
    hit = hit.select(F.col("key").alias(key), "term", "category", "severity", F.col("a").alias("span_start"), (F.col("a") + F.octet_length("term")).alias("span_end"))
    return hit, lengths[-1]


def kept_of(spans: Column) -> Column:
    """Those of an array of (end, minus length, ...) in order that begin at or after the end of the last one kept."""
    def step(acc: Column, x: Column) -> Column:
        fits = x["end"] + x["minus"] >= acc["taken"]
        return F.struct(F.when(fits, x["end"]).otherwise(acc["taken"]).alias("taken"), F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("taken"), F.slice(spans, F.lit(1), F.lit(0)).alias("kept")), step)["kept"]


def without_overlaps(found: DataFrame, key: str) -> DataFrame:
    """The hits that stay.  Runs of hits that touch no other run are folded on their own, so the fold is as long as a run."""
    order = Window.partitionBy(key).orderBy("span_start", "span_end")
    before = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = found.withColumn("__new", F.coalesce((F.col("span_start") >= before).cast("int"), F.lit(0)))
    runs = fresh.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    item = F.struct(F.col("span_end").alias("end"), (F.col("span_start") - F.col("span_end")).alias("minus"), "term", "category", "severity")
    folded = runs.groupBy(key, "__run").agg(kept_of(F.array_sort(F.collect_list(item))).alias("h"))
    return folded.select(key, F.explode("h").alias("h")).select(key, "h.term", "h.category", "h.severity", (F.col("h.end") + F.col("h.minus")).alias("span_start"), F.col("h.end").alias("span_end"))


def lemma_hits(docs: DataFrame, key: str, text: str, pack: Pack) -> DataFrame:
    """One row per lemma hit of a normalized text; offsets count bytes.  Rules of one piece each can't overlap."""
    found, longest = _candidates(docs, key, text, pack)
    return without_overlaps(found, key) if longest > 1 else found


def zone_tags(hits: DataFrame, areas: DataFrame, key: str, delta: int = -1) -> DataFrame:
    """hits with the `zones` that they overlap and the `level` that is left of their severity, at least 1.

    `areas` has a row per zone (key, type, start, end).  The zones of a kind don't overlap each other within a text, so the
    one that matters is the last to begin before a hit ends: one pass over both in order, not a comparison of all pairs."""
    every = [c for c in hits.columns if c != key]
    at = hits.select(key, F.struct(*every).alias("h"), F.col("span_end").alias("at"), F.lit(0).alias("turn"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("int").alias("end"))
    z = areas.select(key, F.lit(None).cast(at.schema["h"].dataType).alias("h"), F.col("start").alias("at"), F.lit(1).alias("turn"), "type", "end")
    w = Window.partitionBy(key).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    seen = at.unionByName(z).withColumns({f"__{k}": F.last(F.when(F.col("type") == k, F.col("end")), ignorenulls=True).over(w) for k in ZONES})
    tags = F.filter(F.array(*[F.when(F.col(f"__{k}") > F.col("h.span_start"), F.lit(k)) for k in ZONES]), lambda t: t.isNotNull())
    out = seen.filter("turn = 0").select(key, "h.*", tags.alias("zones"))
    return out.withColumn("level", F.greatest(F.lit(1), F.col("severity") + delta * F.size("zones")))
