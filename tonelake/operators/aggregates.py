"""Aggregates that have a name of their own in the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.scalars import ratio

OTHER = "__other__"


def distinct_of(c: str | Column, mode: str = "exact") -> Column:
    """Distinct values: exact, or by a HyperLogLog sketch of 2^12 cells, which needs no second shuffle."""
    return F.count_distinct(c) if mode == "exact" else F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(12)))


def hits_and_utterances(df: DataFrame, *keys: Column, mode: str = "exact") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("hits"), distinct_of("utterance_id", mode).alias("utterances"))


def latest_version(df: DataFrame, keys: list[str], *version: str) -> DataFrame:
    """One row per key, that of the largest version columns: what a replacing table shows once merged."""
    return best_per_key(df, keys, F.struct(*version)).select(*df.columns)


def top_n_other(df: DataFrame, key: str, measure: str, n: int) -> DataFrame:
    """The n keys of the largest measure, and the sum of all the others under one name.

    df is aggregated to one row per key; the n keys are picked by a top-k, not by a global window."""
    head = df.orderBy(F.desc(measure), F.asc(key)).limit(n).select(F.col(key).alias("__key"))
    head = head.withColumn("__in", F.lit(True))
    name = F.when(F.col("__in"), F.col(key)).otherwise(F.lit(OTHER))
    return (df.join(F.broadcast(head), F.col(key).eqNullSafe(F.col("__key")), "left").withColumn(key, name)
            .groupBy(key).agg(F.sum(measure).alias(measure)))


def with_share(df: DataFrame, measure: str, name: str = "share", total: DataFrame | None = None) -> DataFrame:
    """Each row's part of the grand total, joined as a one-row table instead of a window over one partition."""
    whole = (total if total is not None else df).agg(F.sum(measure).alias("__total"))
    return df.crossJoin(F.broadcast(whole)).withColumn(name, ratio(F.col(measure), F.col("__total"))).drop("__total")


def severity_pivot(df: DataFrame, *keys: Column) -> DataFrame:
    """One column per severity and a total; a fixed pivot, so one pass with conditional counts."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return df.groupBy(*keys).agg(count("mild"), count("strong"), count("slur_masked"), F.count("*").alias("total"))


def severity_index(mild: Column, strong: Column, slur: Column) -> Column:
    return ratio(1.0 * mild + 2.0 * strong + 3.0 * slur, mild + strong + slur)


def quartiles(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Median and quartiles with linear interpolation."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(q.alias("__q")).select(*keys, F.col("__q")[1].alias("median"), F.col("__q")[0].alias("p25"), F.col("__q")[2].alias("p75"))


def best_per_key(df: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """The row of the largest rank of each key, as a grouped max_by that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__best")).select(*keys, "__best.*")


def frequency_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """key -> map of value -> count; counts are grouped first, so the collected list is as long as the map."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))


def largest_of_map(m: Column, fallback: Column) -> Column:
    """The key of the largest value, the first by name among equals; the fallback for an empty or missing map."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return F.coalesce(F.try_element_at(F.array_sort(entries), F.lit(1))["k"], fallback)


def hour_states(utterances: DataFrame) -> DataFrame:
    """Mergeable sums, counts and sketches per hour, repository, actor, source and language."""
    sent = F.col("sentiment_score").cast("double")
    return (utterances.groupBy(F.date_trunc("hour", "created_at").alias("bucket_hour"), "repo_hid", "actor_hid", "source", "lang_code", "lang_reliable")
            .agg(F.hll_sketch_agg("id", F.lit(12)).alias("u_sketch"), F.count_distinct("id").alias("cnt"),
                 F.sum(F.octet_length("text_raw")).cast("long").alias("text_sum"),
                 F.kll_sketch_agg_double(F.octet_length("text_raw").cast("double")).alias("text_q"),
                 F.count(sent).alias("sent_cnt"), F.sum(sent).alias("sent_sum"),
                 F.kll_sketch_agg_double(F.when(sent.isNotNull(), sent)).alias("sent_q"),
                 F.min("created_at").alias("min_at"), F.max("created_at").alias("max_at")))


def merge_states(states: DataFrame, *keys: Column | str) -> DataFrame:
    """States of fewer keys from states of more; merging in any order gives the same exact columns."""
    return states.groupBy(*keys).agg(
        F.hll_union_agg("u_sketch").alias("u_sketch"), F.sum("cnt").alias("cnt"), F.sum("text_sum").alias("text_sum"),
        F.kll_merge_agg_double("text_q").alias("text_q"), F.sum("sent_cnt").alias("sent_cnt"), F.sum("sent_sum").alias("sent_sum"),
        F.kll_merge_agg_double("sent_q").alias("sent_q"),
        F.min("min_at").alias("min_at"), F.max("max_at").alias("max_at"))


def read_states(merged: DataFrame, *keys: str) -> DataFrame:
    """What merged states say: exact counts and means, estimated distinct ids and quantiles."""
    q = lambda sketch: F.kll_sketch_get_quantile_double(sketch, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return merged.select(*keys, F.hll_sketch_estimate("u_sketch").alias("uniq"), "cnt", "text_sum", q(F.col("text_q")).alias("text_quantiles"),
                         "sent_cnt", F.try_divide("sent_sum", "sent_cnt").alias("sent_avg"),
                         q(F.when(F.col("sent_cnt") > 0, F.col("sent_q"))).alias("sent_quantiles"), "min_at", "max_at")


def heavy_states(df: DataFrame, item: Column, *keys: Column | str, tracked: int = 384) -> DataFrame:
    """Per key a bounded state of an item's heavy hitters and the number of rows, which merges in any order.

    Nulls count as an item of their own."""
    return df.groupBy(*keys).agg(F.call_function("approx_top_k_accumulate", item, F.lit(tracked)).alias("heavy"), F.count("*").alias("rows"))


def merge_heavy(states: DataFrame, *keys: Column | str, tracked: int = 384) -> DataFrame:
    return states.groupBy(*keys).agg(F.call_function("approx_top_k_combine", "heavy", F.lit(tracked)).alias("heavy"), F.sum("rows").alias("rows"))


def guaranteed_share(tracked: int) -> float:
    """The share of a key's rows above which an item is surely found: the state's table has the next power of two of
    tracked / 0.75 cells, its counts are off by at most 3.5 / cells of the rows, and an item is told if it is above that
    even at its least."""
    cells = 1
    while cells * 0.75 < tracked:
        cells *= 2
    return 8 / cells


def heavy_items(merged: DataFrame, *keys: str, tracked: int = 384) -> DataFrame:
    """(keys, item, estimate) of all items that the states tell; none above `guaranteed_share` is missing."""
    told = F.call_function("approx_top_k_estimate", F.col("heavy"), F.lit(tracked))
    return merged.select(*keys, F.explode(told).alias("h")).select(*keys, "h.item", F.col("h.count").alias("estimate"))
