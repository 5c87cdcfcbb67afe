"""The analytic endpoints, each a single plan from the two fact tables to the rows of the answer.

`crimes` has one row per hit, `states` hourly counts of all utterances.  Both sides of a ratio are aggregated to the
answer's grain before they meet in a full outer join, so what is joined is as small as the answer.  Missing sides
count as zero.  `mode` chooses exact or estimated distinct counts.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.dates import bucket, calendar, local, sunday_zero
from tonelake.functions.ids import hid_hex, label
from tonelake.functions.scalars import or_label, ratio
from tonelake.operators.aggregates import distinct_of, quartiles, severity_index, severity_pivot, top_n_other, with_share
from tonelake.operators.scope import Scope, hits_in, states_in


def _zero(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in columns})


def _dense(df: DataFrame, scope: Scope, *columns: str) -> DataFrame:
    """All buckets of the range; months stay as they are."""
    if scope.interval == "month":
        return df
    return _zero(calendar(df.sparkSession, scope.first, scope.last, scope.interval).join(df, "t", "left"), *columns)


def timeseries_hits(crimes: DataFrame, states: DataFrame, scope: Scope, mode: str = "exact") -> DataFrame:
    c = hits_in(crimes, scope).groupBy(bucket(F.col("created_at"), scope.interval, scope.tz).alias("t")).agg(
        F.count("*").alias("hits"), distinct_of("utterance_id", mode).alias("offending_utterances"))
    u = states_in(states, scope).groupBy(bucket(F.col("bucket_hour"), scope.interval, scope.tz).alias("t")).agg(F.sum("cnt").alias("all_utterances"))
    names = ("hits", "offending_utterances", "all_utterances")
    both = _dense(_zero(c.join(u, "t", "full"), *names), scope, *names)
    return both.select("t", *names, ratio(F.col("hits"), F.col("offending_utterances")).alias("intensity"),
                       ratio(F.col("offending_utterances"), F.col("all_utterances")).alias("coverage"),
                       ratio(F.col("hits"), F.col("all_utterances")).alias("rarity"))


def ratios_time(crimes: DataFrame, states: DataFrame, scope: Scope) -> DataFrame:
    return timeseries_hits(crimes, states, scope).select("t", "hits", F.col("all_utterances").alias("utterances"), F.col("rarity").alias("ratio"))


def heatmap_weekly(crimes: DataFrame, states: DataFrame, scope: Scope, metric: str = "rarity", mode: str = "exact") -> DataFrame:
    """All 7 x 24 cells, Sunday first; z is the chosen metric."""
    def cell(c: str) -> tuple[Column, Column]:
        at = local(F.col(c), scope.tz)
        return sunday_zero(at).alias("dow"), F.hour(at).alias("hour")

    c = hits_in(crimes, scope).groupBy(*cell("created_at")).agg(F.count("*").alias("hits"), distinct_of("utterance_id", mode).alias("offending_utterances"))
    u = states_in(states, scope).groupBy(*cell("bucket_hour")).agg(F.sum("cnt").alias("utterances"))
    grid = crimes.sparkSession.range(168).select((F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    df = _zero(grid.join(c.join(u, ["dow", "hour"], "full"), ["dow", "hour"], "left"), "hits", "offending_utterances", "utterances")
    values = {"intensity": ratio(F.col("hits"), F.col("offending_utterances")), "coverage": ratio(F.col("offending_utterances"), F.col("utterances")),
              "rarity": ratio(F.col("hits"), F.col("utterances")), "counts": F.col("hits").cast("double")}
    return df.select("*", values["rarity"].alias("ratio"), values[metric].alias("z"))


def lang_bars(crimes: DataFrame, states: DataFrame, scope: Scope, series: str = "hits", limit: int = 25, mode: str = "exact") -> DataFrame:
    """Languages by the chosen series, largest first."""
    lang = or_label(F.col("lang_code"), "unknown").alias("lang")
    c = hits_in(crimes, scope).groupBy(lang).agg(F.count("*").alias("n_hits"), distinct_of("utterance_id", mode).alias("off_utt"))
    u = states_in(states, scope).groupBy(lang).agg(F.sum("cnt").alias("all_utt"))
    df = _zero(c.join(u, "lang", "full"), "n_hits", "off_utt", "all_utt")
    chosen = {"hits": "n_hits", "offending": "off_utt", "all": "all_utt"}[series]
    return (df.orderBy(F.desc(chosen), F.asc("lang")).limit(min(max(limit, 1), 200))
            .select("lang", F.col(chosen).alias("hits"), F.col("all_utt").alias("utterances"), ratio(F.col("n_hits"), F.col("all_utt")).alias("ratio")))


def categories_stack(crimes: DataFrame, scope: Scope, top: int = 10, sort: str = "total") -> DataFrame:
    """Categories by severity; those beyond the top are added up under one name."""
    per = severity_pivot(hits_in(crimes, scope), or_label(F.col("category"), "__unknown__").alias("key"))
    head = per.orderBy(F.desc(sort), F.asc("key")).limit(top).select("key", F.lit(True).alias("__in"))
    sums = [F.sum(c).alias(c) for c in ("mild", "strong", "slur_masked", "total")]
    df = (per.join(F.broadcast(head), "key", "left").groupBy(F.when(F.col("__in"), F.col("key")).otherwise("__other__").alias("key")).agg(*sums))
    df = with_share(df, "total", "share")
    return df.select("key", "mild", "strong", "slur_masked", "total", "share",
                     *[ratio(F.col(s), F.col("total")).alias(f"share_{s}") for s in ("mild", "strong", "slur_masked")])


def kpi_strip(crimes: DataFrame, states: DataFrame, scope: Scope, mode: str = "exact") -> DataFrame:
    c = hits_in(crimes, scope).agg(F.count("*").alias("hits"), distinct_of("utterance_id", mode).alias("offending_utterances"),
                                   distinct_of("repo_hid", mode).alias("repos"), distinct_of("actor_hid", mode).alias("actors"))
    u = states_in(states, scope).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("all_utterances"))
    return c.crossJoin(u).select(
        F.lit(str(scope.first)).alias("day"), "hits", "offending_utterances", "repos", "actors", "all_utterances",
        ratio(F.col("hits"), F.col("offending_utterances")).alias("intensity"), ratio(F.col("offending_utterances"), F.col("all_utterances")).alias("coverage"),
        ratio(F.col("hits"), F.col("all_utterances")).alias("rarity"))


def year_bounds(crimes: DataFrame, states: DataFrame, this_year: int, most: int = 20) -> DataFrame:
    """First and last year with data, of the hits or else of all utterances, not beyond this year, the latest `most` of them."""
    of = lambda df, c: df.agg(F.min(F.year(c)).alias("a"), F.max(F.year(c)).alias("b"))
    h, u = of(crimes, "created_at"), of(states, "bucket_hour").withColumnsRenamed({"a": "ua", "b": "ub"})
    last = F.least(F.coalesce("b", "ub", F.lit(this_year)), F.lit(this_year))
    first = F.least(F.coalesce("a", "ua", F.lit(this_year)), last)
    return h.crossJoin(u).select(F.greatest(first, last - most + 1).alias("first_year"), last.alias("last_year"))


def monthly(crimes: DataFrame, states: DataFrame, first_year: int, last_year: int, scope: Scope | None = None) -> DataFrame:
    """Every month of every year: hits, hits per utterance, and the mean severity."""
    scope = scope or Scope(date(first_year, 1, 1), date(last_year, 12, 31))
    c = severity_pivot(hits_in(crimes, scope), F.year("created_at").alias("year"), F.month("created_at").alias("month")).withColumnRenamed("total", "hits")
    u = states_in(states, scope).groupBy(F.year("bucket_hour").alias("year"), F.month("bucket_hour").alias("month")).agg(F.sum("cnt").alias("utterances"))
    n = (last_year - first_year + 1) * 12
    grid = crimes.sparkSession.range(n).select((F.lit(first_year) + F.col("id") / 12).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))
    df = _zero(grid.join(c.join(u, ["year", "month"], "full"), ["year", "month"], "left"), "hits", "mild", "strong", "slur_masked", "utterances")
    return df.select("year", "month", "hits", "utterances", ratio(F.col("hits"), F.col("utterances")).alias("rate"),
                     severity_index(F.col("mild"), F.col("strong"), F.col("slur_masked")).alias("severity"))


def seasonality(months: DataFrame) -> DataFrame:
    """Median and quartiles over the years of each metric in each calendar month."""
    long = months.select("month", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("hits", "rate", "severity")])).alias("x"))
    return quartiles(long.select("month", "x.metric", "x.value"), "value", "metric", "month")


def category_mix(crimes: DataFrame, last_year: int, key: str = "category") -> DataFrame:
    """Shares of the last two years, largest first."""
    both = hits_in(crimes, Scope(date(last_year - 1, 1, 1), date(last_year, 12, 31)))  # a range, which reaches the scan
    df = both.groupBy(F.year("created_at").alias("year"), or_label(F.col(key), "unknown").alias("key")).agg(F.count("*").alias("hits"))
    whole = df.groupBy("year").agg(F.sum("hits").alias("of"))
    return df.join(F.broadcast(whole), "year").select("year", "key", "hits", ratio(F.col("hits"), F.col("of")).alias("share"))


def detver_markers(crimes: DataFrame) -> DataFrame:
    return crimes.groupBy(F.col("detver").alias("version")).agg(F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("first_day"))


def yearly_trends(crimes: DataFrame, states: DataFrame, first_year: int, last_year: int, include: tuple[str, ...] = (), scope: Scope | None = None) -> dict[str, DataFrame]:
    """The parts of the yearly answer by name; an include list leaves out the others, which are then never planned."""
    months = monthly(crimes, states, first_year, last_year, scope)
    parts = {"monthly": lambda: months, "seasonality": lambda: seasonality(months), "mix": lambda: category_mix(crimes, last_year),
             "detver_markers": lambda: detver_markers(crimes), "year_over_year": lambda: year_over_year(months)}
    return {name: make() for name, make in parts.items() if not include or name in include}


def year_over_year(months: DataFrame, metric: str = "hits") -> DataFrame:
    """Change against the same month a year before; null where that was zero or is missing."""
    w = Window.partitionBy("month").orderBy("year")  # dense months, so the row before is the year before
    return months.select("year", "month", metric, (F.try_divide(F.col(metric).cast("double"), F.lag(metric).over(w).cast("double")) - 1).alias("yoy"))


def _series_by(crimes: DataFrame, scope: Scope, key: str, of: DataFrame | None = None) -> DataFrame:
    """Dense series of hits for each value of a key."""
    c = hits_in(crimes, scope).groupBy(key, bucket(F.col("created_at"), scope.interval, scope.tz).alias("t")).agg(F.count("*").alias("hits"))
    if scope.interval == "month":
        return c
    values = of if of is not None else c.select(key).distinct()
    grid = values.crossJoin(F.broadcast(calendar(crimes.sparkSession, scope.first, scope.last, scope.interval)))
    return _zero(grid.join(c, [key, "t"], "left"), "hits")


def timeseries_detver(crimes: DataFrame, scope: Scope) -> DataFrame:
    return _series_by(crimes, scope, "detver")


def timeseries_severity(crimes: DataFrame, scope: Scope) -> DataFrame:
    return _series_by(crimes, scope, "severity")


def timeseries_term(crimes: DataFrame, scope: Scope, terms: list[str]) -> DataFrame:
    asked = crimes.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return _series_by(crimes.filter(F.col("term").isin(*terms)), scope, "term", asked)


def hits_hourly(crimes: DataFrame, scope: Scope) -> DataFrame:
    return hits_in(crimes, scope).groupBy(bucket(F.col("created_at"), "hour", scope.tz).alias("t")).agg(F.count("*").alias("hits"))


def code_lang_bars(crimes: DataFrame, repositories: DataFrame, scope: Scope, limit: int = 25) -> DataFrame:
    """Hits by the main language of the repository; they are grouped by repository before the catalogue is joined."""
    per = hits_in(crimes, scope).groupBy("repo_hid").agg(F.count("*").alias("hits"))
    named = per.join(repositories.select("repo_hid", "primary_lang"), "repo_hid", "left")
    df = named.groupBy(or_label(F.col("primary_lang"), "unknown").alias("code_lang")).agg(F.sum("hits").alias("hits"), F.count("*").alias("repos"))
    return with_share(df, "hits", "ratio").orderBy(F.desc("hits"), F.asc("code_lang")).limit(limit)


def terms_top(crimes: DataFrame, scope: Scope, limit: int = 25, after: tuple[int, str] | None = None) -> DataFrame:
    """Terms by hits; `after` is (hits, term) of the last row of the page before."""
    df = hits_in(crimes, scope).groupBy("term").agg(F.count("*").alias("hits"), F.count_distinct("utterance_id").alias("utterances"))
    df = with_share(df, "hits", "ratio")
    if after:
        df = df.filter((F.col("hits") < after[0]) | (F.col("hits") == after[0]) & (F.col("term") > after[1]))
    return df.orderBy(F.desc("hits"), F.asc("term")).limit(limit)


def targets_mix(crimes: DataFrame, scope: Scope) -> DataFrame:
    target = F.when(F.coalesce("target_type", F.lit("none")) == "none", "generic").otherwise(F.col("target_type"))
    return hits_in(crimes, scope).groupBy(target.alias("target")).agg(F.count("*").alias("hits"))


def terms_matrix(crimes: DataFrame, scope: Scope, terms: int = 20) -> DataFrame:
    """Cells of the leading terms by language."""
    df = hits_in(crimes, scope).groupBy("term", or_label(F.col("lang_code"), "unknown").alias("lang")).agg(F.count("*").alias("hits"))
    head = df.groupBy("term").agg(F.sum("hits").alias("n")).orderBy(F.desc("n"), F.asc("term")).limit(terms).select("term")
    return df.join(F.broadcast(head), "term", "left_semi")


def overview(crimes: DataFrame, scope: Scope, top: int = 10) -> dict[str, DataFrame]:
    """Series, category mix and leading terms of what the scope names (one repository or one actor)."""
    own = hits_in(crimes, scope)
    return {"series": _dense(own.groupBy(bucket(F.col("created_at"), scope.interval, scope.tz).alias("t")).agg(F.count("*").alias("hits")), scope, "hits"),
            "mix": own.groupBy("category").agg(F.count("*").alias("hits")),
            "terms": own.groupBy("term").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), F.asc("term")).limit(top)}


def spike_drivers(crimes: DataFrame, scope: Scope, baseline: Scope, key: str, limit: int = 20) -> DataFrame:
    """What grew or shrank most against the baseline, in one pass over both ranges."""
    from tonelake.functions.dates import in_days

    now, then = (in_days(F.col("created_at"), s.first, s.last) for s in (scope, baseline))
    df = crimes.filter(now | then).groupBy(F.col(key).alias("key")).agg(F.count_if(now).alias("hits"), F.count_if(then).alias("baseline"))
    return df.withColumn("delta", F.col("hits") - F.col("baseline")).orderBy(F.desc(F.abs("delta")), F.asc("key")).limit(limit)


def leaders(crimes: DataFrame, scope: Scope, key: str, limit: int = 25) -> DataFrame:
    df = with_share(hits_in(crimes, scope).groupBy(key).agg(F.count("*").alias("hits")), "hits", "ratio")
    df = df.select(hid_hex(F.col(key)).alias("hid"), label(F.col(key)).alias("label"), "hits", "ratio")
    return df.orderBy(F.desc("hits"), F.asc("hid")).limit(limit)


def terms_suggest(crimes: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    df = crimes.filter(F.startswith(F.lower("term"), F.lit(prefix.lower()))).groupBy("term").agg(F.count("*").alias("hits"))
    return df.orderBy(F.desc("hits"), F.asc("term")).limit(limit)


def crosstab_repo_actor(crimes: DataFrame, scope: Scope) -> DataFrame:
    return hits_in(crimes, scope).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), hid_hex(F.col("repo_hid")).alias("repo"), hid_hex(F.col("actor_hid")).alias("actor")).agg(F.count("*").alias("hits"))


def clamped(limit: int, usual: int, most: int | None = None) -> int:
    """A page size: the usual one where none, or one beyond the most, is asked for."""
    return usual if limit <= 0 or most is not None and limit > most else limit


def samples_masked(crimes: DataFrame, utterances: DataFrame, text: str = "text_normalized", limit: int = 50) -> DataFrame:
    """The latest utterances with hits, each with its hits, and the hits' spans hidden in the text.

    Spans count bytes of the normalized text, and each hidden byte gives one asterisk.  Hits are collected of the page's
    utterances alone."""
    page = crimes.groupBy("utterance_id").agg(F.max("created_at").alias("created_at")).orderBy(F.desc("created_at"), F.asc("utterance_id")).limit(clamped(limit, 50, 200))
    own = crimes.drop("created_at").join(F.broadcast(page), "utterance_id")
    latest = own.groupBy("utterance_id", "created_at").agg(F.array_sort(F.collect_set(F.struct("span_start", "span_end", "term", "severity"))).alias("hits"))
    joined = utterances.select(F.col("id").alias("utterance_id"), F.col(text).cast("binary").alias("text")).join(F.broadcast(latest), "utterance_id")

    def hide(t: Column, h: Column) -> Column:
        size = (h["span_end"] - h["span_start"]).cast("int")
        return F.overlay(t, F.repeat(F.lit("*"), size).cast("binary"), (h["span_start"] + 1).cast("int"), size)

    return joined.select("utterance_id", "created_at", "hits", F.aggregate("hits", F.col("text"), hide).cast("string").alias("masked"))


def samples_latest(crimes: DataFrame, utterances: DataFrame, limit: int = 50) -> DataFrame:
    """The latest hits with their texts.  Hits are ranked by their ids alone; only the texts of the page are fetched."""
    there = crimes.join(utterances.select(F.col("id").alias("utterance_id")), "utterance_id", "left_semi")
    page = there.orderBy(F.desc("created_at"), "hit_id").limit(clamped(limit, 50, 200))
    texts = utterances.select(F.col("id").alias("utterance_id"), "text_raw")
    return texts.join(F.broadcast(page), "utterance_id").select("created_at", "hit_id", "term", "text_raw")


def stats_by_lang(crimes: DataFrame, utterances: DataFrame, least_rank: int) -> DataFrame:
    """Per day and language all utterances and the hits of at least a severity; days without hits stay."""
    from tonelake.functions.scalars import severity_rank

    day_lang = [F.date_format("created_at", "yyyy-MM-dd").alias("day"), F.coalesce("lang_code", F.lit("und")).alias("lang")]
    u = utterances.groupBy(*day_lang).agg(F.count("*").alias("utterances"))
    h = crimes.filter(severity_rank(F.col("severity")) >= least_rank).groupBy(*day_lang).agg(F.count("*").alias("hits"), F.count_distinct("utterance_id").alias("offending"))
    return _zero(u.join(h, ["day", "lang"], "left"), "hits", "offending")


def stats_by_repo(crimes: DataFrame, scope: Scope, limit: int = 200) -> DataFrame:
    df = hits_in(crimes, scope).groupBy(hid_hex(F.col("repo_hid")).alias("repo")).agg(F.count("*").alias("hits"), F.count_distinct("utterance_id").alias("utterances"))
    return df.orderBy(F.desc("hits"), F.asc("repo")).limit(limit)


def list_samples(crimes: DataFrame, scope: Scope, after: tuple | None = None, limit: int = 100) -> DataFrame:
    """A page in order of time and hit; `after` is (created_at, hit_id) of the last row of the page before."""
    df = hits_in(crimes, scope)
    if after:
        at = F.lit(after[0]).cast("timestamp")
        df = df.filter((F.col("created_at") > at) | (F.col("created_at") == at) & (F.col("hit_id") > after[1]))
    return df.orderBy("created_at", "hit_id").limit(clamped(limit, 100))


def birds_eye(daily: DataFrame) -> DataFrame:
    """Sum of hits, mean daily intensity, and the day of largest coverage, of a daily series."""
    return daily.agg(F.sum("hits").alias("ytd_hits"), F.round(F.avg("intensity"), 3).alias("mean_intensity"),
                     F.max_by("t", F.struct("coverage", "t")).alias("peak_day"))


def lang_rollup(crimes: DataFrame, scope: Scope, n: int) -> DataFrame:
    """The leading languages and all others together."""
    df = hits_in(crimes, scope).groupBy(or_label(F.col("lang_code"), "unknown").alias("lang")).agg(F.count("*").alias("hits"))
    return top_n_other(df, "lang", "hits", n)
