"""The registered queries: each a name, a Spark function of (spark, sf_dir), and the same query as SQL for DuckDB.

Names begin with the kind of operator: v views, e endpoints, and letters for filters (f), projections (p), joins (j),
aggregates (a), windows (w), top lists (t), sets (u), sources (s), text (l), pipeline rules (r), scalars (x).
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import dates, ids, scalars, text
from tonelake.functions.ids import hid_hex
from tonelake.operators import aggregates as agg
from tonelake.operators import consent, joins, language, ledger, lemmas
from tonelake.operators.detector import Options, detect, hits
from tonelake.operators.scope import Scope, hits_in, predicate
from tonelake.plans import ask, compact, endpoints, views
from tonelake.session import spread
from tonelake.sources import bucketed, database, facts, hourly, retention, sinks
from tonelake.sources.facts import read, with_facts
from tonelake.sources.rulepack import OWN, Lemma, Pack, from_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FIRST, LAST = date(2024, 1, 3), date(2024, 1, 25)
SCOPE = Scope(FIRST, LAST)
EVERY_HIT = Options(max_hits=0)
BERLIN = Scope(FIRST, LAST, tz="Europe/Berlin")
WEEKS = Scope(FIRST, LAST, interval="week")
HOURS = Scope(date(2024, 1, 3), date(2024, 1, 5), interval="hour")
MONTHS = Scope(date(2024, 1, 1), date(2024, 1, 31), interval="month")
NARROW = Scope(FIRST, LAST, detver=2, lang_codes=("en", "fr"), lang_reliable=True)
IN_RANGE = "created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-26'"
LOCAL = "((created_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _ratio(a: str, b: str, name: str) -> str:
    return f"COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0) AS {name}"


# ---------------------------------------------------------------- views

_KEY_SQL = {
    "day": "CAST(created_at AS DATE)", "hour": "date_trunc('hour', created_at)", "lang": "COALESCE(lang_code, '')", "dow": "CAST(isodow(created_at) - 1 AS INT)", "hod": "CAST(hour(created_at) AS INT)",
}
_VIEW_KEYS = {
    "timeseries_daily": "day detver", "timeseries_hourly": "hour detver", "heatmap_weekly": "dow hod", "lang_breakdown": "lang", "category_severity": "category severity",
    "repo_day": "day repo detver category severity", "actor_timeseries_daily": "day actor detver", "actor_timeseries_hourly": "hour actor detver", "actor_day": "day actor detver category severity",
    "actor_lang_breakdown": "actor lang", "actor_category_severity": "actor category severity", "actor_repo_day": "day actor repo detver",
}


def _edge(df: DataFrame) -> DataFrame:
    """Keys as hex text, days and times as text."""
    for c, kind in df.dtypes:
        if kind == "binary":
            df = df.withColumn(c, hid_hex(F.col(c))).withColumnRenamed(c, c.removesuffix("_hid"))
        elif kind == "date":
            df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
        elif kind == "timestamp":
            df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


def _time_sql(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%d %H:%M:%S')"


def _view_sql(keys: str, measures: str = "count(*) AS hits, count(DISTINCT utterance_id) AS utterances") -> str:
    names, shown = keys.split(), []
    for k in names:
        e = _KEY_SQL.get(k, k)
        shown.append(f"{f'CAST({e} AS VARCHAR)' if k == 'day' else _time_sql(e) if k == 'hour' else e} AS {k}")
    return with_facts(f"SELECT {', '.join(shown)}, {measures} FROM crimes GROUP BY {', '.join(_KEY_SQL.get(k, k) for k in names)}")


_VIEW_SQL = {name: _view_sql(keys) for name, keys in _VIEW_KEYS.items()} | {
    "hits_by_detver_daily": _view_sql("day detver", "count(*) AS hits"),
    "top_terms_hour": with_facts(f"""SELECT {_time_sql('bucket_hour')} AS bucket_hour, detver, lang, term_id, term, hits, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY bucket_hour, detver ORDER BY hits DESC, term_id, lang) AS INT) AS rank FROM (
          SELECT bucket_hour, detver, COALESCE(lang_code, '') AS lang, term_id, min(term) AS term, count(*) AS hits FROM crimes GROUP BY ALL)) WHERE rank <= 20"""),
    "actor_top_terms_daily": with_facts("""SELECT CAST(day AS VARCHAR) AS day, actor, detver, lang, term_id, term, hits, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY day, actor, detver ORDER BY hits DESC, term_id, lang) AS INT) AS rank FROM (
          SELECT CAST(created_at AS DATE) AS day, actor, detver, COALESCE(lang_code, '') AS lang, term_id, min(term) AS term, count(*) AS hits FROM crimes GROUP BY ALL)) WHERE rank <= 20"""),
    "samples_latest": with_facts(f"""SELECT {_time_sql('created_at')} AS created_at, hit_id, utterance_id, term_id, repo, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY term_id, repo ORDER BY created_at DESC, hit_id) AS INT) AS rank FROM crimes) WHERE rank <= 50"""),
    "actor_leaderboard": with_facts(f"SELECT actor, count(*) AS hits, count(DISTINCT utterance_id) AS utterances, {_time_sql('min(created_at)')} AS first_seen, {_time_sql('max(created_at)')} AS last_seen FROM crimes GROUP BY actor"),
}


def _view(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = views.VIEWS[name](facts.crimes(spark, sf_dir))
        if name == "samples_latest":
            df = df.select("created_at", "hit_id", "utterance_id", "term_id", "repo_hid", "rank")
        return _edge(df)

    return run


for _k, _name in enumerate(views.VIEWS, 1):
    query(f"v{_k:02}_{_name}", _VIEW_SQL[_name])(_view(_name))


# ---------------------------------------------------------------- endpoints

def _series_sql(bucket: str, bounds: str = IN_RANGE, state_bounds: str | None = None, days: str | None = None, more: str = "", state_more: str = "") -> str:
    """E1: both sides by bucket, full join, and the calendar where one is given."""
    names = "hits, offending_utterances, all_utterances"
    extra = f"""
c AS (SELECT {bucket} AS t, count(*) AS hits, count(DISTINCT utterance_id) AS offending_utterances FROM crimes WHERE {bounds}{more} GROUP BY 1),
u AS (SELECT {bucket} AS t, count(*) AS all_utterances FROM utterances WHERE {state_bounds or bounds}{state_more} GROUP BY 1),
both_sides AS (SELECT COALESCE(c.t, u.t) AS t, COALESCE(hits, 0) AS hits, COALESCE(offending_utterances, 0) AS offending_utterances, COALESCE(all_utterances, 0) AS all_utterances FROM c FULL JOIN u ON c.t = u.t)"""
    body = f"(SELECT d.t, COALESCE(hits, 0) AS hits, COALESCE(offending_utterances, 0) AS offending_utterances, COALESCE(all_utterances, 0) AS all_utterances FROM ({days}) d LEFT JOIN both_sides b ON b.t = d.t)" if days else "both_sides"
    return with_facts(f"""SELECT t, {names}, {_ratio('hits', 'offending_utterances', 'intensity')}, {_ratio('offending_utterances', 'all_utterances', 'coverage')}, {_ratio('hits', 'all_utterances', 'rarity')} FROM {body}""", extra)


def _days(first: str, last: str, step: str, fmt: str) -> str:
    return f"SELECT strftime(x, '{fmt}') AS t FROM (SELECT unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL {step})) AS x)"


DAYS = _days("2024-01-03", "2024-01-25", "1 DAY", "%Y-%m-%d")
SUNDAY = "strftime(CAST(created_at AS DATE) - CAST(dayofweek(created_at) AS INT), '%Y-%m-%d')"


@query("e01_timeseries_hits", _series_sql(f"strftime({LOCAL}, '%Y-%m-%d')", days=DAYS))
def _(spark, sf):
    return endpoints.timeseries_hits(facts.crimes(spark, sf), facts.counts(spark, sf), BERLIN)


@query("e01_timeseries_hits_week", _series_sql(SUNDAY, days=_days("2023-12-31", "2024-01-25", "7 DAYS", "%Y-%m-%d")))
def _(spark, sf):
    return endpoints.timeseries_hits(facts.crimes(spark, sf), facts.counts(spark, sf), WEEKS)


@query("e01_timeseries_hits_hour", _series_sql("strftime(created_at, '%Y-%m-%dT%H:00:00')", "created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-06'",
                                               days=_days("2024-01-03", "2024-01-05 23:00:00", "1 HOUR", "%Y-%m-%dT%H:00:00")))
def _(spark, sf):
    return endpoints.timeseries_hits(facts.crimes(spark, sf), facts.counts(spark, sf), HOURS)


@query("e01_timeseries_hits_month", _series_sql("strftime(created_at, '%Y-%m-01')", "created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-02-01'"))
def _(spark, sf):
    return endpoints.timeseries_hits(facts.crimes(spark, sf), facts.counts(spark, sf), MONTHS)


_NARROW = " AND lang_code IN ('en', 'fr') AND lang_reliable"


@query("f02_scope_both_sides", _series_sql("strftime(created_at, '%Y-%m-%d')", days=DAYS, more=_NARROW + " AND detver = 2", state_more=_NARROW))
def _(spark, sf):
    return endpoints.timeseries_hits(facts.crimes(spark, sf), facts.counts(spark, sf), NARROW)


@query("e02_heatmap_weekly", with_facts(f"""SELECT g.dow, g.hour, COALESCE(hits, 0) AS hits, COALESCE(offending_utterances, 0) AS offending_utterances, COALESCE(utterances, 0) AS utterances,
  {_ratio('COALESCE(hits, 0)', 'utterances', 'ratio')}, {_ratio('COALESCE(hits, 0)', 'offending_utterances', 'z')}
  FROM (SELECT CAST(i // 24 AS INT) AS dow, CAST(i % 24 AS INT) AS hour FROM range(168) AS r(i)) g LEFT JOIN c ON c.dow = g.dow AND c.hour = g.hour LEFT JOIN u ON u.dow = g.dow AND u.hour = g.hour""", f"""
c AS (SELECT dayofweek({LOCAL}) AS dow, hour({LOCAL}) AS hour, count(*) AS hits, count(DISTINCT utterance_id) AS offending_utterances FROM crimes WHERE {IN_RANGE} GROUP BY 1, 2),
u AS (SELECT dayofweek({LOCAL}) AS dow, hour({LOCAL}) AS hour, count(*) AS utterances FROM utterances WHERE {IN_RANGE} GROUP BY 1, 2)"""))
def _(spark, sf):
    return endpoints.heatmap_weekly(facts.crimes(spark, sf), facts.counts(spark, sf), BERLIN, "intensity")


@query("e03_lang_bars", with_facts(f"""SELECT COALESCE(c.lang, u.lang) AS lang, COALESCE(off_utt, 0) AS hits, COALESCE(all_utt, 0) AS utterances, {_ratio('COALESCE(n_hits, 0)', 'all_utt', 'ratio')} FROM c FULL JOIN u ON c.lang = u.lang ORDER BY hits DESC, lang LIMIT 3""", f"""
c AS (SELECT COALESCE(NULLIF(lang_code, ''), 'unknown') AS lang, count(*) AS n_hits, count(DISTINCT utterance_id) AS off_utt FROM crimes WHERE {IN_RANGE} GROUP BY 1),
u AS (SELECT COALESCE(NULLIF(lang_code, ''), 'unknown') AS lang, count(*) AS all_utt FROM utterances WHERE {IN_RANGE} GROUP BY 1)"""))
def _(spark, sf):
    return endpoints.lang_bars(facts.crimes(spark, sf), facts.counts(spark, sf), SCOPE, "offending", 3)


@query("e04_categories_stack", with_facts(f"""SELECT key, mild, strong, slur_masked, total, {_ratio('total', '(SELECT sum(total) FROM r)', 'share')},
  {_ratio('mild', 'total', 'share_mild')}, {_ratio('strong', 'total', 'share_strong')}, {_ratio('slur_masked', 'total', 'share_slur_masked')} FROM r""", f"""
p AS (SELECT category AS key, count(*) FILTER (severity = 'mild') AS mild, count(*) FILTER (severity = 'strong') AS strong, count(*) FILTER (severity = 'slur_masked') AS slur_masked, count(*) AS total FROM crimes WHERE {IN_RANGE} GROUP BY 1),
r AS (SELECT CASE WHEN rn <= 3 THEN key ELSE '__other__' END AS key, CAST(sum(mild) AS BIGINT) AS mild, CAST(sum(strong) AS BIGINT) AS strong, CAST(sum(slur_masked) AS BIGINT) AS slur_masked, CAST(sum(total) AS BIGINT) AS total
  FROM (SELECT *, row_number() OVER (ORDER BY total DESC, key) AS rn FROM p) GROUP BY 1)"""))
def _(spark, sf):
    return endpoints.categories_stack(facts.crimes(spark, sf), SCOPE, 3)


@query("e05_kpi_strip", with_facts(f"""SELECT '2024-01-03' AS day, hits, offending_utterances, repos, actors, all_utterances, {_ratio('hits', 'offending_utterances', 'intensity')}, {_ratio('offending_utterances', 'all_utterances', 'coverage')}, {_ratio('hits', 'all_utterances', 'rarity')} FROM c, u""", f"""
c AS (SELECT count(*) AS hits, count(DISTINCT utterance_id) AS offending_utterances, count(DISTINCT repo) AS repos, count(DISTINCT actor) AS actors FROM crimes WHERE {IN_RANGE}),
u AS (SELECT count(*) AS all_utterances FROM utterances WHERE {IN_RANGE})"""))
def _(spark, sf):
    return endpoints.kpi_strip(facts.crimes(spark, sf), facts.counts(spark, sf), SCOPE)


@query("e06a_year_bounds", with_facts("SELECT greatest(CAST(min(year(created_at)) AS INT), 2024 - 19) AS first_year, least(CAST(max(year(created_at)) AS INT), 2024) AS last_year FROM crimes"))
def _(spark, sf):
    return endpoints.year_bounds(facts.crimes(spark, sf), facts.counts(spark, sf), 2024)


_MONTHS_SQL = f"""
c AS (SELECT year(created_at) AS year, month(created_at) AS month, count(*) AS hits, count(*) FILTER (severity = 'mild') AS mild, count(*) FILTER (severity = 'strong') AS strong, count(*) FILTER (severity = 'slur_masked') AS slur FROM crimes GROUP BY 1, 2),
u AS (SELECT year(created_at) AS year, month(created_at) AS month, count(*) AS utterances FROM utterances GROUP BY 1, 2),
months AS (SELECT g.year, g.month, COALESCE(hits, 0) AS hits, COALESCE(utterances, 0) AS utterances, {_ratio('COALESCE(hits, 0)', 'utterances', 'rate')}, {_ratio('mild + 2 * strong + 3 * slur', 'hits', 'severity')}
  FROM (SELECT CAST(2023 + i // 12 AS INT) AS year, CAST(i % 12 + 1 AS INT) AS month FROM range(24) AS r(i)) g LEFT JOIN c USING (year, month) LEFT JOIN u USING (year, month))"""


def _months(spark, sf):
    return endpoints.monthly(facts.crimes(spark, sf), facts.counts(spark, sf), 2023, 2024)


@query("e06b_monthly_trend", with_facts("SELECT * FROM months", _MONTHS_SQL))
def _(spark, sf):
    return _months(spark, sf)


@query("e06c_seasonality", with_facts("SELECT metric, month, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75 FROM long GROUP BY 1, 2", _MONTHS_SQL + """,
long AS (SELECT month, 'hits' AS metric, CAST(hits AS DOUBLE) AS v FROM months UNION ALL SELECT month, 'rate', rate FROM months UNION ALL SELECT month, 'severity', severity FROM months)"""))
def _(spark, sf):
    return endpoints.seasonality(_months(spark, sf))


@query("e06d_category_mix", with_facts(f"SELECT CAST(year AS INT) AS year, key, hits, {_ratio('hits', 'sum(hits) OVER (PARTITION BY year)', 'share')} FROM (SELECT year(created_at) AS year, category AS key, count(*) AS hits FROM crimes WHERE year(created_at) IN (2023, 2024) GROUP BY 1, 2)"))
def _(spark, sf):
    return endpoints.category_mix(facts.crimes(spark, sf), 2024)


@query("e06e_detver_markers", with_facts("SELECT detver AS version, strftime(min(created_at), '%Y-%m-%d') AS first_day FROM crimes GROUP BY 1"))
def _(spark, sf):
    return endpoints.detver_markers(facts.crimes(spark, sf))


def _by_sql(key: str, values: str) -> str:
    return with_facts(f"SELECT g.{key}, d.t, COALESCE(hits, 0) AS hits FROM ({values}) g CROSS JOIN ({DAYS}) d LEFT JOIN c ON c.{key} = g.{key} AND c.t = d.t",
                      f"\nc AS (SELECT {key}, strftime(created_at, '%Y-%m-%d') AS t, count(*) AS hits FROM crimes WHERE {IN_RANGE} GROUP BY 1, 2)")


@query("e07_timeseries_detver", _by_sql("detver", "SELECT DISTINCT detver FROM c"))
def _(spark, sf):
    return endpoints.timeseries_detver(facts.crimes(spark, sf), SCOPE)


@query("e08_code_lang_bars", with_facts(f"SELECT code_lang, hits, repos, {_ratio('hits', 'sum(hits) OVER ()', 'ratio')} FROM (SELECT primary_lang AS code_lang, count(*) AS hits, count(DISTINCT repo) AS repos FROM crimes JOIN repositories USING (repo) WHERE {IN_RANGE} GROUP BY 1)"))
def _(spark, sf):
    return endpoints.code_lang_bars(facts.crimes(spark, sf), facts.repositories(spark, sf), SCOPE)


_TERMS = f"\nt AS (SELECT term, count(*) AS hits, count(DISTINCT utterance_id) AS utterances, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS ratio FROM crimes WHERE {IN_RANGE} GROUP BY 1)"


@query("e09_terms_top", with_facts("SELECT * FROM t ORDER BY hits DESC, term LIMIT 10", _TERMS))
def _(spark, sf):
    return endpoints.terms_top(facts.crimes(spark, sf), SCOPE, 10)


@query("t04_keyset_page", with_facts("SELECT * FROM t WHERE hits < 160 OR (hits = 160 AND term > 'error_5') ORDER BY hits DESC, term LIMIT 10", _TERMS))
def _(spark, sf):
    return endpoints.terms_top(facts.crimes(spark, sf), SCOPE, 10, (160, "error_5"))


@query("e10_timeseries_term", _by_sql("term", "SELECT unnest(['click_1', 'error_5', 'absent']) AS term"))
def _(spark, sf):
    return endpoints.timeseries_term(facts.crimes(spark, sf), SCOPE, ["click_1", "error_5", "absent"])


@query("e11_targets_mix", with_facts(f"SELECT CASE target_type WHEN 'none' THEN 'generic' ELSE target_type END AS target, count(*) AS hits FROM crimes WHERE {IN_RANGE} GROUP BY 1"))
def _(spark, sf):
    return endpoints.targets_mix(facts.crimes(spark, sf), SCOPE)


@query("e12_terms_matrix", with_facts(f"""SELECT term, lang, hits FROM m WHERE term IN (SELECT term FROM m GROUP BY term ORDER BY sum(hits) DESC, term LIMIT 20)""",
                                      f"\nm AS (SELECT term, COALESCE(NULLIF(lang_code, ''), 'unknown') AS lang, count(*) AS hits FROM crimes WHERE {IN_RANGE} GROUP BY 1, 2)"))
def _(spark, sf):
    return endpoints.terms_matrix(facts.crimes(spark, sf), SCOPE)


def _one_repo(spark, sf, part: str, key: str = "repo") -> DataFrame:
    import hashlib

    h = hashlib.sha256(f"{key}:7".encode()).hexdigest()
    own = Scope(FIRST, LAST, repo_hids=(h,)) if key == "repo" else Scope(FIRST, LAST, actor_hids=(h,))
    return endpoints.overview(facts.crimes(spark, sf), own)[part]


for _n, _key in (("e13_repo", "repo"), ("e22_actor", "actor")):
    _own = f"{IN_RANGE} AND {_key} = sha256('{_key}:7')"
    query(f"{_n}_overview_series", with_facts(f"SELECT d.t, COALESCE(hits, 0) AS hits FROM ({DAYS}) d LEFT JOIN (SELECT strftime(created_at, '%Y-%m-%d') AS t, count(*) AS hits FROM crimes WHERE {_own} GROUP BY 1) c ON c.t = d.t"))(
        lambda spark, sf, _key=_key: _one_repo(spark, sf, "series", _key))
    query(f"{_n}_overview_mix", with_facts(f"SELECT category, count(*) AS hits FROM crimes WHERE {_own} GROUP BY 1"))(lambda spark, sf, _key=_key: _one_repo(spark, sf, "mix", _key))
    query(f"{_n}_overview_terms", with_facts(f"SELECT term, count(*) AS hits FROM crimes WHERE {_own} GROUP BY 1 ORDER BY hits DESC, term LIMIT 10"))(lambda spark, sf, _key=_key: _one_repo(spark, sf, "terms", _key))


@query("e15_ratios_time", with_facts(f"SELECT d.t, COALESCE(hits, 0) AS hits, COALESCE(n, 0) AS utterances, {_ratio('COALESCE(hits, 0)', 'n', 'ratio')} FROM ({DAYS}) d LEFT JOIN c ON c.t = d.t LEFT JOIN u ON u.t = d.t", f"""
c AS (SELECT strftime(created_at, '%Y-%m-%d') AS t, count(*) AS hits FROM crimes WHERE {IN_RANGE} GROUP BY 1),
u AS (SELECT strftime(created_at, '%Y-%m-%d') AS t, count(*) AS n FROM utterances WHERE {IN_RANGE} GROUP BY 1)"""))
def _(spark, sf):
    return endpoints.ratios_time(facts.crimes(spark, sf), facts.counts(spark, sf), SCOPE)


@query("e16_timeseries_severity", _by_sql("severity", "SELECT DISTINCT severity FROM c"))
def _(spark, sf):
    return endpoints.timeseries_severity(facts.crimes(spark, sf), SCOPE)


@query("e17_spike_drivers", with_facts("""SELECT term AS key, count(*) FILTER (now) AS hits, count(*) FILTER (NOT now) AS baseline, count(*) FILTER (now) - count(*) FILTER (NOT now) AS delta FROM (
  SELECT term, created_at >= TIMESTAMP '2024-01-15' AS now FROM crimes WHERE created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-22') GROUP BY 1 ORDER BY abs(delta) DESC, key LIMIT 20"""))
def _(spark, sf):
    return endpoints.spike_drivers(facts.crimes(spark, sf), Scope(date(2024, 1, 15), date(2024, 1, 21)), Scope(date(2024, 1, 8), date(2024, 1, 14)), "term")


def _leaders_sql(key: str) -> str:
    return with_facts(f"SELECT {key} AS hid, left({key}, 6) || '...' || right({key}, 6) AS label, hits, {_ratio('hits', '(SELECT sum(hits) FROM g)', 'ratio')} FROM g ORDER BY hits DESC, hid LIMIT 10", f"\ng AS (SELECT {key}, count(*) AS hits FROM crimes WHERE {IN_RANGE} GROUP BY 1)")


@query("e18_leaders_actors", _leaders_sql("actor"))
def _(spark, sf):
    return endpoints.leaders(facts.crimes(spark, sf), SCOPE, "actor_hid", 10)


@query("e19_leaders_repos", _leaders_sql("repo"))
def _(spark, sf):
    return endpoints.leaders(facts.crimes(spark, sf), SCOPE, "repo_hid", 10)


@query("e20_terms_suggest", with_facts("SELECT term, count(*) AS hits FROM crimes WHERE starts_with(lower(term), 'err') GROUP BY 1 ORDER BY hits DESC, term LIMIT 5"))
def _(spark, sf):
    return endpoints.terms_suggest(facts.crimes(spark, sf), "Err", 5)


@query("e21_hits_hourly", with_facts(f"SELECT strftime(created_at, '%Y-%m-%dT%H:00:00') AS t, count(*) AS hits FROM crimes WHERE {IN_RANGE} GROUP BY 1"))
def _(spark, sf):
    return endpoints.hits_hourly(facts.crimes(spark, sf), SCOPE)


@query("e23_crosstab_repo_actor", with_facts(f"SELECT strftime(created_at, '%Y-%m-%d') AS day, repo, actor, count(*) AS hits FROM crimes WHERE {IN_RANGE} GROUP BY 1, 2, 3"))
def _(spark, sf):
    return endpoints.crosstab_repo_actor(facts.crimes(spark, sf), SCOPE)


@query("e24_stats_lang", with_facts("""SELECT u.day, u.lang, u.utterances, COALESCE(hits, 0) AS hits, COALESCE(offending, 0) AS offending FROM u LEFT JOIN h USING (day, lang)""", """
u AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, COALESCE(lang_code, 'und') AS lang, count(*) AS utterances FROM utterances GROUP BY 1, 2),
h AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, COALESCE(lang_code, 'und') AS lang, count(*) AS hits, count(DISTINCT utterance_id) AS offending FROM crimes WHERE severity IN ('strong', 'slur_masked') GROUP BY 1, 2)"""))
def _(spark, sf):
    return endpoints.stats_by_lang(facts.crimes(spark, sf), facts.utterances(spark, sf), 2)


@query("e24_stats_repo", with_facts(f"SELECT repo, count(*) AS hits, count(DISTINCT utterance_id) AS utterances FROM crimes WHERE {IN_RANGE} GROUP BY 1 ORDER BY hits DESC, repo LIMIT 200"))
def _(spark, sf):
    return endpoints.stats_by_repo(facts.crimes(spark, sf), SCOPE)


@query("e24_stats_category", with_facts(f"SELECT category, severity, count(*) AS hits, count(DISTINCT utterance_id) AS utterances FROM crimes WHERE {IN_RANGE} GROUP BY 1, 2"))
def _(spark, sf):
    return agg.hits_and_utterances(hits_in(facts.crimes(spark, sf), SCOPE), F.col("category"), F.col("severity"))


@query("e25_samples_latest", with_facts(f"SELECT {_time_sql('created_at')} AS created_at, hit_id, term, u.text_raw FROM crimes c JOIN (SELECT id, text_raw FROM utterances) u ON u.id = c.utterance_id ORDER BY c.created_at DESC, hit_id LIMIT 50"))
def _(spark, sf):
    return _edge(endpoints.samples_latest(facts.crimes(spark, sf), facts.utterances(spark, sf)))


@query("e14_samples_masked", with_facts("""SELECT strftime(u.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, utterance_id, hits, CASE WHEN hits = 2 THEN left(a, 7) || '***' || substr(a, 11) ELSE a END AS masked FROM (
SELECT utterance_id, u.created_at, hits, left(text_raw, s) || '**' || substr(text_raw, s + 3) AS a FROM (SELECT utterance_id, count(*) AS hits, any_value(utterance_id % 3) AS s FROM crimes GROUP BY 1) c JOIN utterances u ON u.id = c.utterance_id ORDER BY u.created_at DESC, utterance_id LIMIT 50) u"""))
def _(spark, sf):
    """Each first hit stands at byte 0, 1 or 2 of its text, and each second one at byte 7."""
    c = facts.crimes(spark, sf)
    second = F.col("hit_id") % 2 == 1
    start = F.when(second, 7).otherwise((F.col("utterance_id") % 3).cast("int"))
    c = c.withColumns({"span_start": start, "span_end": start + F.when(second, 3).otherwise(2)})
    df = endpoints.samples_masked(c, facts.utterances(spark, sf), "text_raw")
    return _edge(df.select("created_at", "utterance_id", F.size("hits").cast("long").alias("hits"), "masked"))


@query("e26_list_samples", with_facts(f"SELECT {_time_sql('created_at')} AS created_at, hit_id, utterance_id, term FROM crimes WHERE {IN_RANGE} AND (created_at > TIMESTAMP '2024-01-10' OR (created_at = TIMESTAMP '2024-01-10' AND hit_id > 100)) ORDER BY crimes.created_at, hit_id LIMIT 100"))
def _(spark, sf):
    return _edge(endpoints.list_samples(facts.crimes(spark, sf), SCOPE, (datetime(2024, 1, 10), 100)).select("created_at", "hit_id", "utterance_id", "term"))


@query("a30_birds_eye", with_facts(f"""SELECT CAST(sum(hits) AS BIGINT) AS ytd_hits, round(avg(hits / CAST(off AS DOUBLE)), 3) AS mean_intensity, arg_max(t, (off / CAST(n AS DOUBLE), t)) AS peak_day FROM c JOIN u USING (t)""", f"""
c AS (SELECT strftime(created_at, '%Y-%m-%d') AS t, count(*) AS hits, count(DISTINCT utterance_id) AS off FROM crimes WHERE {IN_RANGE} GROUP BY 1),
u AS (SELECT strftime(created_at, '%Y-%m-%d') AS t, count(*) AS n FROM utterances WHERE {IN_RANGE} GROUP BY 1)"""))
def _(spark, sf):
    return endpoints.birds_eye(endpoints.timeseries_hits(facts.crimes(spark, sf), facts.counts(spark, sf), SCOPE))


@query("w05_year_over_year", """WITH m AS (SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, count(*) AS hits FROM orders GROUP BY 1, 2),
g AS (SELECT y.year, x.month, COALESCE(hits, 0) AS hits FROM (SELECT DISTINCT year FROM m) y CROSS JOIN (SELECT CAST(i AS INT) AS month FROM range(1, 13) AS r(i)) x LEFT JOIN m ON m.year = y.year AND m.month = x.month)
SELECT year, month, hits, hits / NULLIF(CAST(lag(hits) OVER (PARTITION BY month ORDER BY year) AS DOUBLE), 0) - 1 AS yoy FROM g""")
def _(spark, sf):
    m = read(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("hits"))
    grid = m.select("year").distinct().crossJoin(F.broadcast(spark.range(1, 13).select(F.col("id").cast("int").alias("month"))))
    return endpoints.year_over_year(grid.join(m, ["year", "month"], "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long"))))


@query("a31_latest_against_previous", """SELECT year, hits, rate, hits - lag(hits) OVER (ORDER BY year) AS delta FROM (SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS hits, round(sum(o_totalprice) / count(*), 4) AS rate FROM orders GROUP BY 1)""")
def _(spark, sf):
    from pyspark.sql import Window

    y = read(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("hits"), F.round(F.sum("o_totalprice") / F.count("*"), 4).alias("rate"))
    return y.withColumn("delta", F.col("hits") - F.lag("hits").over(Window.orderBy("year")))  # a row a year


# ---------------------------------------------------------------- filters, projections, scalars

@query("f01_half_open_days", with_facts(f"SELECT count(*) AS n, {_time_sql('min(created_at)')} AS first_at, {_time_sql('max(created_at)')} AS last_at FROM crimes WHERE {IN_RANGE}"))
def _(spark, sf):
    return _edge(facts.crimes(spark, sf).filter(dates.in_days(F.col("created_at"), FIRST, LAST)).agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")))


@query("f04_tri_state", with_facts("SELECT count(*) AS any, count(*) FILTER (lang_reliable) AS yes, count(*) FILTER (NOT lang_reliable) AS no FROM crimes"))
def _(spark, sf):
    asked = lambda value: predicate(Scope(date(2000, 1, 1), date(2100, 1, 1), lang_reliable=value), [], "created_at", True)
    return facts.crimes(spark, sf).agg(*[F.count_if(asked(value)).alias(name) for name, value in (("any", None), ("yes", True), ("no", False))])


@query("f05_severity_category", with_facts(f"SELECT term, count(*) AS hits FROM crimes WHERE {IN_RANGE} AND severity IN ('strong') AND category IN ('bot_rage', 'generic') GROUP BY 1"))
def _(spark, sf):
    return hits_in(facts.crimes(spark, sf), Scope(FIRST, LAST, severities=("strong",), categories=("bot_rage", "generic"))).groupBy("term").agg(F.count("*").alias("hits"))


@query("f08_severity_threshold", with_facts("SELECT severity, count(*) AS n FROM crimes WHERE severity IN ('strong', 'slur_masked') GROUP BY 1"))
def _(spark, sf):
    return facts.crimes(spark, sf).filter(scalars.severity_rank(F.col("severity")) >= 2).groupBy("severity").agg(F.count("*").alias("n"))


@query("f10_owner_part", with_facts("SELECT full_name, stars FROM repositories WHERE split_part(full_name, '/', 1) = 'owner2'"))
def _(spark, sf):
    return facts.repositories(spark, sf).filter(scalars.owner_of(F.col("full_name")) == "owner2").select("full_name", "stars")


@query("f11_retention", with_facts("SELECT count(*) AS full_rows, 0 AS aggressive, count(*) FILTER (date_trunc('hour', created_at) + INTERVAL 1 HOUR >= TIMESTAMP '2024-01-21') AS timebox FROM utterances"))
def _(spark, sf):
    stays = lambda rule: F.count_if(compact.kept(F.date_trunc("hour", "created_at"), rule, datetime(2024, 1, 31)))
    return facts.utterances(spark, sf).agg(stays("full").alias("full_rows"), stays("aggressive").alias("aggressive"), stays("timebox:10d").alias("timebox"))


@query("f13_ready_queue", """SELECT o_orderkey AS id, CAST(o_custkey % 5 AS INT) AS priority FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND (o_orderkey % 3 <> 0 OR o_orderdate + INTERVAL 2 DAY < TIMESTAMP '1997-01-01') ORDER BY priority DESC, o_orderdate, id LIMIT 100""")
def _(spark, sf):
    at = F.col("o_orderdate").cast("timestamp")
    queue = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).cast("int").alias("priority"), at.alias("next_attempt_at"),
                                             F.when(F.col("o_orderkey") % 3 == 0, at + F.expr("interval 2 days")).alias("lease_until"))
    return consent.ready(queue, "1997-01-01 00:00:00", 100).select("id", "priority")


@query("j14_claim", """WITH q AS (SELECT o_orderkey AS id, CAST(o_custkey % 5 AS INT) AS priority, o_orderdate AS d FROM orders), c AS (SELECT id FROM q WHERE d <= TIMESTAMP '1997-01-01' ORDER BY priority DESC, d, id LIMIT 10)
SELECT q.id, CASE WHEN c.id IS NOT NULL THEN '1997-01-02 00:00:00' END AS lease_until FROM q LEFT JOIN c USING (id)""")
def _(spark, sf):
    queue = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).cast("int").alias("priority"), F.col("o_orderdate").cast("timestamp").alias("next_attempt_at"), F.lit(None).cast("timestamp").alias("lease_until"))
    return _edge(consent.claim(queue, consent.ready(queue, "1997-01-01 00:00:00", 10), "1997-01-02 00:00:00").select("id", "lease_until"))


@query("p01_consent_status", with_facts("SELECT c_custkey AS key, CASE arg_max(action, (created_at, consent_id)) WHEN 'opt_out' THEN 'deny' WHEN 'opt_in' THEN 'allow' ELSE 'none' END AS status FROM customer LEFT JOIN (SELECT * FROM receipts WHERE principal = 'repo' AND state = 'active') r ON r.principal_key = c_custkey GROUP BY 1"))
def _(spark, sf):
    asked = read(spark, sf, "customer").select(F.col("c_custkey").alias("principal_key"))
    return consent.statuses(asked, facts.receipts(spark, sf), "repo").select(F.col("principal_key").alias("key"), "status")


@query("p02_masked_columns", """SELECT c_custkey, CASE WHEN o.k IS NOT NULL THEN c_name END AS c_name, c_mktsegment FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') o ON o.k = c_custkey""")
def _(spark, sf):
    held = read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_custkey").alias("consent")).distinct()
    return consent.mask_columns(read(spark, sf, "customer").join(held, "c_custkey", "left"), "consent", "c_name").select("c_custkey", "c_name", "c_mktsegment")


@query("p03_null_labels", with_facts("SELECT COALESCE(NULLIF(lang_code, ''), 'unknown') AS a, COALESCE(lang_code, 'und') AS b, COALESCE(lang_code, '') AS c, count(*) AS n FROM utterances GROUP BY 1, 2, 3"))
def _(spark, sf):
    lang = F.col("lang_code")
    return facts.utterances(spark, sf).groupBy(scalars.or_label(lang, "unknown").alias("a"), F.coalesce(lang, F.lit("und")).alias("b"), F.coalesce(lang, F.lit("")).alias("c")).agg(F.count("*").alias("n"))


_DETAILS = ("push:commit", "issues:title", "issue_comment:body", "pr:body", "pr_review_comment:body", "commit_comment:body", "other:x")


@query("p05_source_coarsening", "SELECT o_orderkey, CASE split_part(d, ':', 1) WHEN 'push' THEN 'commit' WHEN 'issues' THEN 'issue' WHEN 'issue_comment' THEN 'issue' WHEN 'pr' THEN 'pr' WHEN 'pr_review_comment' THEN 'pr' ELSE 'comment' END AS source FROM (SELECT o_orderkey, [" + ", ".join(f"'{d}'" for d in _DETAILS) + "][o_orderkey % 7 + 1] AS d FROM orders)")
def _(spark, sf):
    detail = F.element_at(F.array(*map(F.lit, _DETAILS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return read(spark, sf, "orders").select("o_orderkey", scalars.coarse_source(detail).alias("source"))


@query("x01_keys_and_labels", "SELECT DISTINCT user_id, sha256('actor:' || user_id) AS hid, left(sha256('actor:' || user_id), 6) || '...' || right(sha256('actor:' || user_id), 6) AS label FROM events")
def _(spark, sf):
    h = ids.hid("actor", F.col("user_id"))
    return read(spark, sf, "events").select("user_id").distinct().select("user_id", hid_hex(h).alias("hid"), ids.label(h).alias("label"))


@query("x02_json_maps", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(strlen(props)) AS longest FROM events GROUP BY 1")
def _(spark, sf):
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return read(spark, sf, "events").groupBy("event_type").agg(F.sum(v).alias("total"), F.max(F.octet_length("props")).cast("long").alias("longest"))


@query("x03_time_parts", "SELECT CAST(dayofweek(ts) AS INT) AS sunday0, CAST(isodow(ts) - 1 AS INT) AS monday0, CAST(hour(ts) AS INT) AS h, strftime(ts, '%Y%m') AS ym, count(*) AS n FROM events GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    ts = F.col("ts")
    return read(spark, sf, "events").groupBy(dates.sunday_zero(ts).alias("sunday0"), dates.monday_zero(ts).alias("monday0"), F.hour(ts).alias("h"), F.date_format(ts, "yyyyMM").alias("ym")).agg(F.count("*").alias("n"))


# Ways to write the name of a customer's repository, each with a place for its owner and its own part.
_REPO_FORMS = ("{}/{}", "https://github.com/{}/{}.git", "git@example.com:{}/{}.git", " https://api.example.com/repos/{}/{} ", "/{}/{}/")


@query("x04_repo_names", "SELECT c_custkey, 'owner' || c_nationkey || '/repo' || c_custkey AS repo FROM customer")
def _(spark, sf):
    own = [F.format_string(f.replace("{}", "%s"), F.concat(F.lit("Owner"), "c_nationkey"), F.concat(F.lit("Repo"), "c_custkey")) for f in _REPO_FORMS]
    written = F.element_at(F.array(*own), (F.col("c_custkey") % 5 + 1).cast("int"))
    return read(spark, sf, "customer").select("c_custkey", scalars.canonical_repo(written).alias("repo"))


@query("x05_daily_challenge", "SELECT user_id, CAST(ts AS DATE) AS day, sha256(unhex('" + bytes(b ^ 0x5C for b in b"example-secret".ljust(64, b"\0")).hex() + "') || unhex(sha256(unhex('" + bytes(b ^ 0x36 for b in b"example-secret".ljust(64, b"\0")).hex() + "') || encode('actor:' || user_id || ':' || strftime(ts, '%Y-%m-%d'))))) AS hash FROM (SELECT DISTINCT user_id, date_trunc('day', ts) AS ts FROM events)")
def _(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    return e.select("user_id", "day", ids.challenge(b"example-secret", "actor", F.col("user_id").cast("string"), F.col("day")).alias("hash"))


@query("r11_next_refresh", with_facts("SELECT c_custkey, strftime(CASE WHEN p + INTERVAL 24 HOUR > d AND p + INTERVAL 24 HOUR < due THEN p + INTERVAL 24 HOUR ELSE due END, '%Y-%m-%d %H:%M:%S') AS due FROM (SELECT c_custkey, d, p, d + INTERVAL 1 DAY * CASE WHEN c_acctbal >= 1000 THEN 7 WHEN c_acctbal >= 100 THEN 14 ELSE 30 END AS due FROM customer JOIN (SELECT o_custkey AS c_custkey, min(o_orderdate) + INTERVAL 1 DAY * (o_custkey % 40) AS d, min(o_orderdate) + INTERVAL 1 DAY * (o_custkey % 25) AS p FROM orders GROUP BY 1) USING (c_custkey))"))
def _(spark, sf):
    """Some pushes lie before the row was fetched, some soon after it, and some after it is due anyway."""
    after = lambda days: F.min("o_orderdate").cast("timestamp") + F.make_dt_interval((F.col("c_custkey") % days).cast("int"))
    o = read(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey").groupBy("c_custkey").agg(after(40).alias("d"), after(25).alias("p"))
    due = scalars.next_refresh("repo", F.col("c_acctbal"), F.col("d"), F.col("p"))
    return _edge(read(spark, sf, "customer").join(o, "c_custkey").select("c_custkey", due.alias("due")))


@query("r13_purge_on_optout", with_facts("SELECT name, k FROM (SELECT 'catalogue' AS name, c_custkey AS k FROM customer UNION ALL SELECT 'queue', o_custkey FROM orders UNION ALL SELECT 'id_map', c_custkey FROM customer WHERE c_nationkey < 5) WHERE k NOT IN (SELECT principal_key FROM receipts WHERE principal = 'actor' AND action = 'opt_out' AND state = 'active')"))
def _(spark, sf):
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    key = lambda df, name: df.select(F.col(name).alias("k"))
    left = consent.purge_optouts({"catalogue": key(c, "c_custkey"), "queue": key(o, "o_custkey"), "id_map": key(c.filter("c_nationkey < 5"), "c_custkey")}, facts.receipts(spark, sf), "actor", "k")
    return functools.reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("name"), "k") for name, df in left.items()])


@query("r11_refresh_days", with_facts("SELECT full_name, CASE WHEN stars >= 1000 THEN 7 WHEN stars >= 100 THEN 14 ELSE 30 END AS repo_days, CASE WHEN stars >= 1000 THEN 30 ELSE 60 END AS actor_days FROM repositories"))
def _(spark, sf):
    return facts.repositories(spark, sf).select("full_name", scalars.refresh_days("repo", F.col("stars")).alias("repo_days"), scalars.refresh_days("actor", F.col("stars")).alias("actor_days"))


@query("r12_backoff", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS attempts, CAST(least(600, 2 * pow(2, least(CAST(l_quantity AS BIGINT), 30))) AS BIGINT) AS seconds FROM lineitem")
def _(spark, sf):
    n = F.col("l_quantity").cast("long")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", n.alias("attempts"), scalars.backoff_seconds(n, 2).alias("seconds"))


# ---------------------------------------------------------------- joins, sets, sources

@query("j01_hits_with_utterances", with_facts("SELECT c.detver, u.event_type, count(*) AS hits, CAST(sum(strlen(u.text_raw)) AS BIGINT) AS text_sum FROM crimes c JOIN utterances u ON u.id = c.utterance_id GROUP BY 1, 2"))
def _(spark, sf):
    u = facts.utterances(spark, sf).select(F.col("id").alias("utterance_id"), "event_type", "text_raw")
    return facts.crimes(spark, sf).join(u, "utterance_id").groupBy("detver", "event_type").agg(F.count("*").alias("hits"), F.sum(F.octet_length("text_raw")).cast("long").alias("text_sum"))


@query("j03_left_on_predicate", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY 1")
def _(spark, sf):
    o = read(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.left_on(read(spark, sf, "customer"), o, ["c_custkey"], F.col("o_totalprice") > 100000).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("j05_full_outer", "SELECT COALESCE(a.t, b.t) AS t, COALESCE(orders, 0) AS orders, COALESCE(lines, 0) AS lines FROM (SELECT strftime(o_orderdate, '%Y-%m-01') AS t, count(*) AS orders FROM orders GROUP BY 1) a FULL JOIN (SELECT strftime(l_shipdate, '%Y-%m-01') AS t, count(*) AS lines FROM lineitem GROUP BY 1) b ON a.t = b.t")
def _(spark, sf):
    a = read(spark, sf, "orders").groupBy(dates.bucket(F.col("o_orderdate"), "month").alias("t")).agg(F.count("*").alias("orders"))
    b = read(spark, sf, "lineitem").groupBy(dates.bucket(F.col("l_shipdate"), "month").alias("t")).agg(F.count("*").alias("lines"))
    return joins.full_zero(a, b, ["t"], "orders", "lines")


@query("j08_cross_of_totals", "SELECT o.n AS orders, l.n AS lines FROM (SELECT count(*) AS n FROM orders) o, (SELECT count(*) AS n FROM lineitem) l")
def _(spark, sf):
    return read(spark, sf, "orders").agg(F.count("*").alias("orders")).crossJoin(read(spark, sf, "lineitem").agg(F.count("*").alias("lines")))


@query("j10_left_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(spark, sf):
    o = read(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


_ACTIVE = "SELECT principal_key FROM receipts WHERE principal = 'repo' AND state = 'active' AND action = "


@query("j11_exposable", with_facts(f"SELECT k AS principal_key FROM range(1600) AS t(k) WHERE k IN ({_ACTIVE}'opt_in') AND k NOT IN ({_ACTIVE}'opt_out')"))
def _(spark, sf):
    return consent.exposable(spark.range(1600).withColumnRenamed("id", "principal_key"), facts.receipts(spark, sf), "repo", "principal_key")


@query("j12_not_opted_out", with_facts(f"SELECT repo_key, count(*) AS hits FROM crimes WHERE repo_key NOT IN ({_ACTIVE}'opt_out') GROUP BY 1"))
def _(spark, sf):
    return consent.exclude_optouts(facts.crimes(spark, sf), facts.receipts(spark, sf), "repo", "repo_key").groupBy("repo_key").agg(F.count("*").alias("hits"))


@query("j13_one_row", "SELECT CAST(NULL AS BIGINT) AS c_custkey, CAST(NULL AS VARCHAR) AS c_name")
def _(spark, sf):
    return joins.or_one_row(read(spark, sf, "customer").filter("c_custkey < 0").select("c_custkey", "c_name"))


@query("j15_hydrate_lang", with_facts("SELECT h.hit_id, COALESCE(NULLIF(trim(h.l), ''), NULLIF(trim(u.lang_code), '')) AS lang_code FROM (SELECT hit_id, utterance_id, CASE WHEN hit_id % 2 = 0 THEN ' ' ELSE lang_code END AS l FROM crimes) h LEFT JOIN utterances u ON u.id = h.utterance_id"))
def _(spark, sf):
    h = facts.crimes(spark, sf).select("hit_id", "utterance_id", F.when(F.col("hit_id") % 2 == 0, " ").otherwise(F.col("lang_code")).alias("lang_code"))
    u = facts.utterances(spark, sf).select(F.col("id").alias("utterance_id"), "lang_code")
    return joins.hydrate(h, u, "utterance_id", "lang_code").select("hit_id", "lang_code")


@query("j17_scoped_repositories", with_facts("SELECT r.full_name, r.primary_lang, count(*) AS hits FROM crimes c JOIN repositories r USING (repo) GROUP BY 1, 2"))
def _(spark, sf):
    per = facts.crimes(spark, sf).groupBy("repo_hid").agg(F.count("*").alias("hits"))
    return per.join(facts.repositories(spark, sf), "repo_hid").select("full_name", "primary_lang", "hits")


@query("j18_dense_grid", "SELECT n_nationkey, m AS month, COALESCE(n, 0) AS customers FROM nation CROSS JOIN range(3) AS r(m) LEFT JOIN (SELECT c_nationkey, c_custkey % 5 AS k, count(*) AS n FROM customer GROUP BY 1, 2) c ON c.c_nationkey = n_nationkey AND k = m")
def _(spark, sf):
    c = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), (F.col("c_custkey") % 5).alias("month")).agg(F.count("*").alias("customers"))
    grid = read(spark, sf, "nation").select("n_nationkey").crossJoin(F.broadcast(spark.range(3).withColumnRenamed("id", "month")))
    return grid.join(c, ["n_nationkey", "month"], "left").withColumn("customers", F.coalesce("customers", F.lit(0).cast("long")))


@query("j19_nearest_span", """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS at, event_type FROM events), p AS (SELECT * FROM e WHERE event_type = 'error'), t AS (SELECT * FROM e WHERE event_type = 'purchase')
SELECT p.event_id, arg_min(t.event_id, (abs(p.at - t.at), t.at, t.event_id)) AS target, min(abs(p.at - t.at)) AS distance FROM p JOIN t ON t.user_id = p.user_id AND abs(p.at - t.at) <= 40000 GROUP BY 1""")
def _(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    points = e.filter("event_type = 'error'").select("event_id", "user_id", "at")
    targets = e.filter("event_type = 'purchase'").select("user_id", F.col("at").alias("t_at"), F.col("event_id").alias("target"))
    return joins.nearest_within(points, targets, "user_id", "at", "t_at", 40000, "t_at", "target").select("event_id", "target", "distance")


@query("j20_overlapping_spans", "SELECT event_id, event_id % 30 AS s, (event_id % 30 + 5 > 3 AND event_id % 30 < 10) OR (event_id % 30 + 5 > 20 AND event_id % 30 < 22) AS quoted FROM events")
def _(spark, sf):
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    s = F.col("event_id") % 30
    return read(spark, sf, "events").select("event_id", s.alias("s"), joins.overlapping(F.array(span(3, 10), span(20, 22)), s, s + 5).alias("quoted"))


@query("s15_hour_series", "SELECT strftime(x, '%Y-%m-%d %H:%M:%S') AS t FROM (SELECT unnest(generate_series(TIMESTAMP '2024-03-30', TIMESTAMP '2024-04-02', INTERVAL 1 HOUR)) AS x)")
def _(spark, sf):
    return _edge(dates.series(spark, "2024-03-30 00:00:00", "2024-04-02 00:00:00", "1 hour"))


@query("s16_zipped_arrays", "SELECT unnest(['a', 'b', 'c']) AS login, unnest([1, 2, 3]) AS id")
def _(spark, sf):
    return sinks.zipped(spark, login=["a", "b", "c"], id=[1, 2, 3])


@query("s21_upsert", "SELECT COALESCE(s.k, t.k) AS k, COALESCE(s.v, t.v) AS v FROM (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey < 1000) t FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS v FROM customer WHERE c_custkey >= 900) s ON s.k = t.k")
def _(spark, sf):
    c = read(spark, sf, "customer")
    old = c.filter("c_custkey < 1000").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    new = c.filter("c_custkey >= 900").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("v"))
    return sinks.upsert(old, new, ["k"])


@query("u04_insert_if_absent", "SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey < 1000 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey >= 1000")
def _(spark, sf):
    c = read(spark, sf, "customer")
    old = c.filter("c_custkey < 1000").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return sinks.insert_if_absent(old, c.filter("c_custkey >= 900").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")), ["k"])


@query("s12_delete_where", "SELECT c_custkey, c_nationkey FROM customer WHERE NOT COALESCE(c_nationkey < 5, FALSE)")
def _(spark, sf):
    return sinks.delete_where(read(spark, sf, "customer"), F.col("c_nationkey") < 5).select("c_custkey", "c_nationkey")


@query("u02_distinct_keys", with_facts("SELECT DISTINCT repo, source FROM crimes"))
def _(spark, sf):
    return _edge(facts.crimes(spark, sf).select("repo_hid", "source").distinct())


# ---------------------------------------------------------------- aggregates, windows, states

@query("a18_severity_pivot", with_facts("SELECT category, count(*) FILTER (severity = 'mild') AS mild, count(*) FILTER (severity = 'strong') AS strong, count(*) FILTER (severity = 'slur_masked') AS slur_masked, count(*) AS total FROM crimes GROUP BY 1"))
def _(spark, sf):
    return agg.severity_pivot(facts.crimes(spark, sf), F.col("category"))


@query("a19_top_n_other", with_facts(f"SELECT CASE WHEN rn <= 2 THEN lang ELSE '__other__' END AS lang, CAST(sum(hits) AS BIGINT) AS hits FROM (SELECT *, row_number() OVER (ORDER BY hits DESC, lang) AS rn FROM (SELECT COALESCE(NULLIF(lang_code, ''), 'unknown') AS lang, count(*) AS hits FROM crimes WHERE {IN_RANGE} GROUP BY 1)) GROUP BY 1"))
def _(spark, sf):
    return endpoints.lang_rollup(facts.crimes(spark, sf), SCOPE, 2)


@query("a21_best_per_key", "SELECT user_id, event_type, arg_max(event_id, (value, event_id)) AS event_id FROM events GROUP BY 1, 2")
def _(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return agg.best_per_key(e, ["user_id", "event_type"], F.struct("value", "event_id")).drop("value")


@query("a23_version_dedup", "SELECT l_orderkey, l_linenumber AS version, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1")
def _(spark, sf):
    df = agg.latest_version(read(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey", "l_suppkey")
    return df.select("l_orderkey", F.col("l_linenumber").alias("version"), "l_partkey")


@query("a26_quartiles", "SELECT event_type, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75 FROM events GROUP BY 1")
def _(spark, sf):
    return agg.quartiles(read(spark, sf, "events"), "value", "event_type")


@query("a27_frequency_map", with_facts("SELECT actor_key, lang, count(*) AS n FROM (SELECT repo_key AS actor_key, COALESCE(NULLIF(lang_code, ''), 'unknown') AS lang FROM crimes) GROUP BY 1, 2"))
def _(spark, sf):
    c = facts.crimes(spark, sf).select(F.col("repo_key").alias("actor_key"), scalars.or_label(F.col("lang_code"), "unknown").alias("lang"))
    return agg.frequency_map(c, "actor_key", "lang").select("actor_key", F.explode("counts").alias("lang", "n"))


@query("a28_largest_of_map", with_facts("SELECT full_name, CASE WHEN k % 7 >= greatest(k % 5, k % 3) AND NOT (k % 3 >= k % 7) THEN 'Go' WHEN k % 3 >= greatest(k % 5, k % 7) THEN 'C' WHEN k % 7 >= k % 5 THEN 'Go' ELSE 'Rust' END AS main FROM repositories"))
def _(spark, sf):
    return facts.repositories(spark, sf).select("full_name", agg.largest_of_map(F.col("languages"), F.lit("none")).alias("main"))


@query("a22_merged_states", with_facts("""SELECT source, count(*) AS cnt, CAST(sum(strlen(text_raw)) AS BIGINT) AS text_sum, count(*) FILTER (id % 5 = 0) AS sent_cnt, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS min_at, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS max_at FROM utterances GROUP BY 1"""))
def _(spark, sf):
    merged = agg.read_states(agg.merge_states(facts.states(spark, sf), "source"), "source")
    return _edge(merged.select("source", "cnt", "text_sum", "sent_cnt", "min_at", "max_at"))


@query("a02_estimated_distinct", "SELECT o_orderpriority, o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, TRUE AS near FROM orders GROUP BY 1, 2")
def _(spark, sf):
    """Exact customers by status, and whether the estimate of the merged daily states is within five standard
    errors (8 percent, and 2) of them."""
    o = read(spark, sf, "orders")
    exact = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"))
    days = o.groupBy("o_orderdate", "o_orderpriority", "o_orderstatus").agg(F.hll_sketch_agg("o_custkey", F.lit(12)).alias("state"))
    about = days.groupBy(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")).agg(F.hll_sketch_estimate(F.hll_union_agg("state")).alias("about"))
    near = F.abs(F.col("about") - F.col("customers")) <= F.col("customers") * 0.08 + 2
    return exact.join(about, F.col("o_orderpriority").eqNullSafe(F.col("p")) & F.col("o_orderstatus").eqNullSafe(F.col("s"))).select("o_orderpriority", "o_orderstatus", "customers", near.alias("near"))


@query("a03_sketch_estimates")
def _(spark, sf):
    """Estimated distinct ids and quantiles of merged states; tests hold them against the exact ones."""
    return agg.read_states(agg.merge_states(facts.states(spark, sf), "source"), "source").select("source", "uniq", "cnt", "text_quantiles", F.round("sent_avg", 6).alias("sent_avg"))


@query("w04_latest_per_key", with_facts("SELECT principal, principal_key, arg_max(action, (created_at, consent_id)) AS action, arg_max(consent_id, (created_at, consent_id)) AS consent_id FROM receipts GROUP BY 1, 2"))
def _(spark, sf):
    return consent.latest_receipt(facts.receipts(spark, sf), "principal", "principal_key").select("principal", "principal_key", "action", "consent_id")


@query("r14_resolve_audit", with_facts("""SELECT k AS principal_key, COALESCE(a = 'opt_in', FALSE) AS allowed, COALESCE(a, 'no_receipt') AS reason FROM range(250) AS t(k) LEFT JOIN (SELECT principal_key, arg_max(action, (created_at, consent_id)) AS a FROM receipts WHERE principal = 'actor' AND state = 'active' GROUP BY 1) r ON r.principal_key = k"""))
def _(spark, sf):
    return consent.resolve_all(spark.range(250).withColumnRenamed("id", "principal_key"), facts.receipts(spark, sf), "actor")


@query("t02_allow_listed_order", with_facts("SELECT COALESCE(NULLIF(lang_code, ''), 'unknown') AS lang, count(*) AS hits FROM crimes GROUP BY 1 ORDER BY hits DESC, lang LIMIT 2"))
def _(spark, sf):
    c = facts.crimes(spark, sf).groupBy(scalars.or_label(F.col("lang_code"), "unknown").alias("lang")).agg(F.count("*").alias("hits"))
    return c.orderBy(F.desc("hits"), "lang").limit(2)


# ---------------------------------------------------------------- text

@query("l03_leet_fold", "SELECT doc_id, md5(translate(text, '4@01!35$7', 'aaoiiesst')) AS digest FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(text.leet_fold(F.col("text")).cast("binary")).alias("digest"))


@query("l05_shadows", "SELECT doc_id, md5(regexp_replace(text, '[^\\p{L}\\p{Nd}_]', '', 'g')) AS plain, md5(array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: NOT (i > 2 AND c[i] = c[i - 1] AND c[i] = c[i - 2])), lambda i: c[i]), '')) AS squashed FROM (SELECT doc_id, text, regexp_extract_all(text, '(?s).') AS c FROM documents)")
def _(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", F.md5(text.without_punctuation(t).cast("binary")).alias("plain"), F.md5(text.squash_repeats(t).cast("binary")).alias("squashed"))


_COUNTS_SQL = ", ".join(f"len(regexp_extract_all(text, '\\p{{{x}}}')) AS n{k}" for k, x in enumerate(text.SCRIPTS))
_MOST_SQL = f"greatest({', '.join(f'n{k}' for k in range(len(text.SCRIPTS)))})"


@query("l09_scripts_and_languages", f"SELECT doc_id, CASE WHEN {_MOST_SQL} = 0 OR text IS NULL THEN '' " + " ".join(f"WHEN n{k} = {_MOST_SQL} THEN '{x}'" for k, x in enumerate(text.SCRIPTS)) + " END AS script, CASE WHEN letters < 20 OR text IS NULL THEN '' " + " ".join(f"WHEN n{text.SCRIPTS.index(x)} > 0 THEN '{code}'" for x, code in text.LANG_OF_SCRIPT.items()) + f" ELSE '' END AS lang FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\\p{{L}}')) AS letters, {_COUNTS_SQL} FROM documents)")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.script_hint(F.col("text")).alias("found")).select("doc_id", "found.script", "found.lang")


def _profiles(spark, sf):
    """Learnt from four fifths of the documents."""
    return language.learn(read(spark, sf, "documents").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))


@query("x07_detected_languages")
def _(spark, sf):
    found = language.detect(spark, _profiles(spark, sf), F.col("text"))
    return spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", found.alias("d")).select("doc_id", "d.lang", "d.reliable")


@query("x07_mixed_languages")
def _(spark, sf):
    found = language.detect_mixed(spark, _profiles(spark, sf), F.col("text"))
    return spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.explode_outer(found)).select("doc_id", F.col("key").alias("lang"), F.col("value").alias("share"))


# Documents with ticks, fences and quoted lines that Spark and SQL put in by the same rule.
_MARKS = ((" of ", " ``` "), (" de ", " ``` "), (" the ", " ` "), (" der ", " ` "), (" le ", " ` "), (". ", ".\n> "))


def _marked(c):
    for a, b in _MARKS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_MARKED_SQL = functools.reduce(lambda s, m: f"replace({s}, '{m[0]}', " + "'" + m[1].replace("\n", "' || chr(10) || '") + "')", _MARKS, "text")
_OFFSET_SQL = "CAST(COALESCE(list_sum(list_transform({list}[1:{i}], lambda x: strlen(x))), 0) AS INT)"
_ZONES_SQL = f"""m AS (SELECT doc_id, regexp_extract_all(t, '(?s)```.*?```|[^`]+|`') AS p, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l FROM (SELECT doc_id, {_MARKED_SQL} AS t FROM documents)),
  x AS (SELECT doc_id, i, p[i] AS s, {_OFFSET_SQL.format(list="p", i="i - 1")} AS a FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM m)),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS r, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM x WHERE s = '`'),
  q AS (SELECT doc_id, l[j] AS s, {_OFFSET_SQL.format(list="l", i="j")} AS b FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS j FROM m)),
  zones AS (SELECT doc_id, 'code_fence' AS type, a + 3 AS "start", CAST(a + strlen(s) - 3 AS INT) AS "end" FROM x WHERE starts_with(s, '```') AND strlen(s) > 6
  UNION ALL SELECT k.doc_id, 'code_inline', k.a + 1, k.b FROM k JOIN x ON x.doc_id = k.doc_id AND x.i = k.i + 1 WHERE k.n % 2 = 1 AND k.r = k.i + 2 AND NOT starts_with(x.s, '`')
  UNION ALL SELECT doc_id, 'quote', CAST(e - strlen(c) AS INT), e FROM (SELECT doc_id, CAST(b - CASE WHEN ends_with(s, chr(10)) THEN 1 ELSE 0 END AS INT) AS e, regexp_extract(s, '^[ \t]*> *([^ \n][^\n]*)', 1) AS c FROM q) WHERE c <> '')"""


def _areas(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", _marked(F.col("text")).alias("t"))  # a column of its own, made once
    return d.select("doc_id", F.explode(text.zones_col(F.col("t"))).alias("z")).select("doc_id", "z.*")


@query("l06_zones", f"WITH {_ZONES_SQL} SELECT * FROM zones")
def _(spark, sf):
    return _areas(spark, sf)


_WORDS = ("worthless", "pathetic", "disgusting", "clown", "loser")


@query("l12_lemma_hits", f"SELECT doc_id, w AS term, len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z]+', '  ', 'g') || ' ', '[^a-z]' || w || '[^a-z]')) AS hits FROM documents, (SELECT unnest({list(_WORDS)}) AS w) WHERE regexp_matches(lower(text), '(^|[^a-z0-9_à-ÿ])' || w || '([^a-z0-9_à-ÿ]|$)')")
def _(spark, sf):
    pack = Pack(lemmas=[Lemma(w, "generic", 1) for w in _WORDS])
    d = spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.explode(detect(text.normalize_col(F.col("text"), "off"), pack, EVERY_HIT)).alias("h"))
    return d.groupBy("doc_id", F.col("h.term").alias("term")).agg(F.count("*").alias("hits"))


_COMMON = {"and": 3, "und": 2, "die": 1, "que": 2, "is": 1, "in": 4}
_COMMON_SQL = "(VALUES " + ", ".join(f"('{w}', {n})" for w, n in _COMMON.items()) + ") AS r(term, severity)"
_COMMON_PACK = Pack(lemmas=[Lemma(w, "generic", n) for w, n in _COMMON.items()], stop={"in"})
_SPANS_SQL = f"""w AS (SELECT doc_id, regexp_extract_all(lower({{text}}), '(?s)[\\p{{{{L}}}}\\p{{{{N}}}}\\p{{{{Mn}}}}\\p{{{{Pc}}}}]+|.') AS p FROM documents),
  spans AS (SELECT doc_id, term, severity, {_OFFSET_SQL.format(list="p", i="i - 1")} AS span_start FROM (SELECT doc_id, p, unnest(list_filter(range(1, len(p) + 1), lambda i: list_contains({[w for w in _COMMON if w != "in"]}, p[i]))) AS i FROM w) JOIN {_COMMON_SQL} ON r.term = p[i])"""


@query("l10_lemma_spans", f"WITH {_SPANS_SQL.format(text='text')} SELECT doc_id, term, span_start, CAST(span_start + strlen(term) AS INT) AS span_end FROM spans")
def _(spark, sf):
    """Lemmas of all documents found by a join of their pieces with the rules; a term on the stop list is none."""
    d = read(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return lemmas.lemma_hits(d, "doc_id", "text", _COMMON_PACK).select("doc_id", "term", "span_start", "span_end")


@query("l16_dampened_by_zones", f"WITH {_SPANS_SQL.format(text=_MARKED_SQL)}, {_ZONES_SQL}, t AS (SELECT s.doc_id, s.span_start, list(DISTINCT z.type ORDER BY z.type) AS tags FROM spans s JOIN zones z ON z.doc_id = s.doc_id AND z.\"start\" < s.span_start + strlen(s.term) AND z.\"end\" > s.span_start GROUP BY 1, 2) SELECT s.doc_id, term, s.span_start, COALESCE(array_to_string(tags, ','), '') AS zones, CAST(greatest(1, severity - COALESCE(len(tags), 0)) AS INT) AS level FROM spans s LEFT JOIN t ON t.doc_id = s.doc_id AND t.span_start = s.span_start")
def _(spark, sf):
    """Lemmas of all documents with the zones that they touch, each of which takes a level off."""
    d = read(spark, sf, "documents").select("doc_id", F.lower(_marked(F.col("text"))).alias("text"))
    tagged = lemmas.zone_tags(lemmas.lemma_hits(d, "doc_id", "text", _COMMON_PACK), _areas(spark, sf), "doc_id")
    return tagged.select("doc_id", "term", "span_start", F.array_join("zones", ",").alias("zones"), "level")


@query("l22_detected_hits")
def _(spark, sf):
    """Hits of the small own pack in all documents, in the stored form."""
    d = spread(read(spark, sf, "documents"))
    u = d.select(F.concat(F.lit("00000000-0000-5000-8000-"), F.lpad(F.hex("doc_id"), 12, "0")).alias("id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("doc_id") % 5000).cast("int"))).alias("created_at"),
                 F.lit("comment").alias("source"), ids.hid("repo", F.col("source")).alias("repo_hid"), ids.hid("actor", F.col("doc_id") % 100).alias("actor_hid"),
                 F.col("lang").alias("lang_code"), text.normalize_col(F.col("text")).alias("text_normalized"))
    return _edge(hits(u, from_json([OWN]), 1, EVERY_HIT)).drop("zones", "pre_context", "post_context")


# ---------------------------------------------------------------- further shapes

@query("j04_left_using", "SELECT n.day, n.lang, n.utterances, COALESCE(h.hits, 0) AS hits FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS lang, count(*) AS utterances FROM events GROUP BY 1, 2) n LEFT JOIN (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS lang, count(*) AS hits FROM events WHERE value > 200 GROUP BY 1, 2) h USING (day, lang)")
def _(spark, sf):
    e = read(spark, sf, "events")
    keys = [F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("lang")]
    hits = e.filter("value > 200").groupBy(*keys).agg(F.count("*").alias("hits"))
    return e.groupBy(*keys).agg(F.count("*").alias("utterances")).join(hits, ["day", "lang"], "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))


@query("j09_scalar_fallback", "SELECT COALESCE((SELECT min(year(o_orderdate)) FROM orders WHERE o_totalprice < 0), (SELECT min(year(l_shipdate)) FROM lineitem)) AS first_year")
def _(spark, sf):
    a = read(spark, sf, "orders").filter("o_totalprice < 0").agg(F.min(F.year("o_orderdate")).alias("a"))
    b = read(spark, sf, "lineitem").agg(F.min(F.year("l_shipdate")).alias("b"))
    return a.crossJoin(b).select(F.coalesce("a", "b").cast("long").alias("first_year"))


@query("j16_consented_catalogue", with_facts("SELECT r.full_name, c.consent_id, c.action FROM repositories r JOIN receipts c ON c.principal_key = r.k WHERE c.principal = 'repo' AND c.state = 'active'"))
def _(spark, sf):
    r = facts.repositories(spark, sf).select("full_name", F.regexp_extract("full_name", r"repo(\d+)$", 1).cast("long").alias("principal_key"))
    c = facts.receipts(spark, sf).filter("principal = 'repo' AND state = 'active'")
    return r.join(c, "principal_key").select("full_name", "consent_id", "action")


@query("f06_optional_by_sentinel", "SELECT count(*) AS every, count(*) FILTER (event_type = 'click') AS clicks FROM events")
def _(spark, sf):
    """An empty text asks for every row."""
    asked = lambda kind: F.lit(True) if kind == "" else F.col("event_type") == kind
    return read(spark, sf, "events").agg(F.count_if(asked("")).alias("every"), F.count_if(asked("click")).alias("clicks"))


@query("t03_sorted_categories", with_facts("SELECT category, count(*) FILTER (severity = 'strong') AS strong, count(*) AS total FROM crimes GROUP BY 1 ORDER BY strong DESC, category LIMIT 3"))
def _(spark, sf):
    return agg.severity_pivot(facts.crimes(spark, sf), F.col("category")).select("category", "strong", "total").orderBy(F.desc("strong"), "category").limit(3)


_SPACES_SQL = "\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


@query("l04_fold_spaces", f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[{_SPACES_SQL}]*[\\r\\n][{_SPACES_SQL}]*', chr(10), 'g'), '[{_SPACES_SQL[5:]}\\t\\x0B-\\r]+', ' ', 'g'), ' ' || chr(10))) AS digest FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(text.fold_spaces_col(F.col("text")).cast("binary")).alias("digest"))


@query("l13_word_boundaries", "SELECT doc_id, len(regexp_extract_all(regexp_replace(lower(text), '([^\\p{L}\\p{N}\\p{Mn}\\p{Pc}])', '\\1\\1', 'g'), '(?:^|[^\\p{L}\\p{N}\\p{Mn}\\p{Pc}])(?:worthless|clown)(?:$|[^\\p{L}\\p{N}\\p{Mn}\\p{Pc}])')) AS hits FROM documents")
def _(spark, sf):
    """The detector's own word edges, on texts that are only lower-cased."""
    pack = Pack(lemmas=[Lemma(w, "generic", 1) for w in ("worthless", "clown")])
    return read(spark, sf, "documents").select("doc_id", F.size(detect(F.lower("text"), pack, EVERY_HIT)).cast("long").alias("hits"))


@query("l20_stored_levels", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 1 THEN 'mild' ELSE 'strong' END AS severity, CASE WHEN l_linenumber % 4 = 0 THEN 'bot_rage' WHEN l_linenumber % 4 = 2 THEN 'self_own' ELSE 'generic' END AS category FROM lineitem")
def _(spark, sf):
    names = F.element_at(F.array(F.lit("bot_rage"), F.lit("harassment"), F.lit("self_own"), F.lit("other")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalars.severity_of(F.col("l_linenumber")).alias("severity"), scalars.stored_category(names).alias("category"))


@query("r04_hour_ledger", "SELECT strftime(x, '%Y-%m-%d %H:%M:%S') AS hour_utc, CASE WHEN n IS NULL THEN 'pending' WHEN n % 3 = 0 THEN 'ok' ELSE 'running' END AS bf_status FROM (SELECT unnest(generate_series(date_trunc('hour', (SELECT min(ts) FROM events)), date_trunc('hour', (SELECT max(ts) FROM events)), INTERVAL 1 HOUR)) AS x) LEFT JOIN (SELECT date_trunc('hour', ts) AS x, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) USING (x)")
def _(spark, sf):
    """Hours with errors are under way; of these, those with a number of errors that three divides get done."""
    e = read(spark, sf, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour_utc"), "event_type")
    first, last = e.agg(F.min("hour_utc").cast("string"), F.max("hour_utc").cast("string")).first()
    known = e.filter("event_type = 'error'").groupBy("hour_utc").agg(F.count("*").alias("n"))
    full = ledger.seed(spark, known.select("hour_utc", F.lit("pending").alias("bf_status"), F.lit("pending").alias("ns_status")), first, last)
    under_way = ledger.advance(full, known.select("hour_utc", F.lit("running").alias("bf_status")), "bf_status")
    # hours that aren't under way can't be done
    done = ledger.advance(under_way, full.join(known, "hour_utc", "left").filter("coalesce(n, 0) % 3 = 0").select("hour_utc", F.lit("ok").alias("bf_status")), "bf_status")
    return _edge(done.select("hour_utc", "bf_status"))


_S11_SQL = with_facts("SELECT strftime(bucket_hour, '%Y-%m-%d %H:%M:%S') AS bucket_hour, detver, count(*) AS facts, CAST(sum(text_len) AS BIGINT) AS text_sum, CAST(sum(hit_id % 50 + 5) AS BIGINT) AS ends, CAST(sum(hit_id % 9) AS BIGINT) AS distances, count(*) FILTER (target_type <> 'none') AS aimed, max('<' || term) AS before_term, max(term || '>') AS after_term FROM crimes WHERE detver = 2 GROUP BY 1, 2")


def _raw_hits_and_utterances(spark, sf):
    """Raw tables with all columns; some hits are stored twice."""
    c = facts.crimes(spark, sf)
    h = c.select(
        F.col("hit_id").alias("id"), "utterance_id", "created_at", "source", "repo_hid", "actor_hid", "lang_code", "term", "category", "severity", F.lit("none").alias("ctx_action"),
        "target_type", F.lit("t").alias("target_id"), F.lit("T").alias("target_name"), (F.col("hit_id") % 50).cast("int").alias("target_span_start"), (F.col("hit_id") % 50 + 5).cast("int").alias("target_span_end"),
        (F.col("hit_id") % 9).cast("int").alias("target_distance"), F.lit(0).alias("span_start"), F.lit(3).alias("span_end"), F.col("detver").alias("detector_version"), F.lit("lemma").alias("detector_source"),
        F.concat(F.lit("<"), "term").alias("pre_context"), F.concat("term", F.lit(">")).alias("post_context"), F.array().cast("array<string>").alias("zones"), F.lit(1).alias("ingest_batch_id"), F.lit(2).alias("ver"))
    u = facts.utterances(spark, sf).select("*", F.lit("x").alias("source_detail"), F.lit(None).cast("smallint").alias("lang_confidence"), F.lit(1).alias("ingest_batch_id"), F.lit(1).alias("ver"))
    raw = h.unionByName(h.filter("id % 4 = 0").withColumns({"ver": F.lit(1), "term": F.lit("old")}))
    return raw, u


def _told(wide):
    return _edge(wide.groupBy("bucket_hour", "detver").agg(
        F.count("*").alias("facts"), F.sum("text_len").cast("long").alias("text_sum"), F.sum("target_span_end").cast("long").alias("ends"), F.sum("target_distance").cast("long").alias("distances"),
        F.count_if(F.col("target_type") != "none").alias("aimed"), F.max("pre_context").alias("before_term"), F.max("post_context").alias("after_term")))


@query("s11_compacted_facts", _S11_SQL)
def _(spark, sf):
    """Facts as `compact.wide_facts` joins them, from raw hits with all columns, some of them stored twice."""
    raw, u = _raw_hits_and_utterances(spark, sf)
    return _told(compact.wide_facts(compact.newest(raw, compact.HIT_KEYS), compact.newest(u, ["id"]), 2))


@query("s11_bucketed_facts", _S11_SQL)
def _(spark, sf):
    """The same from tables stored in buckets by utterance: neither the newest rows nor the join need a shuffle."""
    raw, u = _raw_hits_and_utterances(spark, sf)
    name = uuid.uuid4().hex
    path = sinks.scratch(spark, "buckets")
    for df, kind, key in ((raw, "hits", "utterance_id"), (u, "utterances", "id")):
        bucketed.store(df, f"{kind}_{name}", key, f"{path}/{kind}", 8, unit="day")
    return _told(compact.wide_facts(compact.newest(bucketed.read(spark, f"hits_{name}"), compact.HIT_KEYS), compact.newest(bucketed.read(spark, f"utterances_{name}"), ["id"]), 2))


_TRACKED = 384
_HEAVY = agg.guaranteed_share(_TRACKED)


@query("a12_heavy_words", f"SELECT lang, word, n FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[^ \\t-\\r]+')) AS word FROM documents) GROUP BY 1, 2)) WHERE n > total * {_HEAVY}")
def _(spark, sf):
    """Words above the share that the states guarantee, by language: states by source and language are merged, and what
    they tell is counted exactly."""
    words = read(spark, sf, "documents").select("lang", "source", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t-\r]+"), F.lit(0))).alias("word"))
    merged = agg.merge_heavy(agg.heavy_states(words, F.col("word"), "lang", "source", tracked=_TRACKED), "lang", tracked=_TRACKED)
    told = agg.heavy_items(merged, "lang", tracked=_TRACKED).select(F.col("lang").alias("l"), F.col("item").alias("word"))
    # without broadcast hints: the states of many languages may tell much
    counted = words.alias("w").join(told.alias("t"), (F.col("w.word") == F.col("t.word")) & F.col("w.lang").eqNullSafe(F.col("t.l")))
    n = counted.groupBy("w.lang", "w.word").agg(F.count("*").alias("n"))
    of = merged.select(F.col("lang").alias("l"), "rows")
    return n.join(of, F.col("lang").eqNullSafe(F.col("l"))).filter(F.col("n") > F.col("rows") * _HEAVY).select("lang", "word", "n")


@query("s03_byte_budget", "SELECT l_shipdate, l_orderkey, l_linenumber, n, running FROM (SELECT l_shipdate, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (ORDER BY l_shipdate DESC, l_orderkey * 8 + l_linenumber RANGE UNBOUNDED PRECEDING) AS BIGINT) AS running FROM lineitem) WHERE running > (SELECT sum(CAST(l_quantity AS BIGINT)) // 2 FROM lineitem)")
def _(spark, sf):
    """Lines taken as files of `quantity` bytes: those to remove so that the newest fill half of all bytes."""
    f = read(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("n"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tie"))
    half = f.agg(F.expr("sum(n) div 2").alias("half"))
    run = retention.running_bytes(f, "l_shipdate", "tie", "n").crossJoin(F.broadcast(half)).filter("running > half")
    return run.select(F.col("l_shipdate"), "l_orderkey", "l_linenumber", "n", "running")


@query("s13_rows_of_a_database", "SELECT c_nationkey, count(*) AS customers, CAST(sum(c_custkey) AS BIGINT) AS keys, max(c_name) AS last_name FROM customer WHERE c_custkey >= 40 GROUP BY 1")
def _(spark, sf):
    """Customers written to a database, some of them twice, and read from it in parts; on a cluster that has no database
    they go to Parquet in the shared folder by the same rule."""
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name")
    steps, got = (c.filter("c_custkey % 3 > 0"), c), None
    if database.reachable(spark):
        url, table = database.own_url(spark), f"customer_{uuid.uuid4().hex[:16]}"
        for rows in steps:
            database.insert_missing(rows, url, table, ["c_custkey"], types="c_name VARCHAR(200)")
        got = database.read(spark, url, table, '"c_custkey"')
    else:
        for rows in steps:
            got = database.with_missing(rows, got, ["c_custkey"])
    return got.filter("c_custkey >= 40").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_custkey").alias("keys"), F.max("c_name").alias("last_name"))


@query("s08_parameterised", with_facts("SELECT term, count(*) AS hits FROM crimes WHERE severity <> 'mild' AND (lang_code = 'fr' OR term = 'it''s \" --') AND created_at >= TIMESTAMP '2024-01-03' GROUP BY 1 HAVING count(*) >= 2"))
def _(spark, sf):
    """Bound values stay values, quotes and all."""
    sql = "SELECT term, count(*) AS hits FROM {crimes} WHERE severity <> :severity AND (lang_code = :lang OR term = :odd) AND created_at >= :first GROUP BY term HAVING count(*) >= :least"
    return ask.many(spark, sql, {"severity": "mild", "lang": "fr", "odd": "it's \" --", "first": datetime(2024, 1, 3), "least": 2}, crimes=facts.crimes(spark, sf))


# Texts that each show a rule of the detector, and the hit that each has: term, category, level, action, target, zones, start.
_SHOWN = (
    ("clown", ("clown", "harassment", 1, "none", "none", "", 0)),
    ("a `flumdrub` b", ("flumdrub", "harassment", 1, "none", "none", "code_inline", 3)),
    ("soup of plimsol", ("soup of plimsol", "lang_rage", 2, "none", "lang", "", 0)),
    ("soup of nothing", ("soup of nothing", "generic", 2, "downgraded", "none", "", 0)),
    ("crumbled again, stitchet", ("crumbled again", "tooling_rage", 1, "upgraded", "tool", "", 0)),
    ("snorgle", None),  # on the stop list
    ("zibbo helper fell asleep", ("zibbo helper fell asleep", "bot_rage", 2, "none", "bot", "", 0)),
    ("é clownish clown_ clown", ("clown", "harassment", 1, "none", "none", "", 19)),
    ("> worthless", ("worthless", "generic", 1, "none", "none", "quote", 2)),
)
_SHOWN_SQL = ", ".join(str((k, *h)) for k, (_, h) in enumerate(_SHOWN) if h)


@query("l15_rules_of_the_detector", f"SELECT event_id, term, category, CAST(level AS INT) AS level, ctx_action, target_type, zones, CAST(span_start AS INT) AS span_start FROM events JOIN (VALUES {_SHOWN_SQL}) AS h(k, term, category, level, ctx_action, target_type, zones, span_start) ON event_id % {len(_SHOWN)} = k")
def _(spark, sf):
    shown = F.element_at(F.array(*[F.lit(t) for t, _ in _SHOWN]), (F.col("event_id") % len(_SHOWN) + 1).cast("int"))
    e = read(spark, sf, "events").select("event_id", F.explode(detect(shown, from_json([OWN]), EVERY_HIT)).alias("h"))
    return e.select("event_id", "h.term", "h.category", "h.level", "h.ctx_action", "h.target_type", F.array_join("h.zones", ",").alias("zones"), "h.span_start")


# The payload of each kind of event, and the utterances that it makes; %s stands for the event's number.
_PAYLOADS = {
    "click": ("PushEvent", '{"commits":[{"sha":"a","message":"first %s"},{"sha":"b","message":"  "},{"sha":"c","message":"third %s"}]}', (("commit", "push:commit", 1, "first "), ("commit", "push:commit", 2, "third "))),
    "error": ("IssuesEvent", '{"issue":{"title":"title %s","body":null}}', (("issue", "issues:title", 1, "title "),)),
    "purchase": ("IssueCommentEvent", '{"issue":{"title":"about %s"},"comment":{"body":" said %s "}}', (("issue", "issue_comment:title", 1, "about "), ("issue", "issue_comment:body", 1, "said "))),
    "signup": ("PullRequestEvent", '{"pull_request":{"title":"ask %s"}}', (("pr", "pr:title", 1, "ask "),)),
}
_PIECES_SQL = ", ".join(str((kind, name, *piece)) for kind, (name, _, own) in _PAYLOADS.items() for piece in own)


@query("s19_archive_hours", "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def _(spark, sf):
    """All events written as an archive of gzip files by hour, and read again through the data source, a task an hour."""
    path = sinks.scratch(spark, "archive")
    e = read(spark, sf, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("value"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd-H").alias("hour"))
    e.hint("rebalance", "hour").write.partitionBy("hour").option("compression", "gzip").text(path)
    lines = hourly.hours(spark, path).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.get_json_object("line", "$.event_type").alias("event_type"))
    return lines.groupBy("hour", "event_type").agg(F.count("*").alias("events"))


@query("s04_utterances_of_archive_lines", f"SELECT event_id, name AS event_type, source, source_detail, CAST(ordinal AS INT) AS ordinal, t || event_id AS text_raw, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, CAST(1 AS BIGINT) AS ver, FALSE AS lang_reliable FROM events JOIN (VALUES {_PIECES_SQL}) AS p(event_type, name, source, source_detail, ordinal, t) USING (event_type) WHERE event_id % 50 <> 0 AND event_id % 49 <> 0")
def _(spark, sf):
    """Lines as an archive has them, some broken off and some without a repository, through reader and flattening."""
    from tonelake.operators.extract import utterances
    from tonelake.sources.archive import envelopes, parsed

    number = F.col("event_id").cast("string")
    name, payload = F.lit("WatchEvent"), F.lit("{}")
    for kind, (event, own, _) in _PAYLOADS.items():
        name = F.when(F.col("event_type") == kind, event).otherwise(name)
        payload = F.when(F.col("event_type") == kind, F.replace(F.lit(own), F.lit("%s"), number)).otherwise(payload)
    repo = F.when(F.col("event_id") % 49 == 0, "{}").otherwise(F.format_string('{"id":%d,"name":"Own/R%d"}', F.col("user_id") % 20 + 1, F.col("user_id") % 20 + 1))
    line = F.format_string('{"type":"%s","public":true,"created_at":"%s","actor":{"id":%d,"login":"u"},"repo":%s,"payload":%s}',
                           name, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("user_id") + 1, repo, payload)
    lines = read(spark, sf, "events").select(F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 40)).otherwise(line).alias("line"))
    u = utterances(envelopes(parsed(lines, "skip")))
    return _edge(u.select(F.regexp_extract("text_raw", r"(\d+)$", 1).cast("long").alias("event_id"), "event_type", "source", "source_detail", "ordinal", "text_raw", "created_at", "ver", "lang_reliable"))
