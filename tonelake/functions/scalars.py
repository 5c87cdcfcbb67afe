"""Small column functions that several queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonelake.schemas import SEVERITIES


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def or_label(c: Column, name: str) -> Column:
    """A name for null and blank values."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(name))


def severity_rank(c: Column) -> Column:
    """1, 2, 3 in the declared order; null for other values."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), c), F.lit(0)).cast("int")


def severity_of(level: Column) -> Column:
    """Levels up to 1 are mild, all above strong; the third name is kept for masked text and never given here."""
    return F.when(level <= 1, "mild").otherwise("strong")


def stored_category(c: Column) -> Column:
    """Categories that the store doesn't know become generic."""
    return F.when(c.isin("bot_rage", "tooling_rage", "self_own", "lang_rage"), c).otherwise("generic")


def coarse_source(detail: Column) -> Column:
    """The bucket of a detail such as issues:title."""
    head = F.split_part(detail, F.lit(":"), F.lit(1))
    return (F.when(head == "push", "commit").when(head.isin("issues", "issue_comment"), "issue")
            .when(head.isin("pr", "pr_review_comment"), "pr").otherwise("comment"))


def owner_of(repo: Column) -> Column:
    return F.split_part(repo, F.lit("/"), F.lit(1))


def canonical_repo(name: Column) -> Column:
    """owner/name in lower case, the last two parts of a name, a web address or an ssh address, without .git."""
    s = F.lower(F.trim(name))
    s = F.when(F.startswith(s, F.lit("http")), F.regexp_replace(s, r"[?#].*$", "")).otherwise(F.regexp_replace(s, r"^[^/:]*@[^:]*:", ""))
    s = F.regexp_replace(s, r"^/+|(?:\.git|/)+$", "")
    return F.substring_index(s, "/", -2)


def trimmed(c: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x85]+|[\s\p{Z}\x85]+$", "")


def boolish(c: Column) -> Column:
    """True, 1, "true" and "1" in text form are true; all else is false."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1"), F.lit(False))


def masked(consent: Column, value: Column) -> Column:
    """The value where a consent is on record, else null."""
    return F.when(consent.isNotNull(), value)


def backoff_seconds(attempts: Column, base: int = 1, most: int = 600) -> Column:
    """base * 2^attempts, up to the most; the shift is bounded so that it can't overflow."""
    return F.least(F.lit(most).cast("long"), F.lit(base).cast("long") * F.pow(F.lit(2), F.least(attempts, F.lit(30))).cast("long"))


def next_refresh(kind: str, popularity: Column, fetched: Column, last_push: Column | None = None) -> Column:
    """When a row is due: its days after it was fetched, or a day after the last push where that is still to come when it
    is fetched, and sooner.  An older push, or none, changes nothing; without a time of fetching there is no due time."""
    due = fetched + F.make_dt_interval(refresh_days(kind, popularity))
    if last_push is None:
        return due
    soon = last_push + F.expr("interval 24 hours")
    return F.when((soon > fetched) & (soon < due), soon).otherwise(due)


def refresh_days(kind: str, popularity: Column) -> Column:
    """How long a catalogue row stays fresh: popular repositories and actors are looked at more often."""
    if kind == "repo":
        return F.when(popularity >= 1000, 7).when(popularity >= 100, 14).otherwise(30)
    return F.when(popularity >= 1000, 30).otherwise(60)
