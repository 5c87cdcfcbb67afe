"""Who and what a query looks at: one set of filters for both sides of every ratio.

The numerator side also has a detector version.  Where a table carries the partition column `ym`, the range becomes a
predicate on it as well, since Spark does not derive one from a predicate on the time column.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.dates import in_days


@dataclass(frozen=True)
class Scope:
    first: date
    last: date
    tz: str = "UTC"
    interval: str = "day"
    detver: int | None = None
    repo_hids: tuple[str, ...] = ()  # 64 hex digits each
    actor_hids: tuple[str, ...] = ()
    lang_codes: tuple[str, ...] = ()
    lang_reliable: bool | None = None  # None: either
    severities: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()

    def __post_init__(self):
        if self.last < self.first:
            raise ValueError("the range ends before it begins")
        for h in (*self.repo_hids, *self.actor_hids):
            if len(h) != 64:
                raise ValueError("keys are 64 hex digits")


def predicate(scope: Scope, columns: list[str], time_col: str, hits: bool) -> Column:
    p = in_days(F.col(time_col), scope.first, scope.last)
    if "ym" in columns:
        p = p & F.col("ym").between(f"{scope.first:%Y%m}", f"{scope.last:%Y%m}")
    for name, hids in (("repo_hid", scope.repo_hids), ("actor_hid", scope.actor_hids)):
        if hids:
            p = p & F.col(name).isin(*[bytes.fromhex(h) for h in hids])
    if scope.lang_codes:
        p = p & F.col("lang_code").isin(*scope.lang_codes)
    if scope.lang_reliable is not None:
        p = p & (F.col("lang_reliable") == scope.lang_reliable)
    if hits:
        if scope.detver is not None:
            p = p & (F.col("detver") == scope.detver)
        if scope.severities:
            p = p & F.col("severity").isin(*scope.severities)
        if scope.categories:
            p = p & F.col("category").isin(*scope.categories)
    return p


def hits_in(crimes: DataFrame, scope: Scope) -> DataFrame:
    return crimes.filter(predicate(scope, crimes.columns, "created_at", True))


def states_in(states: DataFrame, scope: Scope) -> DataFrame:
    return states.filter(predicate(scope, states.columns, "bucket_hour", False))
