"""Pages by key: a page's rows and an opaque cursor to the next one.

A page is a filter on the sort key and a top-k, so its cost doesn't grow with its number and rows that come meanwhile
move no other rows.  The cursor holds a version, the order it belongs to and the key of the page's last row; one more
row than asked for is taken, so there is a cursor only if there is another page.

The last column of the order must tell rows apart, else rows of equal keys at a page's edge are passed over.  Nulls come
first in ascending and last in descending order, as Spark sorts them.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

VERSION = 1


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next: str | None


def _order(order: list[str]) -> list[tuple[str, bool]]:
    """("-name" is descending) as (name, descending)."""
    return [(c.removeprefix("-"), c.startswith("-")) for c in order]


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (datetime, date)):
        return value.isoformat(" ") if isinstance(value, datetime) else value.isoformat()
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    raise TypeError(f"no key of a page: {type(value).__name__}")


def encoded(order: list[str], row: Row) -> str:
    key = [_text(row[name]) for name, _ in _order(order)]
    return base64.urlsafe_b64encode(json.dumps({"v": VERSION, "o": order, "k": key}).encode()).decode().rstrip("=")


def decoded(order: list[str], cursor: str) -> list[str | None]:
    """The key in a cursor; ValueError for one that is damaged, of another version, or of another order."""
    try:
        held = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        version, own, key = held["v"], held["o"], held["k"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("no cursor") from e
    if version != VERSION or own != order or not isinstance(key, list) or len(key) != len(order):
        raise ValueError("a cursor of another version or order")
    return key


def after(df: DataFrame, order: list[str], key: list[str | None]) -> Column:
    """Whether a row comes after the key."""
    found, same = F.lit(False), F.lit(True)
    for (name, descending), text in zip(_order(order), key, strict=True):
        c, k = F.col(name), F.lit(text).cast(df.schema[name].dataType)
        if descending:
            later = F.lit(False) if text is None else c.isNull() | (c < k)
        else:
            later = c.isNotNull() if text is None else F.coalesce(c > k, F.lit(False))
        found, same = found | (same & later), same & c.eqNullSafe(k)
    return found


def page(df: DataFrame, order: list[str], limit: int, cursor: str | None = None) -> Page:
    """The rows after the cursor in the order ("-name" is descending), at most `limit` of them; 0 is no limit, for results
    that are known to be small, since a page's rows come to the driver."""
    if limit < 0:
        raise ValueError("a limit below zero")
    rest = df if cursor is None else df.filter(after(df, order, decoded(order, cursor)))
    rest = rest.orderBy(*[F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_first() for n, d in _order(order)])
    rows = (rest.limit(limit + 1) if limit else rest).collect()
    more = bool(limit) and len(rows) > limit
    rows = rows[:limit] if limit else rows
    return Page(rows, encoded(order, rows[-1]) if more else None)
