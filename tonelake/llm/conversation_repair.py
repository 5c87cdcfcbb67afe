"""Conversation structure repair by error-correcting Earley parsing.

Method: the roles of a conversation must spell Talk -> nothing | Done, Done -> Asked assistant, Asked -> user |
Opened user | Done user, Opened -> system.  To each terminal belong error productions with a weight: a row may be
deleted, a row may take the terminal's role instead of its own (user and assistant only), and the terminal may be
inserted.  An Earley chart is built over the rows in order.  Every nonterminal of this grammar begins where the
conversation begins, so an item's origin is always 0: completing looks back to the first set alone, and a set holds at
most one item for each dotted rule.  An item keeps the least (cost, audit), audit being the initials of the edits so
far; a set is settled in that order, so its smallest item is final when it is taken.  The smallest completed Talk over
all rows is the repair.

Rows reach a task sorted by conversation and turn, and one conversation is parsed while its rows stream by.  What all
live items' audits have in common is decided and leaves at once as repaired rows, and items that cost more than `SLACK`
above the cheapest are dropped, since the cheapest can reach any item's future for less (an insert or two and the
deletion of a system row).  So a worker holds the undecided rows and 16 bytes per row for repeats, not the texts of a
conversation; a conversation is one task's work, as the digest of its text must be made in order.

Which fault a row has: blank (no word in its text), duplicate (role and text of an earlier row), truncated (the last
character that isn't white space is no full stop, question or exclamation mark); the first that holds counts.  Blank
and duplicate rows must be deleted, and a truncated row that stays costs `truncated` more.

Defined results: null roles and texts are one space, so such rows are deleted or get a role; an empty role can't stay
either; null turns come first, rows of equal turn by role and text; null conversation ids are one conversation; a
conversation without rows costs nothing and its digest is that of the empty string.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


# rules of the grammar: name -> alternatives; lower-case symbols are initials of roles
GRAMMAR = {"Talk": ((), ("Done",)), "Done": (("Asked", "a"),), "Asked": (("u",), ("Opened", "u"), ("Done", "u")), "Opened": (("s",),)}
RULES = tuple((head, body) for head, bodies in GRAMMAR.items() for body in bodies)
WAITING = {name: tuple(k for k, (_, body) in enumerate(RULES) if body[:1] == (name,)) for name in GRAMMAR}
START = tuple((k, 0) for k, (_, body) in enumerate(RULES) if not body or body[0] not in GRAMMAR)  # what prediction adds at 0
#: Symbol after the dot, of items that stand before a terminal; and the items that complete Talk.
NEXT = {(k, dot): body[dot] for k, (_, body) in enumerate(RULES) for dot in range(len(body)) if body[dot] not in GRAMMAR}
FINAL = {(k, len(body)) for k, (head, body) in enumerate(RULES) if head == "Talk"}


def settle(found: list[tuple[int, str, tuple[int, int]]], costs: Costs) -> dict[tuple[int, int], tuple[int, str]]:
    """The items of one set with their least (cost, audit), closed under completion and insertion."""
    heapq.heapify(found)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    limit = None
    slack = 2 * costs.insert + costs.delete
    while found:
        cost, audit, item = heapq.heappop(found)
        if item in best or limit is not None and cost > limit:
            continue
        if limit is None:
            limit = cost + slack
        best[item] = cost, audit
        k, dot = item
        if item in NEXT:
            if NEXT[item] in ROLES:
                heapq.heappush(found, (cost + costs.insert, audit + "I", (k, dot + 1)))
        elif item not in FINAL:  # complete: what waits for it at the start moves on
            for w in WAITING[RULES[k][0]]:
                heapq.heappush(found, (cost, audit, (w, 1)))
    return best


@dataclass
class Parse:
    """One conversation's chart, of which only the last set is needed, and what is decided so far."""

    costs: Costs
    spent: int = 0
    decided: list[str] = field(default_factory=list)
    items: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.items = settle([(0, "", item) for item in START], self.costs)

    def scan(self, initial: str, must_go: bool, truncated: bool) -> None:
        c, found = self.costs, []
        stays = c.truncated if truncated else 0
        for item, (cost, audit) in self.items.items():
            symbol = NEXT.get(item)
            if symbol or item in FINAL:
                found.append((cost + c.delete, audit + "D", item))
            if symbol and not must_go:
                after = (item[0], item[1] + 1)
                if symbol == initial:
                    found.append((cost + stays, audit + "K", after))
                elif symbol in ROLES:
                    found.append((cost + stays + c.rerole, audit + "R", after))
        self.items = settle(found, c)

    def decide(self, last: bool = False) -> str:
        """The edits that are decided since the last call: what all items begin with, or at the end the cheapest repair."""
        if last:
            cost, audit = min(v for k, v in self.items.items() if k in FINAL)
            self.spent += cost
            self.decided.append(audit)
            return audit
        audits = [audit for _, audit in self.items.values()]
        low, high = min(audits), max(audits)
        n = next((k for k, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
        least = min(cost for cost, _ in self.items.values())
        self.spent += least
        self.items = {k: (cost - least, audit[n:]) for k, (cost, audit) in self.items.items()}
        if n:
            self.decided.append(low[:n])
        return low[:n]


class Conversation:
    """Takes rows in order; gives repaired rows as they are decided, and a report at the end."""

    def __init__(self, conv_id, costs: Costs):
        self.conv_id, self.parse = conv_id, Parse(costs)
        self.seen: set[bytes] = set()
        self.waiting: list[tuple] = []
        self.at = 0  # of the waiting rows the first that is not yet edited
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.place = 0
        self.low = self.high = self.turn = self.before = None
        self.last = ""  # initial of the last repaired row
        self.digest = hashlib.sha256()

    def add(self, turn, role: str, text: str) -> Iterator[tuple]:
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turns, self.turn = turn if self.low is None else self.low, turn, self.turns + 1, turn
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        end = text.rstrip(WHITE)
        repeated, truncated = key in self.seen, False
        self.seen.add(key)
        if not end:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif truncated := end[-1] not in ".!?":
            self.truncated += 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.waiting.append((turn, role, text))
        self.parse.scan(initial, not end or repeated, truncated)
        if len(self.waiting) >= 16:
            yield from self._edited(self.parse.decide())

    def _edited(self, audit: str) -> Iterator[tuple]:
        for edit in audit:
            if edit == "I":
                turn, role, text = None, None, ""
            else:
                turn, role, text = self.waiting[self.at]
                self.at += 1
                if edit == "D":
                    continue
            if edit != "K":
                role = ROLES["a" if self.last == "u" else "u"]
            self.last = role[0]
            self.digest.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
            yield self.conv_id, self.place, turn, role, text, edit
            self.place += 1
        self.waiting, self.at = self.waiting[self.at :], 0

    def end(self) -> Iterator[tuple]:
        yield from self._edited(self.parse.decide(last=True))

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.parse.spent, "".join(self.parse.decided), self.digest.hexdigest())


REPORT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
          ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
TURNS = [("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]


def _parsed(costs: Costs, fields: list, turns: bool):
    """A function over batches of rows that are sorted by conversation; gives a report each, or the repaired rows."""

    def sealed(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = [kind, *[t for _, t in fields]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", *[n for n, _ in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, held, kind = None, [], 0, pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for conv, there, turn, role, text in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        rows = list(now.end())
                        out += rows if turns else [now.report()]
                    now = Conversation(conv, costs)
                if there:
                    for row in now.add(turn, role, text):
                        if turns:
                            out.append(row)
                            held += len(row[4])
                if len(out) >= 2000 or held >= 1 << 24:
                    yield sealed(out, kind)
                    out, held = [], 0
        if now is not None:
            rows = list(now.end())
            out += rows if turns else [now.report()]
        if out:
            yield sealed(out, kind)

    return run


def _repaired(rows: DataFrame, costs: Costs, fields: list, turns: bool, conv_col: str, turn_col: str, role_col: str, text_col: str, there: Column) -> DataFrame:
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col(conv_col).alias("conv_id"), there.alias("there"), F.col(turn_col).cast("long").alias("turn"), one_space(role_col).alias("role"), one_space(text_col).alias("text"))
    kind = own.schema["conv_id"].dataType.simpleString()
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    names = {pa.int64(): "long", pa.string(): "string"}
    return ordered.mapInArrow(_parsed(costs, fields, turns), f"conv_id {kind}, " + ", ".join(f"{n} {names[t]}" for n, t in fields))


def repair(rows: DataFrame, costs: Costs = Costs(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           there: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    there: false for rows that only name a conversation, which is then reported even if none of its rows is left.
    """
    return _repaired(rows, costs, REPORT, False, conv_col, turn_col, role_col, text_col, F.lit(True) if there is None else there)


def repaired(rows: DataFrame, costs: Costs = Costs(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: conv_id, place (0, 1, ...), turn (null for inserted rows), role, text and edit (K, R or I)."""
    return _repaired(rows, costs, TURNS, True, conv_col, turn_col, role_col, text_col, F.lit(True))


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) after a damage that depends on conversation and turn, with `there` false for rows
    that are dropped.  By the remainder of crc32("conv_id:turn") by 20: 0 drops the row, 1 empties its text, 2 takes out
    its full stops, question and exclamation marks, 3 repeats it, 4 makes it the user's.  Nulls are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    role = F.when(hit == 4, F.lit("user")).otherwise(text_of("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (hit != 0).alias("there"), hit.alias("hit"))
    return out.withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("hit", "copy")
