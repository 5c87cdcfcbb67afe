"""Finding hits in normalized texts: regex templates, then a multi-pattern search for lemmas.

`detect` runs on Arrow batches and returns an array of hits per row; the automaton and the compiled patterns are built
once in each Python worker.  A hit is left out where a letter, digit, mark or underscore stands beside it, or where
the word around it is on the stop list.  Lemma hits don't overlap each other; templates and lemmas may.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tonelake.functions.ids import hit_uuid_col
from tonelake.functions.scalars import severity_of, stored_category
from tonelake.functions.text import _byte_offsets, in_slices, zones
from tonelake.operators.aggregates import best_per_key
from tonelake.sources.rulepack import Pack

HIT = ("struct<term:string,category:string,level:int,source:string,span_start:int,span_end:int,zones:array<string>,pre_context:string,"
       "post_context:string,ctx_action:string,target_type:string,target_id:string,target_name:string,target_start:int,target_end:int,target_distance:int>")
# Which target a slot names, and the category of anger at it.
TARGET_OF_SLOT = {"TARGET_BOT": "bot", "TARGET_TOOL": "tool", "TARGET_LANG": "lang", "TARGET_FRAMEWORK": "framework"}
RAGE_OF_TARGET = {"bot": "bot_rage", "tool": "tooling_rage", "lang": "lang_rage", "framework": "lang_rage"}
KINDS = (*TARGET_OF_SLOT.values(), "none")
PREFERRED = {"bot_rage": ("bot",), "tooling_rage": ("tool",), "lang_rage": ("lang", "framework")}
# Categories from the least to the most specific.
SPECIFIC = ("generic", "self_own", "lang_rage", "tooling_rage", "bot_rage")


@dataclass(frozen=True)
class Options:
    window: int = 64
    zone_delta: int = -1
    max_hits: int = 0  # all; a number ends a text's scan after so many hits
    inline_in_fence: bool = False


def _inside_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN" or unicodedata.category(c) in ("Mn", "Pc")


class Detector:
    def __init__(self, pack: Pack, options: Options = Options()):
        import ahocorasick

        self.pack, self.options = pack, options
        # word characters, digits and word edges are ASCII ones, and the vertical tab is no white space
        self.templates = [(t, re.compile(pack.expand(t.pattern).replace(r"\s", r"[ \t\n\r\f]"), re.ASCII)) for t in pack.templates]
        self.lemmas = ahocorasick.Automaton()
        for x in pack.lemmas:
            if x.term not in self.lemmas:
                self.lemmas.add_word(x.term, x)
        self.names = ahocorasick.Automaton()
        for slot, aliases in pack.slots.items():
            for alias, own in aliases.items():
                for n in own:
                    self.names.add_word(n, [*self.names.get(n, []), (n, TARGET_OF_SLOT.get(slot, "none"), alias)])
        for a in (self.lemmas, self.names):
            if len(a):
                a.make_automaton()

    def _alone(self, text: str, a: int, b: int) -> bool:
        return not (a and _inside_word(text[a - 1]) or b < len(text) and _inside_word(text[b]))

    def _stopped(self, text: str, a: int, b: int) -> bool:
        while a and _inside_word(text[a - 1]):
            a -= 1
        while b < len(text) and _inside_word(text[b]):
            b += 1
        return text[a:b] in self.pack.stop

    def _spans(self, text: str) -> Iterator[tuple]:
        """(rule, term, source, frustration, start, end) in characters: templates, then lemmas."""
        for t, pattern in self.templates:
            for m in pattern.finditer(text):
                if m.end() > m.start() and self._alone(text, *m.span()) and not self._stopped(text, *m.span()):
                    yield t, m[0], "template", t.frustration, m.start(), m.end()
        if len(self.lemmas):
            taken = 0
            ends = {}
            for last, x in self.lemmas.iter(text):
                ends.setdefault(last + 1, []).append(x)
            for b, own in ends.items():
                for x in sorted(own, key=lambda x: -len(x.term)):
                    a = b - len(x.term)
                    if a >= taken and self._alone(text, a, b) and not self._stopped(text, a, b):
                        taken = b
                        yield x, x.term, "lemma", False, a, b

    def _target(self, named: list[tuple], a: int, b: int, prefer: tuple[str, ...]) -> tuple | None:
        """The name that begins nearest to the hit's middle, of those wholly within the window in bytes around it.

        Preferred kinds come first; then distance, start, length and the order of kinds decide."""
        best, window, middle = None, self.options.window, (a + b) // 2
        for s, e, name, kind, alias in named:
            if s >= a - window and e <= b + window:
                distance = abs(middle - s)
                rank = (kind not in prefer, distance, s, -len(name), KINDS.index(kind))
                if best is None or rank < best[0]:
                    best = (rank, kind, alias, name, s, e, distance)
        return best and best[1:]

    def scan(self, text: str | None) -> list[dict]:
        if not text:
            return []
        found, at, data = [], None, None
        for rule, term, source, frustration, a, b in self._spans(text):
            if at is None:
                at, data = _byte_offsets(text), text.encode("utf-8", "surrogatepass")
                areas = zones(text, self.options.inline_in_fence)
                named = []
                if len(self.names):
                    for last, uses in self.names.iter(text):
                        for name, kind, alias in uses:
                            if self._alone(text, last + 1 - len(name), last + 1):
                                named.append((at[last + 1 - len(name)], at[last + 1], name, kind, alias))
            s, e, w = at[a], at[b], self.options.window
            tags = [z for z in ("code_fence", "code_inline", "quote") if any(k == z and e > x and s < y for k, x, y in areas)]
            level = max(1, rule.severity + self.options.zone_delta * len(tags))
            category, action = rule.category, "none"
            target = self._target(named, s, e, PREFERRED.get(category, ()))
            gated = w > 0 and len(self.names) > 0  # a pack that names no targets can't miss one
            if not gated:
                target = None
            elif target and category == "generic" and frustration:
                category, action = RAGE_OF_TARGET[target[0]], "upgraded"
            elif not target and category in PREFERRED:
                category, action = "generic", "downgraded"
            kind, alias, name, x, y, distance = target or ("none", None, None, None, None, None)
            found.append({
                "term": term, "category": category, "level": level, "source": source, "span_start": s, "span_end": e, "zones": tags,
                "pre_context": data[max(0, s - w) : s].decode("utf-8", "replace"), "post_context": data[e : e + w].decode("utf-8", "replace"),
                "ctx_action": action, "target_type": kind, "target_id": alias, "target_name": name,
                "target_start": x, "target_end": y, "target_distance": distance})
            if self.options.max_hits and len(found) >= self.options.max_hits:
                break
        return found


@lru_cache(maxsize=4)
def _built(key: str) -> Detector:
    pack, options = pickle.loads(bytes.fromhex(key))
    return Detector(pack, options)


def detect(text: Column, pack: Pack, options: Options = Options()) -> Column:
    """The array of hits of each normalized text."""
    key, kind = pickle.dumps((pack, options)).hex(), to_arrow_type(DataType.fromDDL(f"array<{HIT}>"))

    @F.arrow_udf(f"array<{HIT}>")
    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, _built(key).scan, kind)

    return run(text)


def hits(utterances: DataFrame, pack: Pack, version: int, options: Options = Options()) -> DataFrame:
    """One row per winning hit, in the stored form and with its id: of equal span and term a template wins over a
    lemma, then the more specific category, then the hit that was found first."""
    own = utterances.select("*", F.posexplode(detect(F.col("text_normalized"), pack, options)).alias("found", "h"))
    own = own.select(
        "found",
        F.col("id").alias("utterance_id"), "created_at", "source", "repo_hid", "actor_hid", "lang_code", "h.term", stored_category(F.col("h.category")).alias("category"),
        severity_of(F.col("h.level")).alias("severity"), "h.ctx_action", "h.target_type", "h.target_id", "h.target_name",
        F.col("h.target_start").alias("target_span_start"), F.col("h.target_end").alias("target_span_end"), "h.target_distance",
        "h.span_start", "h.span_end", F.lit(version).alias("detector_version"), F.col("h.source").alias("detector_source"),
        "h.pre_context", "h.post_context", "h.zones")
    specific = F.array_position(F.array(*map(F.lit, SPECIFIC)), F.col("category"))
    rank = F.struct((F.col("detector_source") == "template").alias("a"), specific.alias("b"), (-F.col("found")).alias("c"))
    best = best_per_key(own, ["utterance_id", "term", "span_start", "span_end"], rank).drop("found")
    key = [F.col(c) for c in ("utterance_id", "term", "category", "severity", "span_start", "span_end")]
    return best.withColumn("id", hit_uuid_col(*key)).withColumns({"ingest_batch_id": F.lit(version).cast("bigint"), "ver": F.lit(version).cast("bigint")})
