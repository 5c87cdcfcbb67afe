"""Normalizing text, its quoted and code zones, and a hint of its language.

Case folding, compatibility forms and dropping marks are not in Spark SQL, so `normalize_col` runs Python on Arrow
batches for the texts that aren't ASCII; ASCII texts, and look-alike digits, spaces, shadows and the language hint of all
texts, are built-in columns.
All offsets count UTF-8 bytes.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike characters and the letters they stand for.
LEET_FROM, LEET_TO = "4@01!35$7", "aaoiiesst"
# Scripts in the order that breaks ties, and the languages that the presence of a script tells, by precedence.
SCRIPTS = ("Hiragana", "Katakana", "Hangul", "Han", "Arabic", "Hebrew", "Thai", "Greek", "Cyrillic", "Georgian", "Armenian", "Devanagari", "Latin")
LANG_OF_SCRIPT = {"Hiragana": "ja", "Katakana": "ja", "Hangul": "ko", "Arabic": "ar", "Hebrew": "he", "Thai": "th", "Greek": "el"}
LEAST_LETTERS = 20

# The characters of Unicode's White_Space property, as a class for Python and Java expressions.
SPACES = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"

WORD = r"\p{L}\p{N}\p{Mn}\p{Pc}"
CHUNK, LEVELS = 16, 4  # pieces whose lengths are summed up one by one, and how often chunks are chunked again

_control = re.compile(CONTROL)
_leet = str.maketrans(LEET_FROM, LEET_TO)
_space = re.compile(f"[{SPACES}]+")
_fence = re.compile(r"```(.*?)```", re.S)
_inline = re.compile(r"`([^`]*)`")
_quoted = re.compile(r"^[ \t]*> *([^ \n][^\n]*)", re.M)


SLICE = 64  # texts that a worker holds as Python strings at a time


def in_slices(texts: pa.Array, of: Callable, kind: pa.DataType) -> pa.Array:
    """of(text) for each text of an Arrow batch; Python objects are made for a few texts at a time, not for the batch."""
    own = [pa.array([of(t) for t in texts.slice(k, SLICE).to_pylist()], kind) for k in range(0, len(texts), SLICE)]
    return pa.concat_arrays(own) if own else pa.array([], kind)


def sanitize(text: str) -> str:
    """Without control characters but tab and line ends, and without what is no valid Unicode."""
    return _control.sub("", text.encode("utf-8", "ignore").decode())


def fold_spaces(text: str) -> str:
    """Runs of white space become one line end where they hold one, else one space; none at either end."""
    return _space.sub(lambda m: "\n" if "\n" in m[0] or "\r" in m[0] else " ", text).strip(" \n")


def normalize(text: str | None, leet: str = "reference") -> str | None:
    """leet: 'reference' maps look-alikes everywhere, 'word_internal' only between letters, 'off' never."""
    if text is None:
        return None
    s = sanitize(text)
    s = s.lower() if s.isascii() else _without_marks(unicodedata.normalize("NFKC", s).casefold())
    if leet == "reference":
        s = s.translate(_leet)
    elif leet == "word_internal":
        s = re.sub(rf"(?<=[^\W\d_])[{re.escape(LEET_FROM)}]+(?=[^\W\d_])", lambda m: m[0].translate(_leet), s)
    return fold_spaces(s)


@lru_cache(maxsize=1)
def _dropped() -> tuple[re.Pattern, re.Pattern]:
    """Marks and format characters as classes of ranges, below and above U+FFFF (a class of both is slow)."""
    def ranges(low: int, high: int) -> re.Pattern:
        points = [c for c in range(low, high) if unicodedata.category(chr(c)) in ("Mn", "Cf")]
        starts = [c for k, c in enumerate(points) if not k or points[k - 1] != c - 1]
        ends = [c for k, c in enumerate(points) if k + 1 == len(points) or points[k + 1] != c + 1]
        return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]+")

    return ranges(0, 0x10000), ranges(0x10000, sys.maxunicode + 1)


def _without_marks(text: str) -> str:
    low, high = _dropped()
    text = low.sub("", text)
    return high.sub("", text) if text and max(text) > "\uffff" else text


def normalize_col(c: Column, leet: str = "reference") -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normalize(t, leet))

    if leet == "word_internal":
        return run(c)
    plain = F.octet_length(c) == F.char_length(c)
    own = F.lower(F.regexp_replace(c, CONTROL, ""))
    return F.when(plain, fold_spaces_col(leet_fold(own) if leet == "reference" else own)).otherwise(run(F.when(~plain, c)))


def leet_fold(c: Column) -> Column:
    return F.translate(c, LEET_FROM, LEET_TO)


def fold_spaces_col(c: Column) -> Column:
    """The same; what is left of a run without a line end is no line end."""
    lines = F.regexp_replace(c, f"[{SPACES}]*[\\r\\n][{SPACES}]*", "\n")
    return F.trim(F.regexp_replace(lines, f"[{SPACES}&&[^\\n]]+", " "), F.lit(" \n"))


def without_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{Nd}_]", "")


def squash_repeats(c: Column) -> Column:
    """At most two of a character in a row."""
    return F.regexp_replace(c, r"(?s)(.)\1{2,}", "$1$1")


def zones(text: str, inline_in_fence: bool = False) -> list[tuple[str, int, int]]:
    """(type, start, end) of fenced code, inline code and quoted lines, in byte offsets, without their marks.

    inline_in_fence also tags a fence's content as inline code."""
    at = _byte_offsets(text)
    found, fences = [], [m.span() for m in _fence.finditer(text)]
    found += [("code_fence", at[m.start(1)], at[m.end(1)]) for m in _fence.finditer(text) if m[1]]
    if inline_in_fence:
        found += [("code_inline", s, e) for _, s, e in found]
    hidden = list(text)
    for a, b in fences:
        hidden[a:b] = "\0" * (b - a)
    rest = "".join(hidden)
    found += [("code_inline", at[m.start(1)], at[m.end(1)]) for m in _inline.finditer(rest) if m[1] and "\0" not in m[0]]
    found += [("quote", at[m.start(1)], at[m.end(1)]) for m in _quoted.finditer(text)]
    return found


def pieces(c: Column) -> Column:
    """A text cut into runs of word characters and single other characters, none left out."""
    return F.regexp_extract_all(c, F.lit(f"(?s)[{WORD}]+|."), F.lit(0))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, also where it is used for each element of an array."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def sums(sizes: Column) -> Column:
    """The sum of all elements before each one of an array of numbers.

    They are summed up within chunks, the chunks' totals within chunks of their own, and so on, so the work is
    elements * CHUNK + (elements / CHUNK^LEVELS)^2 additions and no array grows by one element at a time."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def before(sizes: Column, levels: int) -> Column:
        if not levels:
            return F.transform(sizes, lambda _, i: total(F.slice(sizes, F.lit(1), i)))
        firsts = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int"))
        return let(F.transform(firsts, lambda k: F.slice(sizes, k * CHUNK + 1, F.lit(CHUNK))), lambda chunks: over(chunks, levels))

    def over(chunks: Column, levels: int) -> Column:
        inside = lambda c, base: F.transform(c, lambda _, i: base + total(F.slice(c, F.lit(1), i)))
        return let(F.transform(chunks, total), lambda sums: F.flatten(F.zip_with(chunks, before(sums, levels - 1), inside)))

    return let(sizes, lambda sizes: before(sizes, LEVELS))


def starts(parts: Column) -> Column:
    """The byte offset at which each part of a text begins, and that of the end."""
    # one more part of no length, which begins at the end
    return sums(F.concat(F.transform(parts, lambda x: F.octet_length(x)), F.array(F.lit(0))))


def zones_col(c: Column, inline_in_fence: bool = False) -> Column:
    """What `zones` gives, as a column of array<struct<type, start, end>>; null for a null text.

    A text is cut into fences, ticks and what lies between; single ticks pair up in their order, and a pair is inline code
    if exactly one piece that is no fence lies within.  Quotes are found line by line."""
    zone = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), a.alias("start"), b.alias("end"))
    is_fence = lambda p: (F.octet_length(p) > 1) & F.startswith(p, F.lit("`"))

    def of_pieces(placed: Column) -> Column:
        fences = F.transform(F.filter(placed, lambda x: is_fence(x["p"]) & (F.octet_length(x["p"]) > 6)),
                             lambda x: zone("code_fence", x["a"] + 3, x["a"] + F.octet_length(x["p"]) - 3))
        again = F.transform(fences, lambda x: zone("code_inline", x["start"], x["end"]))
        ticks = F.filter(F.transform(placed, lambda x, i: F.when(x["p"] == "`", i + 1)), lambda i: i.isNotNull())
        return F.concat(fences, *([again] if inline_in_fence else []), let(ticks, lambda t: inline(placed, t)))

    def inline(placed: Column, ticks: Column) -> Column:
        pairs = F.transform(ticks, lambda r, i: F.struct(F.element_at(ticks, F.greatest(i, F.lit(1))).alias("l"), r.alias("r"), i.alias("i")))
        pairs = F.filter(pairs, lambda t: (t["i"] % 2 == 1) & (t["r"] == t["l"] + 2) & ~is_fence(F.element_at(placed, F.least(t["l"] + 1, F.size(placed)))["p"]))
        return F.transform(pairs, lambda t: zone("code_inline", F.element_at(placed, t["l"] + 1)["a"], F.element_at(placed, t["r"])["a"]))

    def quotes(lines: Column, at: Column) -> Column:
        quoted = F.zip_with(lines, F.slice(at, F.lit(2), F.size(lines)), lambda x, e: F.struct(
            F.octet_length(F.regexp_extract(x, "^[ \\t]*> *([^ \\n][^\\n]*)", 1)).alias("n"), (e - F.when(F.endswith(x, F.lit("\n")), 1).otherwise(0)).alias("e")))
        return F.transform(F.filter(quoted, lambda q: q["n"] > 0), lambda q: zone("quote", q["e"] - q["n"], q["e"]))

    def with_starts(parts: Column) -> Column:
        return let(starts(parts), lambda at: let(F.zip_with(parts, F.slice(at, F.lit(1), F.size(parts)), lambda p, a: F.struct(p.alias("p"), a.alias("a"))), of_pieces))

    cut = F.regexp_extract_all(c, F.lit("(?s)```.*?```|[^`]+|`"), F.lit(0))
    lines = F.regexp_extract_all(c, F.lit("[^\\n]*\\n|[^\\n]+"), F.lit(0))
    found = F.concat(let(cut, with_starts), let(lines, lambda x: let(starts(x), lambda at: quotes(x, at))))
    return F.when(c == "", F.array().cast("array<struct<type:string,start:int,end:int>>")).otherwise(found)


def _byte_offsets(text: str) -> list[int]:
    """The byte offset of each character and of the end; cheap for ASCII texts."""
    if text.isascii():
        return list(range(len(text) + 1))
    out, n = [], 0
    for c in text:
        out.append(n)
        n += len(c.encode("utf-8", "surrogatepass"))
    out.append(n)
    return out


def script_hint(c: Column) -> Column:
    """struct(script, lang): the script of most letters, and of texts of 20 letters or more the language that a script's
    presence tells.

    Letters are taken out script by script, and counted by what is left, so each pass reads only the letters that no
    script before had; Latin comes first, since it leaves nothing of most texts."""
    def counted(rest: Column, left: tuple[str, ...], count: dict[str, Column], every: Column) -> Column:
        if not left:
            return told(count, every)
        s = left[0]
        return let(F.regexp_replace(rest, rf"\p{{Is{s}}}+", ""), lambda r: counted(r, left[1:], count | {s: F.char_length(rest) - F.char_length(r)}, every))

    def told(count: dict[str, Column], every: Column) -> Column:
        ranked = F.array(*[F.struct((-count[s]).alias("n"), F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(SCRIPTS)])
        lang = F.when(every < LEAST_LETTERS, "")
        for s, code in LANG_OF_SCRIPT.items():
            lang = lang.when(count[s] > 0, code)
        return let(F.array_min(ranked), lambda first: F.struct(F.when(first["n"] < 0, first["s"]).otherwise("").alias("script"), lang.otherwise("").alias("lang")))

    return let(F.regexp_replace(c, r"\P{L}+", ""), lambda own: counted(own, SCRIPTS[::-1], {}, F.char_length(own)))


def script_and_lang(c: Column) -> tuple[Column, Column]:
    """The two fields of `script_hint`; take that where both are wanted."""
    found = script_hint(c)
    return found["script"], found["lang"]
