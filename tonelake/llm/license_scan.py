"""Licence scans by a positional index of rare words, in DataFrame functions only.

Method: the licence templates below give a positional index: for each of a template's `per_template` rarest words the
places where it stands.  How rare a word is, its inverse document frequency, is counted over all documents.  Each text
is cut into words and all its indexed words, of which there are no more than the templates hold, are looked up; each
place of one in the text minus its place in a template is the offset at which that template would have to begin.  The
offset that most places agree on decides: where at least `share` of the template's indexed words agree, and every
mandatory phrase of the template stands in the text, the template's label is given.

A text is handled where it lies: nothing is shuffled but one count per licence word and task.  What is collected is
those counts, bounded by the number of words in the templates, whatever the number of documents.

Beside this stand the base phrases, searched literally in every text: their places, labels and first and last word.

Defined results: a null text counts as empty; texts without words have zero counts, null first and last word, empty
labels and a score of zero; repeated rows and ids give a row each; ties in rarity go by the word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import ascii_lower

# Base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    mandatory: tuple[str, ...]


# Well-known sentences of public licences, and the phrases without which they don't count.
TEMPLATES = (
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    Template("cc0", "dedicated to the public domain under the creative commons cc0 1 0 universal dedication", ("public domain", "cc0 1 0")),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("terms of the gnu general public license",)),
    Template("lgpl", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited", ("unauthorized copying", "strictly prohibited")),
)


def padded(text: Column) -> Column:
    """The words of a text, in lower case (A-Z only), with single spaces between, before and after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD, " ")), F.lit(" "))


def _words_in(piece: Column) -> Column:
    """Words of a part that begins and ends with a space."""
    return (F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit(""))) - 1).cast("long")


def document_frequency(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many texts each word of the vocabulary occurs; at most one number a word comes to the driver."""
    found = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(padded(F.col(text_col)), " "))
    rows = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    return {r.word: r.n for r in rows}


def _posting(templates: tuple[Template, ...], df: dict[str, int], per_template: int) -> tuple[list[str], dict, list[int]]:
    """The indexed words, rarest first; word -> (template, place) pairs; and each template's number of indexed places."""
    rarity = lambda w: (df.get(w, 0), w)
    posting: dict[str, list[tuple[int, int]]] = {}
    places = []
    for t, template in enumerate(templates):
        words = template.words.split(" ")
        rare = set(sorted(set(words), key=rarity)[:per_template])
        places.append(sum(w in rare for w in words))
        for k, w in enumerate(words):
            if w in rare:
                posting.setdefault(w, []).append((t, k))
    return sorted(posting, key=rarity), posting, places


def _most_agreeing(offsets: Column) -> Column:
    """The largest number of equal values in an array of numbers."""
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(offsets), start, step, lambda s: s["best"])


def _offsets(hits: Column, uses: dict[str, list[int]]) -> Column:
    """Where a template would begin, for each place of its words in the text and each of their places in it."""
    of_word = F.create_map(*[x for w, ks in uses.items() for x in (F.lit(w), F.array(*map(F.lit, ks)))])
    return F.flatten(F.transform(F.filter(hits, lambda h: h["w"].isin(*uses)),
                                 lambda h: F.transform(F.element_at(of_word, h["w"]), lambda k: h["i"] - k)))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE, per_template: int = 8,
         share: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row."""
    vocabulary = sorted({w for t in templates for w in t.words.split(" ")})
    df = document_frequency(docs, vocabulary, text_col)
    index, posting, places = _posting(templates, df, per_template)

    rows = docs.select(F.col(id_col).alias("doc_id"), padded(F.col(text_col)).alias("p"))
    rows = rows.withColumn("words", F.split("p", " "))  # with an empty word before and after
    rows = rows.withColumn("n_words", F.when(F.col("p") == "  ", F.lit(0)).otherwise(F.size("words") - 2).cast("long"))

    # base phrases: the text is cut at them, so the parts tell their number and their places
    any_base = F.lit(False)
    for phrase in base:
        any_base = any_base | F.contains("p", F.lit(f" {phrase} "))
    pattern = f"(?<= )(?:{'|'.join(map(re.escape, base))})(?= )"
    rows = (rows.withColumn("parts", F.when(any_base, F.split("p", pattern, -1)))
            .withColumn("last_phrase", F.when(any_base, F.element_at(F.regexp_extract_all("p", F.lit(pattern), F.lit(0)), -1))))
    base_labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains("p", F.lit(f" {phrase} ")), F.lit(label)) for phrase, label in base.items()]))))

    # the indexed words of the text, and all places of them where they are enough for any template
    rows = rows.withColumn("rare", F.array_intersect(F.array(*map(F.lit, index)), F.col("words")))
    near = F.lit(False)
    for t, n in enumerate(places):
        mine = sorted(w for w, uses in posting.items() if any(s == t for s, _ in uses))
        near = near | (F.size(F.array_intersect("rare", F.array(*map(F.lit, mine)))) >= share * len(mine))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains("rare", x["w"]))
    rows = rows.withColumn("hits", F.when(near, hits))

    votes = []
    for t, template in enumerate(templates):
        mine = {w: [k for s, k in uses if s == t] for w, uses in posting.items() if any(s == t for s, _ in uses)}
        phrases = F.lit(True)
        for m in template.mandatory:
            phrases = phrases & F.contains("p", F.lit(f" {m} "))
        # the agreement is only worked out where it can count: the phrases of most templates are in few texts
        votes.append(F.when(F.col("hits").isNotNull() & phrases, _most_agreeing(_offsets(F.col("hits"), mine)) / places[t]).otherwise(F.lit(0.0)))
    rows = rows.select("doc_id", "n_words", "parts", "last_phrase", base_labels.alias("base"), F.array(*votes).alias("votes"))

    own = F.array_compact(F.array(*[F.when(F.element_at("votes", t + 1) >= share, F.lit(x.label)) for t, x in enumerate(templates)]))
    first, last = F.element_at("parts", 1), F.element_at("parts", -1)
    return rows.select(
        "doc_id", "n_words",
        F.coalesce(F.size("parts").cast("long") - 1, F.lit(0).cast("long")).alias("n_base"),
        _words_in(first).alias("first_word"),
        (F.col("n_words") - _words_in(last) - F.size(F.split("last_phrase", " "))).alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.array_max("votes"))).alias("score"))
