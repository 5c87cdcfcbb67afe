"""Spelling variants, conversation repair and source mixing against plain versions, and on odd tables."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import no_docs, odd_docs

from tonelake.llm import conversation_repair, queries, source_mix, spelling_variants

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


# ---------------------------------------------------------------- 11: spelling variants

def plain_counts(rows, least_length=7, least_n=2):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_n}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def plain_variants(counts, times=10):
    near = {w: {v for v in counts if abs(len(v) - len(w)) <= 1 and v != w and one_apart(w, v)} for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) if vs else None for w, vs in near.items()}
    form = {w: v if v and counts[v] >= times * counts[w] else None for w, v in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def found_variants(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def variant_docs(spark, seed=3, n=60):
    """Frequent words, chains of ever rarer variants, runs of equal letters, accents and words at both ends of the cells."""
    rng, pool = random.Random(seed), []
    for w in ("abcdefgh", "aaaaaaaa", "überfällig", "conversations", "zzzyyyxxx"):
        for n_of in (900, 60, 4):
            pool += [w] * n_of
            p = rng.randrange(len(w))
            w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("aexyé") + w[p:], w[:p] + rng.choice("aexyé") + w[p + 1 :]])
    pool += ["".join(rng.choice("ab") for _ in range(rng.choice((7, 8)))) for _ in range(1500)]
    rng.shuffle(pool)
    rows = [(k, " ".join(pool[k::n]) + rng.choice(["", ".", "-X1"])) for k in range(n)]
    return spark.createDataFrame([*rows, rows[0], (None, rows[1][1])], "doc_id long, text string")


@pytest.mark.parametrize("block", [1 << 19, 64])
def test_variants_against_all_pairs(spark, block):
    docs = variant_docs(spark)
    counts = plain_counts([(r.doc_id, r.text) for r in docs.collect()])
    want = plain_variants(counts)
    got = found_variants(spelling_variants.variants(docs, block=block))
    assert got == want and any(f for f, *_ in want.values()) and any(r != w and r != f for w, (f, r, *_) in want.items() if f)


@needs_data
def test_variants_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert found_variants(queries.op11_spelling_variants(spark, SMALL)) == plain_variants(plain_counts(rows))


def test_variants_of_odd_tables(spark):
    docs = odd_docs(spark)
    assert found_variants(spelling_variants.variants(docs)) == plain_variants(plain_counts([(r.doc_id, r.text) for r in docs.collect()]))
    assert spelling_variants.variants(no_docs(spark)).count() == 0
    assert spelling_variants.variants(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=4, max_size=4), st.integers(1, 41), st.integers(0, 1000))
def test_wavelet_tree_reports_rectangles(bounds, n, seed):
    values = np.random.default_rng(seed).permutation(n)
    (lo, hi), (least, most) = sorted(min(b, n) for b in bounds[:2]), sorted(min(b, n) for b in bounds[2:])
    q, found = spelling_variants.WaveletTree(values).report(*(np.array([x, 0]) for x in (lo, hi, least, most)))
    assert sorted(found[q == 0]) == sorted(v for v in values[lo:hi] if least <= v < most) and not (q == 1).any()


# ---------------------------------------------------------------- 12: conversation repair

WHITE = " \t\n\x0b\x0c\r"


def plain_repair(rows, costs=conversation_repair.Costs()):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of rows (turn, role, text), trying every audit of
    least cost: a search over (rows read, roles given) that keeps all audits of equal cost."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))

    # state of what was given: "" nothing, "s", "u" or "a" as the last initial
    allowed = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    level = {"": {(0, "", ())}}

    def least(options):
        best = min(c for c, *_ in options)
        return {o for o in options if o[0] == best} if len(rows) < 10 else {min(options)}

    def with_inserts(level):
        out = defaultdict(set)
        for state, options in level.items():
            out[state] |= options
            now, given = state, options
            for _ in range(3):
                to = "a" if now == "u" else "u"
                given = {(c + costs.insert, e + "I", o + (to,)) for c, e, o in given}
                out[to] |= given
                now = to
        return {s: least(o) for s, o in out.items()}

    level = with_inserts(level)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = defaultdict(set)
        for state, options in level.items():
            for c, e, o in options:
                new[state].add((c + costs.delete, e + "D", o))
                if fault in ("", "truncated"):
                    more = costs.truncated if fault else 0
                    if (state, role[:1]) in allowed:
                        new[role[:1]].add((c + more, e + "K", (*o, role[:1])))
                    for to in "ua":
                        if (state, to) in allowed:
                            new[to].add((c + more + costs.rerole, e + "R", (*o, to)))
        level = with_inserts(new)
    cost, audit, _ = min(o for s in ("", "a") for o in level.get(s, ()))
    out, at = [], 0
    for e in audit:
        last = out[-1][0] if out else ""
        name = "assistant" if last == "u" else "user"
        if e == "I":
            out.append(f"{name}:")
            continue
        _, role, text = rows[at]
        at += 1
        if e != "D":
            out.append(f"{role if e == 'K' else name}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    counts = Counter(faults)
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def found_repairs(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def plain_damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out[conv]
        text = " " if text is None else text
        if h:
            row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            own += [row, row] if h == 3 else [row]
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def invented(seed, n=400):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "sysop", "User"]
    texts = ["Yes.", "No!", "Why?", "well", "", None, " \t", "Yes. ", "a\nb.", " ", "done.\n"]
    rows = []
    for c in range(n):
        for _ in range(rng.randrange(1, 9)):
            rows.append((c if c else None, rng.choice([None, 0, 1, 2, 3, 4, 5, 9]), rng.choice(roles[: rng.choice((3, 10))]), rng.choice(texts[: rng.choice((3, 11))])))
    return rows


def test_repairs_against_search(spark):
    rows = invented(5)
    data = spark.createDataFrame(rows, CONVERSATIONS).withColumn("there", F.lit("clash")).withColumn("edit", F.lit(1))
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv].append(tuple(row))
    want = {c: plain_repair(r) for c, r in by.items()}
    assert found_repairs(conversation_repair.repair(data)) == want
    assert set("".join(w[6] for w in want.values())) == {"K", "R", "D"}  # at these costs a deletion always beats an insertion

    given = defaultdict(list)
    for r in conversation_repair.repaired(data).orderBy("conv_id", "place").collect():
        assert r.place == len(given[r.conv_id]) and (r.edit == "I") <= (r.text == "" and r.turn is None)
        given[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(given[c]).encode()).hexdigest() == w[7] for c, w in want.items())


def test_repairs_with_other_costs(spark):
    costs = conversation_repair.Costs(rerole=3, delete=4, insert=2, truncated=1)
    rows = invented(8, 150)
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv].append(tuple(row))
    data = spark.createDataFrame(rows, CONVERSATIONS)
    want = {c: plain_repair(r, costs) for c, r in by.items()}
    assert found_repairs(conversation_repair.repair(data, costs)) == want and {"K", "R", "D", "I"} <= set("".join(w[6] for w in want.values()))
    assert conversation_repair.repaired(data, costs).filter("edit = 'I'").count() == sum(w[6].count("I") for w in want.values())


def test_damaged_conversations(spark):
    rows = invented(6) + [(10_000 + k, k % 3, "user", "Only one.") for k in range(60)]
    want = {c: plain_repair(r) for c, r in plain_damaged(rows).items()}
    data = conversation_repair.damaged(spark.createDataFrame(rows, CONVERSATIONS))
    got = found_repairs(conversation_repair.repair(data, there=F.col("there")))
    nothing = hashlib.sha256(b"").hexdigest()
    assert got == want and any(w == (0, 0, 0, 0, 0, 0, "", nothing) for w in want.values())
    empty = conversation_repair.damaged(spark.createDataFrame([], CONVERSATIONS))
    assert conversation_repair.repair(empty, there=F.col("there")).count() == 0


def test_long_conversations_are_decided_on_the_way():
    rng = random.Random(4)
    talk = conversation_repair.Conversation(1, conversation_repair.Costs())
    rows = [(k, rng.choice(["user", "assistant", "system"]), rng.choice(["One.", "Two", "", f"Row {k}."])) for k in range(3000)]
    held, given = 0, 0
    for turn, role, text in rows:
        given += len(list(talk.add(turn, role, text)))
        held = max(held, len(talk.waiting), *(len(a) for _, a in talk.parse.items.values()))
    given += len(list(talk.end()))
    assert talk.report()[1:] == plain_repair(rows) and held < 200 and given == talk.place


@needs_data
def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found_repairs(queries.op12_conversation_repair(spark, SMALL)) == {c: plain_repair(r) for c, r in plain_damaged(rows).items()}


# ---------------------------------------------------------------- 13: mixing sources

def plain_targets(sizes):
    """sizes: (source, words) in order.  Shares again and again what is above three times a source's size."""
    weight = [1 + k % 3 for k in range(len(sizes))]
    total, stopped = sum(n for _, n in sizes), set()
    while True:
        rest = total - sum(3 * sizes[k][1] for k in stopped)
        open_ = sum(w for k, w in enumerate(weight) if k not in stopped)
        share = [3 * n if k in stopped else rest * weight[k] / open_ for k, (_, n) in enumerate(sizes)]
        above = {k for k, (_, n) in enumerate(sizes) if k not in stopped and share[k] > 3 * n}
        if not above:
            return {s: x for (s, _), x in zip(sizes, share, strict=True)}
        stopped |= above


def plain_seats(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats if any(weights) else 0):
        got[max(range(len(weights)), key=lambda k: (weights[k] / (2 * got[k] + 1), -k))] += 1
    return got


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.one_of(st.just(0.0), st.integers(1, 3000).map(float)), min_size=1, max_size=9), min_size=1, max_size=30), st.integers(0, 1000))
def test_seats_go_to_the_highest_quotients(spark, groups, seed):
    rng = random.Random(seed)
    seats = [rng.choice([0, 1, 2, 7, 100, 999]) for _ in groups]
    rows = [(g, k, w, seats[g]) for g, ws in enumerate(groups) for k, w in enumerate(ws)]
    got = source_mix.apportion(spark.createDataFrame(rows, "g int, k int, w double, s long"), ["g"], ["k"], "w", "s").collect()
    found = {(r.g, r.k): r.quota for r in got}
    assert len(got) == len(rows) and found == {(g, k): n for g, ws in enumerate(groups) for k, n in enumerate(plain_seats(ws, seats[g]))}


def mixed_docs(spark, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(900):
        source = rng.choice(["big"] * 12 + ["b", "é", "", None, "tiny"])
        rows.append((k, None if rng.random() < 0.02 else " ".join(["w"] * rng.randrange(0, 3 if source == "tiny" else 60)), source))
    rows += [(7, "same row \t again", "big")] * 40 + [(None, "no id\x0bhere  ", "b")] * 5 + [(2000, "l " * 9000, "é"), (2001, " \n", "empty")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit("clash")).withColumn("size", F.lit("clash"))


@pytest.mark.parametrize("shard_rows", [4096, 20])
def test_mix_against_plain_rules(spark, shard_rows):
    docs = mixed_docs(spark)
    got = source_mix.mix(docs, shard_rows=shard_rows).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r.doc_id, r.source, size(r.text)) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = plain_targets([(s, sizes[s]) for s in order])
    quota = dict(zip(order, plain_seats([want[s] for s in order], round(sum(sizes.values()) / 16)), strict=True))
    taken, shards = Counter(), defaultdict(set)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        shards[r.source].add(r.shard)
    for s in order:
        assert abs(taken[s] - want[s]) <= 16 * len(shards[s]) and 16 * quota[s] - 16 * len(shards[s]) <= taken[s] <= 16 * quota[s]
    assert sum(sizes.values()) - 16 * sum(map(len, shards.values())) <= sum(taken.values()) <= sum(sizes.values()) + 16
    again = source_mix.mix(docs.repartition(7), shard_rows=shard_rows).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_takes_whole_documents(spark):
    """Beyond whole rounds only the two documents at the ends of a shard's run are taken in part."""
    got = source_mix.mix(mixed_docs(spark)).collect()
    partial = Counter((r.source, r.shard) for r in got if r["size"] and r.taken % r["size"])
    assert max(partial.values()) <= 2


def test_mix_of_odd_tables(spark):
    docs = odd_docs(spark)
    got = source_mix.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert source_mix.mix(no_docs(spark)).count() == 0
    blank = source_mix.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert len(blank) == docs.count() and all((r["size"], r.source_size, r.target, r.taken) == (0, 0, 0.0, 0) for r in blank)


@needs_data
def test_mix_runs_no_python(spark):
    plan = queries.op13_source_mix(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
