"""Normalizing, zones, rules and the detector, on texts worked out by hand."""

from __future__ import annotations

import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonelake.functions import ids
from tonelake.functions.text import fold_spaces, normalize, sanitize, script_and_lang, zones
from tonelake.operators.detector import Detector, Options, hits
from tonelake.sources.rulepack import OWN, Lemma, Pack, from_json, lower_pattern

PACK = from_json([OWN])


@pytest.mark.parametrize("raw, expected", [
    ("F4CK", "fack"), ("Straße", "strasse"), ("ｗｔｆ", "wtf"), ("a \t\n b", "a\nb"), ("wtf!", "wtfi"), ("", ""), ("a\x00\x07b", "ab"),
    ("a‍b", "ab"), ("  x  ", "x"), ("é", "é"),
])
def test_normalize(raw, expected):
    assert normalize(raw) == expected


def test_normalize_options():
    assert normalize(None) is None
    assert normalize("@bot c0de 404!", "word_internal") == "@bot code 404!"
    assert normalize("4", "off") == "4"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_normalize_settles(text):
    assert not set(normalize(text)) & set("4@01!35$7")
    assert fold_spaces(fold_spaces(text)) == fold_spaces(text)
    assert sanitize(sanitize(text)) == sanitize(text)


def test_zones():
    t = "a ```x y``` b `c`\n> q\nend"
    found = [(k, t.encode()[a:b].decode()) for k, a, b in zones(t)]
    assert found == [("code_fence", "x y"), ("code_inline", "c"), ("quote", "q")]
    assert ("code_inline", 5, 8) in zones(t, inline_in_fence=True)
    assert zones("ü `ö`")[0] == ("code_inline", 4, 6)  # bytes, not characters


def test_scripts(spark):
    texts = ["a" * 20, "а" * 20, "あ" * 20, "あ" * 19, "한" * 20, "ש" * 20, "ก" * 20, "α" * 20, "漢字" * 10 + "の", "", "123"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    s, lang = script_and_lang(F.col("t"))
    got = {r.t: (r.s, r.l) for r in df.select("t", s.alias("s"), lang.alias("l")).collect()}
    assert got["a" * 20] == ("Latin", "") and got["あ" * 20] == ("Hiragana", "ja") and got["あ" * 19] == ("Hiragana", "")
    assert [got[c * 20][1] for c in "한שกα"] == ["ko", "he", "th", "el"]
    assert got["漢字" * 10 + "の"] == ("Han", "ja") and got[""] == ("", "") and got["123"] == ("", "")


def scan(text, pack=PACK, **options):
    return [(h["term"], h["category"], h["level"], h["ctx_action"]) for h in Detector(pack, Options(**options)).scan(text)]


def test_detector_by_hand():
    assert scan("such a pathetic heap") == [("pathetic heap", "generic", 1, "none")]
    assert scan("clown") == [("clown", "harassment", 1, "none")]
    assert scan("xclownx clowns clown_ clown1") == [] and scan("snorgle, snorgle!") == []  # inside a word; on the stop list
    assert scan("soup of nothing") == [("soup of nothing", "generic", 2, "downgraded")]
    assert scan("soup of plimsol") == [("soup of plimsol", "lang_rage", 2, "none")] and scan("soup of vex++") == [("soup of vex++", "lang_rage", 2, "none")]
    assert ("zibbo helper fell asleep", "bot_rage", 2, "none") in scan("the zibbo helper fell asleep")
    assert scan("crumbled again stitchet") == [("crumbled again", "tooling_rage", 1, "upgraded")]
    assert scan("soup of nothing", Pack(templates=PACK.templates, slots={"TARGET_LANG": {}, "TARGET_BOT": {}})) == [("soup of nothing", "lang_rage", 2, "none")]
    far = Detector(PACK).scan("stitchet crumbled again lanternkit quillmaker")[0]
    assert (far["target_name"], far["target_distance"]) == ("lanternkit", 8)  # from the middle to the start
    assert scan("crumbled again " + "x" * 80 + " stitchet") == [("crumbled again", "generic", 1, "none")]
    assert scan("`flumdrub`")[0][2] == 1 and scan("flumdrub")[0][2] == 2 and scan("> flumdrub")[0][2] == 1
    assert scan(None) == [] and scan("") == []
    assert len(scan("clown " * 50, max_hits=7)) == 7 and len(scan("clown " * 9000, max_hits=0)) == 9000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["clown", "worthless", "pathetic heap", "soup of vex++", "soup of nothing", "zibbo", "snorgle", "é", "x_", "`", "```", ">", "\n", "stitchet", ",", "clowns", "crumbled again"]), max_size=12), st.sampled_from(["", " "]))
def test_detector_against_a_plain_one(parts, gap):
    """Spans, targets and zones of short texts by looking at every place of every word and phrase."""
    text = gap.join(parts)
    letter = lambda c: c.isalnum() or c == "_"
    alone = lambda a, b: not (a and letter(text[a - 1]) or b < len(text) and letter(text[b]))
    phrases = {"template": ["pathetic heap", "zibbo fell asleep", "soup of vex++", "soup of plimsol", "soup of nothing", "crumbled again"], "lemma": ["clown", "worthless", "flumdrub"]}
    want = sorted((len(text[:a].encode()), len(text[: a + len(p)].encode()), p, kind) for kind, own in phrases.items() for p in own for a in range(len(text))
                  if text.startswith(p, a) and alone(a, a + len(p)))
    found = Detector(PACK, Options(max_hits=0)).scan(text)
    assert sorted((h["span_start"], h["span_end"], h["term"], h["source"]) for h in found) == want
    data, areas = text.encode(), zones(text)
    for h in found:
        assert data[h["span_start"] : h["span_end"]].decode() == h["term"]
        assert h["zones"] == [z for z in ("code_fence", "code_inline", "quote") if any(k == z and h["span_end"] > a and h["span_start"] < b for k, a, b in areas)]
        assert h["level"] == max(1, {"flumdrub": 2, "soup of nothing": 2, "soup of vex++": 2}.get(h["term"], 1) - len(h["zones"]))
        names = [(len(text[:a].encode()), n) for n in ("zibbo", "stitchet") for a in range(len(text)) if text.startswith(n, a) and alone(a, a + len(n))]
        near = [abs((h["span_start"] + h["span_end"]) // 2 - a) for a, n in names if a >= h["span_start"] - 64 and a + len(n) <= h["span_end"] + 64]
        if "vex++" not in text and not (h["category"] == "tooling_rage" or h["term"].startswith("soup")):
            assert (h["target_distance"] if near else None) == (min(near) if near else None)


def test_lemmas_do_not_overlap():
    pack = Pack(lemmas=[Lemma("a b", "generic", 1), Lemma("b c", "generic", 1), Lemma("b", "generic", 1)])
    assert [t for t, *_ in scan("a b c", pack)] == ["a b"]


def test_byte_spans_and_context():
    h = Detector(PACK).scan("über clown ö")[0]
    assert (h["span_start"], h["span_end"], h["pre_context"], h["post_context"]) == (6, 11, "über ", " ö")


def test_rules():
    assert lower_pattern(r"\bFoo\S{TARGET_BOT}{0,3}") == r"\bfoo\S{TARGET_BOT}{0,3}"
    assert PACK.expand("{TARGET_LANG}{1,2}") == r"(?:plimsol|vex\+\+){1,2}"
    with pytest.raises(ValueError):
        PACK.expand("{NOBODY}")
    with pytest.raises(ValueError):
        from_json([{"version": 1}])
    assert from_json([OWN, OWN]) == from_json([OWN]) or len(from_json([OWN, OWN]).lemmas) == len(PACK.lemmas)


def test_winner_and_ids(spark):
    pack = Pack(lemmas=[Lemma("heap", "harassment", 3)], templates=[t for t in PACK.templates if t.id == "own.pair"])
    u = spark.createDataFrame([("00000000-0000-5000-8000-000000000001", "pathetic heap"), ("00000000-0000-5000-8000-000000000002", None)], "id string, text_normalized string")
    u = u.selectExpr("*", "timestamp'2024-01-01' as created_at", "'pr' as source", "cast(null as binary) as repo_hid", "cast(null as binary) as actor_hid", "'en' as lang_code")
    rows = {r.term: r for r in hits(u, pack, 3).collect()}
    assert set(rows) == {"pathetic heap", "heap"} and rows["heap"].category == "generic" and rows["heap"].severity == "strong"
    assert rows["heap"].id == ids.hit_uuid(rows["heap"].utterance_id, "heap", "generic", "strong", 9, 13) and rows["heap"].id[14] == "5"
    # a template wins over a lemma of equal span and term
    both = Pack(lemmas=[Lemma("pathetic heap", "harassment", 3)], templates=pack.templates)
    assert [(r.detector_source, r.severity) for r in hits(u, both, 3).collect()] == [("template", "mild")]


def test_detected_hits_of_documents(spark):
    """The registered query over all documents of the smallest tables against words looked up one by one."""
    import os
    import re

    from tonelake.plans import catalogue
    from tonelake.sources.facts import read

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    want = []
    for d in read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect():
        t = normalize(d.text) or ""
        for term, m in [(m[0], m) for p in ("worthless", "clown", "pathetic[ \n](?:heap|[a-z]+ing)") for m in re.finditer(rf"(?<![\w]){p}(?![\w])", t)]:
            want.append((d.doc_id, term, len(t[: m.start()].encode()), len(t[: m.end()].encode())))
    got = catalogue.QUERIES["l22_detected_hits"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((int(r.utterance_id[-12:], 16), r.term, r.span_start, r.span_end) for r in got) == sorted(want)


@pytest.mark.parametrize("leet", ["reference", "off", "word_internal"])
def test_normalize_columns(spark, leet):
    """ASCII texts in the JVM and others in Python come out as the plain function has them."""
    from pyspark.sql import functions as F

    from tonelake.functions.text import fold_spaces_col, normalize_col, squash_repeats

    texts = ["", " a \t\r\n b  c", "Wtf! C0DE\x0b\x07x\x1f\x7f", "É \u00a0\u2028 ß", "a\u0301\u200d", None, "4@01!35$7 X4Y", "\n\n", "ok\r", "İI", "\x85a\u3000 b", "tooooo\n\n\n\nlong"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("k", normalize_col(F.col("t"), leet).alias("n"), fold_spaces_col(F.col("t")).alias("f"), squash_repeats(F.col("t")).alias("s")).collect()
    assert {r.k: r.n for r in rows} == {k: normalize(t, leet) for k, t in enumerate(texts)}
    assert {r.k: r.f for r in rows} == {k: None if t is None else fold_spaces(t) for k, t in enumerate(texts)}
    assert rows[11].s == "too\n\nlong"


def test_identifiers():
    assert ids.zigzag(1) == b"\x02" and ids.zigzag(64) == b"\x80\x01"
    assert ids.fnv1a64(b"") == 0xCBF29CE484222325 and ids.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert ids.synthetic_id("actor:", "") == 0 and ids.synthetic_id("actor:", "x") < 0
    assert ids.batch_id(["b", "a"]) == ids.batch_id(["a", "b"])


def test_uuids_of_columns_are_those_of_values(spark):
    from tonelake.functions import ids

    numbers = [0, 1, -1, 63, 64, -65, 127, 128, 300, -(2**31), 2**31 - 1, 2**62, -(2**63), 2**63 - 1]
    rows = [(f"line é {n}\n", "Push:COMMIT", n, str(uuid.UUID(int=abs(n) * 7919)), "wörd", "generic", "mild", n % 2**31 - 2**30, n % 1000) for n in numbers]
    df = spark.createDataFrame(rows, "raw string, detail string, n long, u string, term string, category string, severity string, a int, b int")
    got = df.select("n", ids.utterance_uuid_col(F.col("raw"), F.col("detail"), F.col("n")).alias("x"), ids.hit_uuid_col(*[F.col(c) for c in ("u", "term", "category", "severity", "a", "b")]).alias("y"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    told = {r.n: (r.x, r.y) for r in got.collect()}
    for raw, detail, n, *hit in rows:
        assert told[n] == (ids.utterance_uuid(raw.encode(), detail, n), ids.hit_uuid(*hit))
    none = df.limit(1).select(ids.utterance_uuid_col(F.lit(None).cast("string"), F.col("detail"), F.col("n")).alias("x"), ids.hit_uuid_col(F.col("u"), F.lit(None).cast("string"), *[F.col(c) for c in ("category", "severity", "a", "b")]).alias("y")).first()
    assert none.x is None and none.y is None
