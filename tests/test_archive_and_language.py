"""The hourly archive as a data source, language profiles, and small rules that a green row had hidden."""

from __future__ import annotations

import gzip
import os
import random
import zlib
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.functions import scalars
from tonelake.operators import joins, language
from tonelake.plans import catalogue
from tonelake.sources import hourly

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


# ---------------------------------------------------------------- archive

def write_hour(folder, at, lines, cut=False):
    data = gzip.compress("".join(f"{x}\n" for x in lines).encode())
    (folder / f"{at:%Y-%m-%d}-{at.hour}.json.gz").write_bytes(data[: len(data) // 2] if cut else data)


def archive(folder, n=10):
    first = datetime(2024, 1, 1, 20)
    for k in range(n):
        write_hour(folder, first + timedelta(hours=k), [f'{{"k": {k}, "text": "é {j}"}}' for j in range(200)] + ["", " "])
    (folder / "notes.txt").write_text("no hour")
    (folder / "2024-01-01-77.json.gz").write_text("no hour either")
    return first


def test_archive_equals_plain_text(spark, tmp_path):
    archive(tmp_path)
    sub = tmp_path / "hour=2024-01-02-7"
    sub.mkdir()
    (sub / "part-0.gz").write_bytes(gzip.compress(b"one\ntwo"))
    (sub / "_SUCCESS").write_text("")
    got = Counter(r.line for r in hourly.hours(spark, str(tmp_path)).collect())
    files = [str(tmp_path / hourly_name) for hourly_name in os.listdir(tmp_path) if hourly_name.endswith(".json.gz") and "-77" not in hourly_name]
    want = Counter(r.value for r in spark.read.text(files).collect() if r.value.strip())
    assert got == want + Counter(["one", "two"]) and len(got) == 2002


def test_archive_opens_only_the_hours_of_a_filter(spark, tmp_path):
    first = archive(tmp_path)
    df = hourly.hours(spark, f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() == 10
    some = df.filter((F.col("hour") >= F.lit(first + timedelta(hours=3))) & (F.col("hour") < F.lit(first + timedelta(hours=5))))
    assert some.rdd.getNumPartitions() == 2 and some.count() == 400
    write_hour(tmp_path, first, ["x" * 10] * 1000, cut=True)  # not opened, so it can't fail
    assert some.filter("line LIKE '%\"k\": 3%'").count() == 200
    assert df.filter(F.col("hour") == F.lit(first + timedelta(hours=9))).rdd.getNumPartitions() == 1


def test_broken_hours_fail_or_are_counted(spark, tmp_path):
    first = archive(tmp_path, 3)
    rng = random.Random(1)
    write_hour(tmp_path, first + timedelta(hours=1), [f"{rng.random()}" for _ in range(5000)], cut=True)
    with pytest.raises(Exception, match="(?i)truncated|gzip|zlib|decompress|stream"):
        hourly.hours(spark, str(tmp_path)).count()
    rows = hourly.hours(spark, str(tmp_path), broken="skip")
    left = rows.groupBy("hour").agg(F.count("line").alias("lines"), F.count("broken").alias("broken")).orderBy("hour").collect()
    assert [r.broken for r in left] == [0, 1, 0] and left[0].lines == left[2].lines == 200 and left[1].lines < 5000
    assert hourly.hours(spark, str(tmp_path / "none")).count() == 0


def test_archive_as_a_stream(spark, tmp_path):
    source, out, log = tmp_path / "in", tmp_path / "out", tmp_path / "log"
    source.mkdir()
    first = archive(source, 4)

    def run():
        stream = hourly.new_hours(spark, str(source)).writeStream.format("parquet").option("checkpointLocation", str(log)).option("path", str(out)).start()
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()

    run()
    assert spark.read.parquet(str(out)).count() == 800
    write_hour(source, first + timedelta(hours=4), ["new"] * 7)
    run()
    got = spark.read.parquet(str(out))
    assert got.count() == 807 and got.select("hour").distinct().count() == 5


# ---------------------------------------------------------------- languages

def plain_profiles(rows):
    counts = {}
    for lang, text in rows:
        if lang and text is not None:
            counts.setdefault(lang, Counter()).update(language.cells(text).tolist())
    names = sorted(counts)
    n = np.array([[1 + counts[x][c] for x in names] for c in range(language.BUCKETS)], float)
    return tuple(names), np.log(n) - np.log(n.sum(0))


LABELLED = [("en", "the quick brown fox jumps over the lazy dog and the other one"), ("de", "der schnelle braune Fuchs springt über den faulen Hund und über Äpfel"),
            ("fr", "le renard brun saute par-dessus le chien paresseux, et l'été aussi"), (None, "no label"), ("", "empty label"), ("en", None), ("en", ""), ("en", "the the the")]


def test_profiles_and_verdicts(spark, monkeypatch):
    docs = spark.createDataFrame(LABELLED * 3, "lang string, text string").withColumn("cell", F.lit("clash"))
    p = language.learn(docs.repartition(5))
    names, logs = plain_profiles(LABELLED * 3)
    assert p.languages == names == ("de", "en", "fr") and np.allclose(p.logs, logs)
    long = "the lazy dog and the quick one " * 40 + "der faule Hund und der braune Fuchs " * 40
    texts = [None, "", "short", "123 456 " * 20, "the other dog jumps over the fox", "ein fauler Hund springt über den Fuchs", "😀".encode("utf-16", "surrogatepass").decode("utf-16") * 30, long]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, text string").select("k", language.detect(spark, p, F.col("text")).alias("d"), language.detect_mixed(spark, p, F.col("text"), window=64).alias("m"))
    got = {r.k: r for r in df.collect()}
    assert [got[k].d.lang for k in range(7)] == [None, None, None, None, "en", "de", None] and not got[0].d.reliable and got[4].d.reliable
    assert got[0].m == {} and abs(sum(got[7].m.values()) - 1) < 1e-9 and got[7].m["en"] > 0.4 and got[7].m["de"] > 0.4
    for t in texts:
        own = language.cells(t)
        if language.letters(t) >= 20:
            total = [sum(p.logs[c, k] for c in own) for k in range(3)]
            assert language.verdict(p, t, 0.02, 20)[0] == names[int(np.argmax(total))]
            won = Counter()
            for s in range(0, len(own), 64):
                part = own[s : s + 64]
                won[names[int(p.logs[part].sum(0).argmax())]] += len(part) / len(own)
            for size in (language.SLICE, 100):
                monkeypatch.setattr(language, "SLICE", size)
                assert language.shares(p, t, 64, 20) == pytest.approx(dict(won))
                assert language.verdict(p, t, 0.02, 20)[0] == names[int(np.argmax(total))]
    nothing = language.learn(docs.filter("false"))
    assert nothing.languages == () and language.verdict(nothing, long, 0.02, 20) == (None, False) and language.shares(nothing, long, 64, 20) == {}


@needs_data
def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in catalogue.QUERIES["x07_detected_languages"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(found) == len({d.doc_id for d in docs})
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0 and d.lang and language.letters(d.text) >= 20]
    right = sum(found[d.doc_id].lang == d.lang for d in held)
    assert len(held) > 100 and right >= 0.9 * len(held), (right, len(held))
    mixed = catalogue.QUERIES["x07_mixed_languages"](spark, sf).groupBy("doc_id").agg(F.sum("share").alias("s")).collect()
    assert len(mixed) == len(found) and all(r.s is None or abs(r.s - 1) < 1e-9 for r in mixed)


# ---------------------------------------------------------------- rules

def test_a_refresh_is_pulled_in_only_by_a_push_to_come(spark):
    at = lambda day, hour=0: datetime(2024, 3, day, hour)
    rows = [(1, at(10), None, at(17)), (2, at(10), at(1), at(17)), (3, at(10), at(9), at(17)), (4, at(10), at(9, 5), at(10, 5)),
            (5, at(10), at(12), at(13)), (6, at(10), at(16), at(17)), (7, at(10), at(25), at(17)), (8, None, at(12), None)]
    df = spark.createDataFrame([(k, f, p, 5000) for k, f, p, _ in rows], "k int, fetched timestamp, push timestamp, stars int")
    got = {r.k: r.due for r in df.select("k", scalars.next_refresh("repo", F.col("stars"), F.col("fetched"), F.col("push")).alias("due")).collect()}
    assert got == {k: due for k, _, _, due in rows}


def test_equal_points_keep_their_rows(spark):
    points = spark.createDataFrame([("a", 5)] * 3 + [("a", 90), ("b", 1)], "g string, at long")
    targets = spark.createDataFrame([("a", 7, 1), ("a", 3, 2)], "g string, t long, k int")
    got = sorted(tuple(r) for r in joins.nearest_within(points, targets, "g", "at", "t", 10, "t", "k").collect())
    assert got == [("a", 5, 2, 3, 2)] * 3
