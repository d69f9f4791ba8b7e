"""Search over an index of trigrams against a scan, and what it reads; composed letters."""

import random
import unicodedata

from pyspark.sql import functions as F

from merganser.functions import names
from merganser.operators import match, titles


def test_search_equals_a_scan_and_reads_one_list(spark, tmp_path):
    rng = random.Random(7)
    words = ["Smith", "smithy", "José", "Ann", "Чайкин", "x", "Q😀Q", "aaaa", "Jones"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))), "player", "publish") for i in range(300)]
    rows += [(500, None, "player", "publish"), (501, "Smith", "team", "publish"), (502, "Smith", "player", "draft"), (503, "", "player", "publish"), (7, "Smith Smith", "player", "publish")]
    entities = spark.createDataFrame(rows, "entity_id long, title string, kind string, status string")
    folder = f"file://{tmp_path}/index"
    titles.build(entities, folder, 16)
    terms = ["smi", "SMITH", "ann jones", "айк", "q😀q", "aaa", "nobody", "😀q ", "%mi", "josé"]
    want = {t: sorted((r[1], r[0]) for r in rows if r[1] and r[2:] == ("player", "publish") and t.lower() in r[1].lower()) for t in terms}
    for t in terms:
        assert sorted((r.title, r.entity_id) for r in titles.holding(spark, folder, t).collect()) == want[t], t
    asked = spark.createDataFrame([(t,) for t in [*terms, "smi", "sm", "", None]], "term string")
    got = {}
    for r in titles.find_each(spark, folder, asked, 5).orderBy("term", "rank").collect():
        got.setdefault(r.term, []).append((r.title, r.entity_id))
    assert got == {t: w[:5] for t, w in want.items() if w}
    assert any(want.values()) and want["aaa"]
    # only files of one bucket are read
    read = titles.holding(spark, folder, "Smith").select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.split("bucket=")[1].split("/")[0] for r in read}) == 1
    plan = titles.holding(spark, folder, "Smith")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram," in plan


def test_an_index_of_no_titles(spark, tmp_path):
    empty = spark.createDataFrame([], "entity_id long, title string, kind string, status string")
    folder = f"file://{tmp_path}/index"
    titles.build(empty, folder, 4)
    assert titles.holding(spark, folder, "smith").count() == 0
    assert titles.find_each(spark, folder, spark.createDataFrame([("smith",)], "term string")).count() == 0


def test_composition_of_all_pairs(spark):
    whole = [chr(c) for c in range(0xA0, 0x30000) if unicodedata.normalize("NFD", chr(c)) != chr(c)]
    texts = [None, "", "plain", "é", "ṩ"] + [form for c in whole for form in (c, unicodedata.normalize("NFD", c), f"a{unicodedata.normalize('NFD', c)}́b")]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", names.composed(F.col("t")).alias("c")).collect()
    assert len(whole) > 10_000
    # what is below U+0300 throughout is composed as it is
    assert [r.c for r in sorted(rows, key=lambda r: r.i)] == [t if t is None else unicodedata.normalize("NFC", t) for t in texts]


def test_letters_match_however_they_are_written(spark):
    entities = spark.createDataFrame([(0, 0, "Андрей Чайкин"), (1, 1, unicodedata.normalize("NFD", "Андрей Чайкин"))], "entity_id long, ord long, title string")
    assert [(r.certainty, r.scenario) for r in match.find_pairs(entities).collect()] == [(100, "exact")]
