"""Licences of pages: texts, paths and inheritance by folders of URLs, against SQL and by hand."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from merganser.llm import licenses
from merganser.llm.pages import page_path, page_text
from merganser.llm.queries import ORACLE, QUERIES

PAGES = "page_id long, url string, html string"
duckdb = pytest.importorskip("duckdb")


def page(article):
    return f'<!DOCTYPE html><html><head><title>words of a title</title><script>var t="Released under the ISC License.";</script></head><body><nav><a href="/">home</a></nav><article class="x">{article}</article><footer>Released under the BSD 2-Clause License.</footer></body></html>'


def test_pages_inherit_by_the_folders_of_their_urls(spark, tmp_path):
    plain, mit = page("<p>nothing of the kind " + "is said here " * 30), page("<h1>Notes</h1><p>Released under the <b>MIT</b> License.</p>")
    header = "# This program is free software: you can redistribute it and/or modify it<br># under the terms of the GNU General Public License as published by<br># the Free Software Foundation, either version 3 of the License, or<br># (at your option) any later version."
    rows = [
        (1, "http://Site.example/docs/about.html?x=1/2#top", mit, "MIT", "own", None),
        (2, "https://site.example/docs/a", plain, "MIT", "inherited", "site.example/docs"),
        (3, "https://site.example/docs/a/b/c/", plain, "CC-BY-4.0", "inherited", "site.example/docs/a/b"),
        (16, "https://site.example/docs/e/f/", plain, "MIT", "inherited", "site.example/docs"),
        (4, "https://site.example/docs", plain, None, "none", None),
        (5, "https://site.example/Docs/a", plain, None, "none", None),
        (6, "https://site.example/docs/a/b/LICENSE.html", page("words<p>" * 60 + "Licensed under CC BY 4.0."), "CC-BY-4.0", "own", None),
        (7, "https://site.example/docs/a/b/d?q", plain, "CC-BY-4.0", "inherited", "site.example/docs/a/b"),
        (8, "https://site.example/long/x", page("words<p>" * 60 + "Licensed under CC BY 4.0."), "CC-BY-4.0", "own", None),
        (9, "https://site.example/long/y", plain, None, "none", None),
        (10, "https://gpl.example", page(header), "GPL-3.0", "own", None),
        (11, "https://gpl.example/a/b", page("<!-- Released under the MIT License. --><p>nothing here"), "GPL-3.0", "inherited", "gpl.example"),
        (12, None, plain, None, "none", None),
        (13, "https://gpl.example/a/c", None, "GPL-3.0", "inherited", "gpl.example"),
        (14, None, mit, "MIT", "own", None),
        (15, "", "Released under the ISC License.", "ISC", "own", None),
        (None, "https://gpl.example/d", "", "GPL-3.0", "inherited", "gpl.example"),
        (2, "https://site.example/docs/a", plain, "MIT", "inherited", "site.example/docs"),
    ]
    spark.createDataFrame([r[:3] for r in rows], PAGES).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter((r.page_id, r.license, r.origin, r.inherited_from) for r in QUERIES["page_license_scan"](spark, str(tmp_path)).collect())
    assert got == Counter((r[0], *r[3:]) for r in rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert Counter(con.execute(f"SELECT page_id, license, origin, inherited_from FROM ({ORACLE['page_license_scan']})").fetchall()) == got


def test_windows_of_pages_against_sql(spark, tmp_path):
    texts = [t.replace(" ", " \n* " if k % 3 else "<br>") for k, (_, t) in enumerate(licenses.BLOCKS)] + ["code <p>" + t.replace(", ", ",<br>") + " and more words follow " * (k % 4) for k, (_, t) in enumerate(licenses.TEMPLATES + licenses.BLOCKS)]
    rows = [(k, f"https://h{k % 5}.example/{k % 3}/{k}", page(t)) for k, t in enumerate(texts)] + [(1000 + k, f"https://h{k % 5}.example/{k % 3}/x/{k}", page("mit " * k)) for k in range(30)]
    spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in QUERIES["page_license_scan"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert Counter(got) == Counter(con.execute(ORACLE["page_license_scan"]).fetchall())
    assert Counter(r[3] for r in got)["own"] >= len(texts) // 2 and Counter(r[3] for r in got)["inherited"] > 0


def test_files_of_one_folder_are_dealt(spark):
    """With nothing broadcast, neither the files of a folder nor the folders below another are one task."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "50"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(4000).selectExpr("id AS doc_id", "concat('top/', if(id % 2 = 0, 'hot', concat(id, '/x')), '/', id) AS path", "if(id = 0, 'Released under the MIT License.', 'x') AS text")
        rows = rows.unionByName(spark.createDataFrame([(5000, "top/LICENSE", "Released under the ISC License.")], "doc_id long, path string, text string"))
        out = licenses.license_scan(rows, path=F.col("path"))
        assert Counter(map(tuple, out.groupBy("license", "origin", "inherited_from").count().collect())) == Counter([("MIT", "own", None, 1), ("ISC", "own", None, 1), ("MIT", "inherited", "top/hot", 1999), ("ISC", "inherited", "top", 2000)])
        assert max(len(p) for p in out.rdd.glom().collect()) < 800
        folders = spark.range(4000).selectExpr("'top' AS above", "concat('top/', id) AS dir")
        joined = licenses.looked_up(folders, spark.createDataFrame([("top", "MIT")], "above string, of string"), "above", "dir")
        assert joined.filter("of = 'MIT'").count() == 4000 and max(len(p) for p in joined.rdd.glom().collect()) < 800
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_broken_pages_are_read_once(spark):
    broken = ["<!--", "<script ", "<style>", "<article>", "</article>", "<", "<a ", "&a", "&#", "</script", "<article", "x"]
    rows = [(k, "http://h/" + b * 1000, b * 200_000) for k, b in enumerate(broken)]
    began = time.time()
    out = spark.createDataFrame(rows, PAGES).select(page_path(F.col("url")).alias("p"), page_text(F.col("html")).alias("t")).agg(F.count("p"), F.count("t")).collect()[0]
    assert tuple(out) == (len(rows), len(rows)) and time.time() - began < 60


def test_texts_of_pages(spark):
    cases = {
        "a<b>b</b>c<br>d<p>e": "abc\nd\ne",
        "x<article>one</article>y<article id=1>two</article>z": "\none\ny\ntwo",
        "<body>no <i>article</i>\nhere": "\nno article here",
        "<!-- never ends": "",
        "a&amp;b&#39;c &d": "a b c &d",
        "<STYLE>p{}</STYLE>T": "\nt",
        "<block>x</block>": "\nx\n",
        "1 < 2": "1 < 2",
    }
    got = spark.createDataFrame([(0, "", h) for h in cases], PAGES).select("html", page_text(F.col("html")).alias("t")).collect()
    assert {r.html: r.t for r in got} == cases
