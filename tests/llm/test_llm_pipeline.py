"""The pipeline's stages over a small table with one planted case each, and with awkward rows."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from merganser.llm.queries import QUERIES

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    words = lambda k, n=60: " ".join(f"word{chr(97 + k)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(n))
    near = words(3) + " one more"
    rows = [(1, words(1)), (2, words(1).replace(" ", "\n")), (3, words(3)), (4, near), (5, "12345 !?"), (6, None), (7, words(7) + " " + words(20, 15)), (8, words(8)), (8, words(8)), (None, words(9)), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"kept": F.lit(1), "keep_id": F.lit(2), "__lang": F.lit(3), "__hit": F.lit(4), "node": F.lit(5), "ids": F.lit(6)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b", words(20, 15))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf, out, kept = f"file://{tmp_path}", spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, sf)
        out.write.parquet(f"{tmp_path}/out{k}")
        out = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append(sorted((r.doc_id if r.doc_id is not None else -1) for r in out.select("doc_id").collect()))
        if k < 4:
            assert out.columns == docs.columns
    assert kept == [[-1, 1, 2, 3, 4, 7, 8, 8], [-1, 1, 3, 4, 7, 8], [-1, 1, 3, 7, 8], [-1, 1, 3, 8], [-1, 1, 3, 8]]
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"} == set(out.columns)
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, whole.select("doc_id", "length", "ids_crc32").collect())) == sorted(map(str, out.select("doc_id", "length", "ids_crc32").collect()))


def test_the_pipeline_leaves_only_its_result(spark, tmp_path):
    spark.createDataFrame([(i, f"some words of text number {i} " * 9, "en", "s", 9) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b", "x y z")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = {os.path.join(f, name) for f in os.listdir(shared) for name in os.listdir(os.path.join(shared, f))}
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert {os.path.join(f, name) for f in os.listdir(shared) for name in os.listdir(os.path.join(shared, f))} - before == {next(os.path.join(f, "best_fit_packing") for f in os.listdir(shared) if f.startswith("pipeline") and os.path.join(f, "best_fit_packing") not in before)}
    assert out.count() > 0 and all(len(r.ids) == 4 * r.length for r in out.collect())


def test_stages_over_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, f"file://{tmp_path}").count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", ["op2_exact_dedup", "op6_ngram_jaccard_join", "op7_decontamination", "op11_chat_format", "op13_collocations"])
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from merganser.llm.queries import ORACLE

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = QUERIES[name](spark, sf)
    want = con.sql(ORACLE[name])
    columns = sorted(rows.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, [tuple(r) for r in rows.select(*columns).collect()])) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())
