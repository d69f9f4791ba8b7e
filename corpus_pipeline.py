"""The corpus pipeline: each stage works on all that the one before it kept, and its decisions take effect.

Language identification rejects texts without letters and texts of which it is unsure; of equal texts, and of each group of
texts whose word shingles overlap, one stays; documents contaminated by the benchmark go; the rest is packed into
sequences. All stages but the last return the columns of ``documents``. What a stage does with nulls, empty texts, ties
and repeated rows is stated by the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merganser.llm.common import Workspace, bound_batches
from merganser.llm.decontaminate import decontaminate
from merganser.llm.exact_dedup import exact_dedup
from merganser.llm.language_id import UNDETERMINED, language_id, train
from merganser.llm.ngram_join import jaccard_components
from merganser.llm.packing import pack_best_fit
from merganser.llm.queries import vocabulary

#: Less than this share of a text in its likeliest language is a rejection.
LEAST_SCORE = 0.3


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = language_id(docs, train(docs))
    return labelled.filter((F.col("__lang") != UNDETERMINED) & (F.col("__lang_score") >= LEAST_SCORE)).select(*_columns(docs))


def drop_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs, carry=tuple(docs.columns)).filter("kept").select(*_columns(docs))


def drop_near_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component stays."""
    linked = jaccard_components(docs).filter("component_id <> doc_id").select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(linked, docs["doc_id"] == linked["__dropped"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences to train on: each piece with its token ids."""
    packed = pack_best_fit(docs, vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "ids")


def guarded(stage):
    """The stage over columns with plain names: whatever else the documents carry cannot clash with what it adds."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        names = docs.columns
        plain = [c if c in ("doc_id", "text", "lang") else f"column_{k}" for k, c in enumerate(names)]
        return stage(spark, docs.toDF(*plain), sf_dir).toDF(*names)

    return run


STAGES = [
    ("language_id", guarded(identify_language)),
    ("exact_dedup", guarded(drop_equal_texts)),
    ("ngram_jaccard_join", guarded(drop_near_texts)),
    ("decontamination", guarded(drop_contaminated)),
    ("best_fit_packing", pack),
]
#: SQL expresses neither the network nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        mark = len(Workspace.opened)
        docs = work.write(stage(spark, docs, sf_dir), name)
        for used in Workspace.opened[mark:]:  # the stage's output is written: its working tables are not read any more
            used.drop()
        del Workspace.opened[mark:]
        if before:
            work.drop(before)
        before = name
    return docs
