"""Substring search over an index of titles: posting lists of three letters as a partitioned table.

A title that holds the term holds each of its trigrams. ``build`` writes a row for each distinct trigram of each title, which
carries the title, and how many titles have it. A search looks up the counts of the term's trigrams, reads the posting list of
the rarest one only, and tests its titles; so what is read grows with that list, not with the table. Lists are sorted ranges of
(trigram, id) in files by bucket of trigram: one that holds a third of all titles is spread over files like any other.

Defined results: those of a scan for titles that contain the term, whatever their case. Terms of less than three letters have
no trigram and need a scan (``scan.search``), which ``find`` refuses; null titles and null terms match nothing; a term of
which no title has some trigram finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merganser.operators import scan

GRAM = 3


def grams(c: Column) -> Column:
    """The distinct trigrams of a text."""
    several = F.transform(F.sequence(F.lit(1), F.char_length(c) - GRAM + 1), lambda i: F.substr(c, i, F.lit(GRAM)))
    return F.when(F.char_length(c) >= GRAM, F.array_distinct(several)).otherwise(F.array().cast("array<string>"))


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _lists(entities: DataFrame) -> str:
    """The columns of the lists, which an index of no titles has no file to tell."""
    return f"entity_id {entities.schema['entity_id'].dataType.simpleString()}, title string, gram string, bucket int"


def build(entities: DataFrame, path: str, buckets: int = 256) -> None:
    """entities: entity_id, title, kind, status. Writes the index of all that are published below ``path``."""
    rows = scan.published(entities).select("entity_id", "title", F.explode(grams(F.lower("title"))).alias("gram"))
    rows = rows.withColumn("bucket", bucket(F.col("gram"), buckets))
    rows.repartitionByRange("bucket", "gram", "entity_id").sortWithinPartitions("bucket", "gram", "entity_id").write.partitionBy("bucket").parquet(f"{path}/lists")
    counts = entities.sparkSession.read.schema(_lists(entities)).parquet(f"{path}/lists").groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram").write.parquet(f"{path}/counts")
    entities.sparkSession.createDataFrame([(buckets, _lists(entities))], "buckets int, lists string").coalesce(1).write.parquet(f"{path}/layout")


def _layout(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    layout = spark.read.parquet(f"{path}/layout").first()
    return spark.read.schema(layout.lists).parquet(f"{path}/lists"), spark.read.parquet(f"{path}/counts"), layout.buckets


def holding(spark: SparkSession, path: str, term: str) -> DataFrame:
    """(entity_id, title) of all titles that hold the term: one posting list is read."""
    lists, counts, buckets = _layout(spark, path)
    low = spark.range(1).select(F.explode(grams(F.lower(F.lit(term)))).alias("gram")).withColumn("bucket", bucket(F.col("gram"), buckets)).collect()  # as many rows as the term has letters
    if not low:
        raise ValueError(f"a term needs {GRAM} letters")
    known = counts.filter(F.col("bucket").isin([r.bucket for r in low]) & F.col("gram").isin([r.gram for r in low])).collect()
    if len(known) < len(low):
        return lists.select("entity_id", "title").limit(0)
    rarest = min(known, key=lambda r: (r.n, r.gram))
    rows = lists.filter((F.col("bucket") == rarest.bucket) & (F.col("gram") == rarest.gram))
    return rows.filter(F.contains(F.lower("title"), F.lower(F.lit(term)))).select("entity_id", "title")


def find(spark: SparkSession, path: str, term: str, groups: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(entity_id, label) as ``scan.search`` gives them."""
    rows = holding(spark, path, term).orderBy("title", "entity_id").limit(limit)
    if groups is None:
        return rows.select("entity_id", scan.label(F.col("title"), F.col("entity_id")).alias("label"))
    return rows.join(groups, "entity_id", "left").select("entity_id", scan.label(F.col("title"), F.col("entity_id"), F.col("group")).alias("label"))


def find_each(spark: SparkSession, path: str, terms: DataFrame, limit: int = 20) -> DataFrame:
    """(term, entity_id, title, rank) of the first titles of each distinct ``term`` of three letters and more.

    Each term joins the list of its rarest trigram; the ranking keeps a term's first rows in each partition before it shuffles.
    """
    lists, counts, buckets = _layout(spark, path)
    wanted = terms.select("term").distinct().withColumn("low", F.lower("term")).withColumn("grams", grams(F.col("low"))).filter(F.size("grams") > 0)
    each = wanted.select("term", "low", F.size("grams").alias("many"), F.explode("grams").alias("gram")).withColumn("bucket", bucket(F.col("gram"), buckets))
    known = each.join(counts, ["bucket", "gram"]).groupBy("term", "low", "many").agg(F.count("*").alias("found"), F.min(F.struct("n", "bucket", "gram")).alias("r"))
    rarest = known.filter("found = many").select("term", "low", "r.bucket", "r.gram")
    rows = lists.join(rarest, ["bucket", "gram"]).filter(F.contains(F.lower("title"), F.col("low")))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy("title", "entity_id")))
    return ranked.filter(F.col("rank") <= limit).select("term", "entity_id", "title", "rank")
