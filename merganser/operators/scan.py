"""Scans and lookups: candidates, pickers, search, labels, attributes, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def published(entities: DataFrame, kind: str = "player") -> DataFrame:
    return entities.filter((F.col("kind") == kind) & (F.col("status") == "publish"))


def candidates(entities: DataFrame, limit: int | None = 2000) -> DataFrame:
    """Newest first; the limit is the number of entities that one review takes in, None for all."""
    rows = published(entities).orderBy(F.desc("created_at"), "entity_id")
    return rows if limit is None else rows.limit(limit)


def picker(entities: DataFrame, limit: int = 500) -> DataFrame:
    """The first titles, as choices."""
    rows = published(entities).orderBy("title", "entity_id").limit(limit)
    return rows.select("entity_id", label(F.col("title"), F.col("entity_id")).alias("label"))


def label(title, entity_id, group=None):
    plain = F.concat(title, F.lit(" (ID: "), entity_id.cast("string"), F.lit(")"))
    return plain if group is None else F.when(F.coalesce(group, F.lit("")) != "", F.concat(plain, F.lit(" - "), group)).otherwise(plain)


def search(entities: DataFrame, term: str, groups: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Titles that contain the term, whatever their case, by title; groups: entity_id, group."""
    rows = published(entities).filter(F.contains(F.lower("title"), F.lit(term.lower()))).orderBy("title", "entity_id").limit(limit)
    if groups is None:
        return rows.select("entity_id", label(F.col("title"), F.col("entity_id")).alias("label"))
    return rows.join(groups, "entity_id", "left").select("entity_id", label(F.col("title"), F.col("entity_id"), F.col("group")).alias("label"))


def attribute(attrs: DataFrame, key: str) -> DataFrame:
    """All values of a key of each entity, in order, and the first."""
    rows = attrs.filter(F.col("key") == key).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("attr_id", "value"))).alias("v"))
    return rows.select("entity_id", F.col("v.value").alias("all_values"), F.get("v.value", 0).alias("single"))


def taxonomies(terms: DataFrame) -> DataFrame:
    return terms.select("taxonomy").distinct()


def term_names(terms: DataFrame, taxonomy: str) -> DataFrame:
    """Names of an entity's terms, joined."""
    rows = terms.filter(F.col("taxonomy") == taxonomy).groupBy("entity_id").agg(F.array_sort(F.collect_set("name")).alias("n"))
    return rows.select("entity_id", F.array_join("n", ", ").alias("names"))


def with_prefix(attrs: DataFrame, prefix: str = "sp_", keep: bool = True) -> DataFrame:
    """Rows whose key begins with the prefix, wildcards being ordinary characters; or the other rows."""
    test = F.col("key").startswith(prefix)
    return attrs.filter(test if keep else ~F.coalesce(test, F.lit(False)))


def referencing(values: DataFrame, wanted: DataFrame, loose: bool = False) -> DataFrame:
    """Distinct entities whose ``value`` is a wanted ``id``; loose: or merely holds its digits, as in text of nested data."""
    ids = wanted.select(F.col("id").cast("string").alias("id")).distinct()
    if loose:  # each run of digits has few substrings, so this stays an equi join
        digits = values.select("entity_id", F.explode(F.regexp_extract_all("value", F.lit("([0-9]+)"), F.lit(1))).alias("d"))
        parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("d")), lambda i: F.transform(F.sequence(F.lit(1), F.length("d") - i + 1), lambda n: F.substr("d", i, n))))
        values = digits.select("entity_id", F.explode(F.array_distinct(parts)).alias("value"))
    return values.join(ids, values["value"] == ids["id"], "left_semi").select("entity_id").distinct()
