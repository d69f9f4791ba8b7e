"""Merging nested documents that hold lists: career data as JSON texts, duplicate by duplicate.

An array of the host is a map in order; it is a list while its keys are 0, 1, 2 and so on, and that is looked at anew at every
step. Two lists below the top are joined without repeats; other arrays are merged key by key; of anything else the primary's stays,
unless it is null. Repeats in a joined list are told by their text, to which all arrays look alike: of several only the first is left.
A field that is missing, empty or no array in the primary is taken whole.

A result depends on the order of the duplicates at every step, so documents of one primary and field are sorted by it and folded as they
stream by: a task holds the merged document and the next one, never a group. Fields that no merge touches don't leave the JVM.

Defined results: a text that is no JSON, and a null, is no array; where no document of a field is one, the primary's stays as it is, and
if it has none there is none. Null ids match nothing. An empty array is written as ``[]``. Rows that repeat an entity's field are merged
in the order of their texts. Other columns are not kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.operators.merge import NESTED_KEYS


def _array(text: str | None) -> dict | None:
    """The array that a text holds, lists as maps from their places; None if it holds none."""

    def keyed(x):
        if isinstance(x, list):
            x = dict(zip(map(str, range(len(x))), x, strict=True))
        return {k: keyed(v) for k, v in x.items()} if isinstance(x, dict) else x

    try:
        out = keyed(json.loads(text or "null"))
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def _is_list(x: dict) -> bool:
    return all(k == str(i) for i, k in enumerate(x))


def _written(x):
    if not isinstance(x, dict):
        return x
    return [_written(v) for v in x.values()] if _is_list(x) else {k: _written(v) for k, v in x.items()}


def _looks(x) -> str:
    return "Array" if isinstance(x, dict) else "" if x is None or x is False else "1" if x is True else str(x)


def united(first: dict, other: dict) -> dict:
    """first with what other adds to it."""
    for key, value in other.items():
        mine = first.get(key)
        if mine is None:
            first[key] = value
        elif isinstance(mine, dict) and isinstance(value, dict):
            if _is_list(mine) and _is_list(value):
                once: dict = {}
                for v in (*mine.values(), *value.values()):
                    once.setdefault(_looks(v), v)
                first[key] = dict(zip(map(str, range(len(once))), once.values(), strict=True))
            else:
                united(mine, value)
    return first


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entity_id, key, given, doc, sorted by the first two and the order of merging."""
    at, now, own, held = None, None, None, False

    def done() -> list[tuple]:
        if at is None or now is None and not held:
            return []
        return [(*at, json.dumps(_written(now), ensure_ascii=False, separators=(",", ":")) if now is not None else own)]

    for batch in batches:
        rows = []
        for entity, key, given, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (entity, key):
                rows += done()
                at, now, own, held = (entity, key), None, None, False
            new = _array(text)
            if not given:
                own, held = text if own is None else own, True
            if new is not None and (new or (now is None and not given)):
                now = united(now, new) if now else new
        if rows:
            yield _rows(rows)
    if rest := done():
        yield _rows(rest)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["entity_id", "key", "doc"])


def merge_documents(docs: DataFrame, redirect: DataFrame, keys: tuple[str, ...] = NESTED_KEYS) -> DataFrame:
    """docs: entity_id, key, doc. Fields of these keys are merged into the primary's; duplicates' documents go."""
    r = redirect.select("dup_id", "primary_id")
    slim = docs.select(F.col("entity_id").cast("long").alias("entity_id"), "key", "doc")
    mains = r.select(F.col("primary_id").alias("entity_id")).distinct()
    known = F.coalesce(F.col("key").isin(*keys), F.lit(False))
    left = slim.join(r.select(F.col("dup_id").alias("entity_id")), "entity_id", "left_anti").select(*slim.columns)
    own = left.filter(known).join(mains, "entity_id", "left_semi").select(*slim.columns).withColumn("dup", F.lit(None).cast("long"))
    given = slim.filter(known).join(r, slim["entity_id"] == r["dup_id"]).select(F.col("primary_id").alias("entity_id"), "key", "doc", F.col("dup_id").alias("dup"))
    ordered = own.unionByName(given).repartition("entity_id", "key").sortWithinPartitions("entity_id", "key", F.col("dup").asc_nulls_first(), "doc")
    merged = ordered.select("entity_id", "key", F.col("dup").isNotNull().alias("given"), "doc").mapInArrow(_folded, "entity_id long, key string, doc string")
    return merged.unionByName(left.filter(~known)).unionByName(left.filter(known).join(mains, "entity_id", "left_anti").select(*slim.columns))
