"""Exact duplicates by content sort.

Every text is normalised by deleting ``[\\x20\\x09-\\x0D]``. Sampled splitters range-partition the rows on
(leading normalised bytes, digest, longer original first, smaller id first); Spark's external sort puts equal
texts next to each other, and each row is compared in full with the one before it, so the digest never decides.
A group that is larger than a partition is simply cut by the splitters: the id is part of the key. The groups
at the ends of partitions, two a partition at most, are put together afterwards.

Defined results: a null text counts as empty; all empty texts are one group. Of equal texts the one with the
most code points stays, then the smallest id; a null id sorts after all others. Rows that repeat an id and a
text are separate rows of one group, of which one stays. An empty table gives an empty result. Other columns are
carried as they are if asked for, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.llm.common import Workspace, pieces

#: Deleted before texts are compared.
SPACE = b" \t\n\v\f\r"
#: Leading normalised bytes in the range key. Ties go on to the digest, so this bounds only the splitters.
HEAD = 48

_KEY = "__head binary, __sha string, __points int"
_OUT = "__keep_id long, __size long, __sha string, __part int, __edge boolean, __first boolean, __norm binary, __points int"


def normalise(text: str | None) -> bytes:
    return (text or "").encode().translate(None, SPACE)


def _keyed(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            norms = [normalise(t) for t in texts]
            added = [
                pa.array([n[:HEAD] for n in norms], pa.binary()),
                pa.array([hashlib.sha256(n).hexdigest() for n in norms], pa.string()),
                pa.array([len(t or "") for t in texts], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "__head", "__sha", "__points"])

    return run


def _grouped(text_col: str, id_col: str, carry: list[str]):
    """Goes through a sorted partition. Of the group at hand only ids (or kept rows) are in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = [id_col, *carry]
        types: list[pa.DataType] = []
        rows: list[tuple] = []  # of the group at hand: (id, index in group); the first has the payload
        head: tuple | None = None  # digest, normalised bytes, points, payload
        first = True

        def close(last: bool) -> list[tuple]:
            nonlocal first
            edge, size, keep = first or last, len(rows), rows[0]
            first = False
            out = []
            for i, row_id in enumerate(rows):
                lead = i == 0
                payload = head[3] if lead else (None,) * len(carry)
                out.append((row_id, *payload, keep, size, head[0], part, edge, lead, head[1] if lead and edge else None, head[2] if lead else None))
            return out

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [*types, pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.int32()]
            cols = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*names, "__keep_id", "__size", "__sha", "__part", "__edge", "__first", "__norm", "__points"])

        ready: list[tuple] = []
        for batch in pieces(batches, text_col):
            types = types or [batch.schema.field(n).type for n in names]
            at = {n: batch.column(batch.schema.get_field_index(n)) for n in {*names, text_col, "__sha", "__points"}}
            ids, texts, shas, points = (at[n].to_pylist() for n in (id_col, text_col, "__sha", "__points"))
            for i, row_id in enumerate(ids):
                if head is not None and head[0] == shas[i] and head[1] == normalise(texts[i]):
                    rows.append(row_id)
                    continue
                if head is not None:
                    ready += close(False)
                rows, head = [row_id], (shas[i], normalise(texts[i]), points[i], tuple(at[n][i].as_py() for n in carry))
            if len(ready) >= 500:
                yield batch_of(ready)
                ready = []
        if head is not None:
            ready += close(True)
            yield batch_of(ready)

    return run


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), work: Workspace | None = None) -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept, text_sha256, and for kept rows the columns of ``carry``.

    ``carry`` columns are null in rows that do not stay.
    """
    spark = df.sparkSession
    work = work or Workspace(spark, "exact-dedup")
    carry = [c for c in carry if c != id_col]
    cols = list(dict.fromkeys([id_col, text_col, *carry]))
    slim = df.select(*[F.col(f"`{c}`") for c in cols])
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    sql = lambda names: "".join(f"`{n}` {kinds[n]}, " for n in names)
    keyed = slim.mapInArrow(_keyed(text_col), sql(cols) + _KEY)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("__head"), F.col("__sha"), F.col("__points").desc(), F.col(f"`{id_col}`").asc_nulls_last()]
    sorted_ = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = work.write(sorted_.mapInArrow(_grouped(text_col, id_col, carry), sql([id_col, *carry]) + _OUT), "groups")
    # The groups at partitions' ends: at most two rows a partition, so their join partner has a proven bound.
    ends = (
        rows.filter("__edge and __first")
        .groupBy("__sha", "__norm")
        .agg(
            F.sum("__size").alias("size"),
            F.min(F.struct((-F.col("__points")).alias("p"), F.col("__keep_id").isNull().alias("z"), F.col("__keep_id").alias("i"), F.col("__part").alias("part"))).alias("best"),
            F.collect_list("__part").alias("parts"),
        )
        .select(F.col("__sha").alias("e_sha"), F.explode("parts").alias("e_part"), "size", F.col("best.i").alias("e_keep"), F.col("best.part").alias("e_best"))
    )
    joined = rows.join(F.broadcast(ends), (rows["__edge"]) & (rows["__part"] == ends["e_part"]) & (rows["__sha"] == ends["e_sha"]), "left")
    here = F.col("e_part").isNull()
    stays = F.col("__first") & (here | (F.col("e_best") == F.col("__part")))
    return joined.select(
        F.col(f"`{id_col}`"),
        F.when(here, F.col("__keep_id")).otherwise(F.col("e_keep")).alias("keep_id"),
        F.when(here, F.col("__size")).otherwise(F.col("size")).alias("group_size"),
        stays.alias("kept"),
        F.col("__sha").alias("text_sha256"),
        *[F.when(stays, F.col(f"`{c}`")).alias(c) for c in carry],
    )


