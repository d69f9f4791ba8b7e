"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Entries become whole numbers, x = floor(256 * c), so that sums are exact. Each partition of the distinct vectors keeps its
number, its sums, and all singular values and right vectors of its centred rows. Two of them merge by stacking values times
vectors, one row that corrects for the two means, and a new decomposition: nothing is cut off, so the last one has the
spectrum of all rows. Merges go up a tree of groupings, eight at a time; a summary is a matrix of dimensions squared,
whatever the number of rows, and only the last one reaches the driver.

Defined results: rows whose vector is null, or holds a null, a non-finite entry or one of 2^40 and more, are left out.
Vectors of other dimensions are whitened apart from each other, each dimension over its own fit list; vectors of no entries give no
rows. Where the rank is lower than a component's number, ``whitened`` is null and ``explained`` 0 (null if nothing
varies). A ``deviation`` over 64 bits is null. Null and repeated ids are kept row by row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.llm.common import Workspace

#: Entries are counted in parts of 1 / SCALE; larger entries than LARGEST are left out.
SCALE, LARGEST = 256, float(2**40)
#: So many summaries become one.
FANOUT = 8
SUMMARY = "d int, part long, n long, sums array<decimal(38,0)>, s array<double>, vt binary"


@dataclass
class Summary:
    """n rows with exact sums; values s and right vectors vt of the centred rows."""

    n: int
    sums: list[int]
    s: np.ndarray
    vt: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        n, d = x.shape
        sums = [int(v) for v in x.sum(0)] if n * LARGEST * SCALE < 2**62 else [sum(map(int, x[:, j])) for j in range(d)]
        return Summary(n, sums, *_svd(x - np.array([v / n for v in sums])))

    def merge(self, other: Summary) -> Summary:
        n, a, b = self.n + other.n, self.n, other.n
        means = np.array([(p * b - q * a) / (a * b) for p, q in zip(self.sums, other.sums, strict=True)])
        rows = np.concatenate([self.s[:, None] * self.vt, other.s[:, None] * other.vt, math.sqrt(a / n * b) * means[None]])
        return Summary(n, [p + q for p, q in zip(self.sums, other.sums, strict=True)], *_svd(rows))


def _svd(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s, vt


def _matrices(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each dimension in a batch."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        if d:
            yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def _row(part: int, found: dict[int, Summary]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(
        [{"d": d, "part": part, "n": m.n, "sums": m.sums, "s": m.s.tolist(), "vt": m.vt.tobytes()} for d, m in found.items()],
        pa.schema([("d", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("s", pa.list_(pa.float64())), ("vt", pa.binary())]),
    )


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    found: dict[int, Summary] = {}
    waiting: dict[int, list[np.ndarray]] = {}

    def settle(d: int) -> None:
        now = Summary.of(np.concatenate(waiting.pop(d)))
        found[d] = found[d].merge(now) if d in found else now

    for batch in batches:
        for _, x in _matrices(batch, "x"):
            d = x.shape[1]
            waiting.setdefault(d, []).append(x)
            if sum(map(len, waiting[d])) >= max(4096, 8 * d):
                settle(d)
    for d in list(waiting):
        settle(d)
    if found:
        yield _row(TaskContext.get().partitionId(), found)


def _merged(fanout: int):
    def run(table: pa.Table) -> pa.Table:
        out = None
        for r in table.sort_by("part").to_pylist():
            now = Summary(r["n"], [int(v) for v in r["sums"]], np.array(r["s"]), np.frombuffer(r["vt"]).reshape(len(r["s"]), r["d"]))
            out = out.merge(now) if out else now
        return pa.Table.from_batches([_row(r["part"] // fanout, {r["d"]: out})])

    return run


@dataclass
class Model:
    """Of one dimension: n, sums, components (k x d) and their eigenvalues, and the share of each in the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    @staticmethod
    def of(m: Summary, d: int, k: int) -> Model:
        squares, k = m.s**2, min(k, d)
        total, rank = float(squares.sum()), int((m.s > m.s[0] * max(m.n, d) * np.finfo(float).eps).sum()) if len(m.s) else 0
        values, components = np.zeros(k), np.zeros((k, d))
        for j in range(min(k, rank)):
            v = m.vt[j]
            values[j], components[j] = squares[j] / m.n, v * np.sign(v[np.argmax(np.abs(v))])
        return Model(m.n, m.sums, components, values, [float(v) * m.n / total if total else None for v in values])

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: int64 where it and its squares fit, else Python's integers."""
        most = (self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))) ** 2 * x.shape[1]
        kind = np.int64 if most < 2**63 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        kept = self.values > 0
        return (deviations.astype(float) / self.n) @ self.components[kept].T / np.sqrt(self.values[kept])


def _products(models: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch, "x"):
                m = models[x.shape[1]]
                w = m.whiten(m.deviations(x))
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + w.T @ w
        rows = [(d, i, j, float(v)) for d, m in sums.items() for i, line in enumerate(m) for j, v in enumerate(line)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["d", "i", "j", "v"])

    return run


def fit(vectors: DataFrame, k: int, work: Workspace, fanout: int = FANOUT) -> dict[int, Model]:
    """vectors: x. The models over the distinct vectors, one for each dimension; they measure their own error."""
    distinct = work.write(vectors.filter(F.size("x") > 0).distinct(), "fit")
    level, now = 0, work.write(distinct.mapInArrow(_summaries, SUMMARY), "merged-0")
    while now.agg(F.max("part")).first()[0]:
        level += 1
        now = work.write(now.groupBy("d", F.expr(f"part div {fanout}").alias("above")).applyInArrow(_merged(fanout), SUMMARY), f"merged-{level}")
    models = {}
    for r in now.collect():  # one row a dimension
        models[r.d] = Model.of(Summary(r.n, [int(v) for v in r.sums], np.array(r.s), np.frombuffer(r.vt).reshape(len(r.s), r.d)), r.d, k)
    for r in distinct.mapInArrow(_products(models), "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect():
        m = models[r.d]
        m.identity_error = max(m.identity_error or 0.0, abs(r.v / m.n - (r.i == r.j)))
    return models


def _whitened(models: dict[int, Model], id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col))
            for at, x in _matrices(batch, "x"):
                m, d = models[x.shape[1]], x.shape[1]
                apart = m.deviations(x)
                squares, w, k = (apart**2).sum(1).tolist(), m.whiten(apart), len(m.values)
                ranks = np.cumsum(m.values > 0) - 1
                for c in range(k):
                    size = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(at)),
                            pa.array([c + 1] * size, pa.int32()),
                            pa.array([m.n] * size, pa.int64()),
                            pa.array([v if v < 2**63 else None for v in squares], pa.int64()),
                            pa.array(w[:, ranks[c]] if m.values[c] > 0 else [None] * size, pa.float64()),
                            pa.array([m.explained[c]] * size, pa.float64()),
                            pa.array([m.identity_error] * size, pa.float64()),
                            pa.array([d] * size, pa.int32()),
                        ],
                        [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "dimensions"],
                    )

    return run


def whiten(df: DataFrame, k: int = 4, id_col: str = "vec_id", vec_col: str = "embedding", work: Workspace | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per remaining row and component: id_col, component, n, deviation, whitened, explained, identity_error, dimensions."""
    work = work or Workspace(df.sparkSession, "whitening")
    sound = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST)
    vector = F.transform(F.col(f"`{vec_col}`"), lambda e: e.cast("double"))
    slim = df.select(F.col(f"`{id_col}`"), vector.alias("v")).filter(F.col("v").isNotNull() & F.forall("v", lambda e: F.coalesce(sound(e), F.lit(False))))
    rows = slim.select(F.col(f"`{id_col}`"), F.transform("v", lambda e: F.floor(e * SCALE)).alias("x"))
    models = fit(rows.select("x"), k, work, fanout)
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_whitened(models, id_col), f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, dimensions int")
