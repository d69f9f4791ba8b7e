"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

Words are runs of letters and digits (or bytes from 0x80), and runs of other visible characters are words too; unigrams
and bigrams are hashed to ``2**bits`` weights; a word followed by itself is one bigram, whatever the word. A document's score is the logistic of a sparse dot product: the mean of
its n-grams' weights times ``gain``, so long texts need no cut. The model is fitted on the driver on at most
``sample`` labelled rows, the ones with the smallest hashes of their ids, and has a fixed size; scoring reads each row
once, without a shuffle.

Defined results: null and empty texts have no n-grams and get the logistic of the bias, a score like any other.
Labels that are null are not learnt from; without both labels in the sample the model is the bias alone. Repeated rows
score alike. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.llm.common import Workspace, crc32_text, pieces
from merganser.llm.hashing import U, classes, mix, tokens

TABLE = classes(b" \t\n\v\f\r", bytes(c for c in range(33, 127) if not chr(c).isalnum()))


#: All bigrams of a word and itself share this hash, so that repetition is learnt from any word.
REPEAT = U(0x5851F42D4C957F2D)


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight indices of all n-grams, unigrams first in each text; and the text that each belongs to."""
    hashes, bounds = tokens(texts, TABLE)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    same = owner[1:] == owner[:-1]
    pairs = mix(hashes[:-1] * U(3) + hashes[1:] * U(0xD6E8FEB86659FD93))
    pairs = np.where(hashes[1:] == hashes[:-1], REPEAT, pairs)[same]
    shift = U(64 - bits)
    return np.concatenate([hashes >> shift, pairs >> shift]).astype(np.int64), np.concatenate([owner, owner[1:][same]])


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2 terms; the last weight is the bias."""

    def __init__(self, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.05, gain: float = 20.0):
        self.bits, self.alpha, self.beta, self.l1, self.l2, self.gain = bits, alpha, beta, l1, l2, gain
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 4) -> np.ndarray:
        rows = []
        for text in texts:
            at, _ = features([text], self.bits)
            at, count = np.unique(at, return_counts=True)
            rows.append((np.append(at, 1 << self.bits), np.append(count * (self.gain / max(1, count.sum())), 1.0)))
        order = np.random.default_rng(7)
        if len(set(labels)) > 1:
            for _ in range(epochs):
                for i in order.permutation(len(rows)):
                    self.update(*rows[i], labels[i])
        return self.weights().astype(np.float32)


def score(texts: list[bytes], weights: np.ndarray, bits: int, gain: float) -> np.ndarray:
    at, owner = features(texts, bits)
    total = np.bincount(owner, weights[at], len(texts))
    count = np.bincount(owner, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(gain * total / np.maximum(count, 1) + weights[-1], -30, 30)))


#: The most bytes of text that a model is fitted on.
SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, out: int, sample: int, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """At most ``sample`` rows (text, label) and ``sample_bytes`` of text outside the fold ``out``.

    One row for each id, those with the smallest hashes of their ids first; a text that does not fit any more is passed over.
    Of labels, or texts, that repeat an id the least is taken.
    """
    pick = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
        .filter(f"id is not null and label is not null and {crc32_text('id')} % {folds} != {out}")
        .groupBy("id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    # at most `sample` rows of two numbers: a proven bound
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(F.broadcast(pick), "id")
    return bounded(rows.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")), sample_bytes)


def bounded(rows: DataFrame, most: int) -> list[tuple[bytes, object]]:
    """(text, label) of rows (id, text, label), by the hash of the id, as far as ``most`` bytes of text go.

    rows are those of a sample: they are written once, then looked at for their sizes.
    """
    work = Workspace(rows.sparkSession, "sample")
    rows = work.write(rows.withColumn("h", F.xxhash64("id")), "rows")
    room, some = most, []
    for r in sorted(rows.select("id", "h", F.octet_length("text").alias("n")).collect(), key=lambda r: (r.h, r.id)):
        if r.n <= room:
            room -= r.n
            some.append((r.id,))
    out = []
    if some:
        ids = rows.sparkSession.createDataFrame(some, rows.select("id").schema)
        out = rows.join(F.broadcast(ids), "id").select("id", "h", "text", "label").collect()
    work.drop()
    return [(r.text.encode(), r.label) for r in sorted(out, key=lambda r: (r.h, r.id))]


def score_with(df: DataFrame, scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score double: scorer(list of UTF-8 texts) gives an array; it goes to the workers once, by broadcast."""
    slim = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    model = df.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            texts = [(t or "").encode() for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)), pa.array(model.value(texts), pa.float64())], [id_col, "score"])

    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, score double")


class QualityModel:
    def __init__(self, sample: list[tuple[bytes, int]], bits: int = 18):
        ftrl = Ftrl(bits)
        self.weights = ftrl.fit([t for t, _ in sample], [y for _, y in sample])
        self.bits, self.gain = bits, ftrl.gain

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        return score(texts, self.weights, self.bits, self.gain)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3, sample: int = 6000, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted for every row of docs."""
    model = QualityModel(labelled_sample(docs, labels, "quality", folds, held_out, sample, id_col, text_col, sample_bytes))
    scored = score_with(docs, model, id_col, text_col)
    return scored.select(
        F.col(f"`{id_col}`"),
        F.coalesce(F.expr(crc32_text(f"`{id_col}`")) % folds == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
