"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time, on the driver, on windows of at most ``sample``
documents (those with the smallest hashes of their ids). Whole texts are cut into windows; two gated recurrent layers
read each window forwards and backwards, every position gets a probability for each language, and a document's
probabilities are the means over its positions. The model has a fixed size; scoring reads each row once, without a shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text if there was
nothing to learn from. Repeated rows are labelled alike. Very long texts are labelled whole. Other columns are carried and
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.llm.common import crc32_text, pieces
from merganser.llm.quality import SAMPLE_BYTES, bounded

WINDOW, HIDDEN, UNDETERMINED = 64, 8, "und"
#: Windows that are read at once.
WIDTH = 4096
_LATIN = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LATIN.search(text)) or any(map(str.isalpha, text)))


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts, one below the other, the last of each filled up with spaces; and the bytes in each."""
    counts = [-(-len(t) // WINDOW) for t in texts]
    filled = b"".join([t.ljust(n * WINDOW) for t, n in zip(texts, counts, strict=True)])
    used = np.full(sum(counts), WINDOW)
    for at, t in zip(np.cumsum(counts) - 1, texts, strict=True):
        if t:
            used[at] = (len(t) - 1) % WINDOW + 1
    return np.frombuffer(filled, np.uint8).reshape(-1, WINDOW), used


class Layer:
    """One direction. Columns are windows; rows are the update gate, the reset gate and the candidate, HIDDEN each."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        self.p = {"x": rng.normal(0, 0.4, (3 * h, 256)), "u": rng.normal(0, 0.7 / h**0.5, (3 * h, h)), "b": np.zeros((h, 1))}

    def forward(self, data: np.ndarray, keep: bool = False) -> list:
        """States after each position, or what backward() needs."""
        h, x, u, b = HIDDEN, self.p["x"], self.p["u"], self.p["b"]
        state, out = np.zeros((h, data.shape[1]), x.dtype), []
        for row in data:
            a = x[:, row]
            s = u @ state
            g = a[: 2 * h] + s[: 2 * h]
            g *= 0.5
            np.tanh(g, out=g)  # the logistic function
            g *= 0.5
            g += 0.5
            z, r = g[:h], g[h:]
            c = s[2 * h :] + b
            n = np.tanh(a[2 * h :] + r * c)
            new = n + z * (state - n)
            out.append((state, z, r, c, n, new) if keep else new)
            state = new
        return out

    def backward(self, data: np.ndarray, steps: list, into: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients, from those of each position's state."""
        h, u = HIDDEN, self.p["u"]
        grad = {"x": np.zeros_like(self.p["x"]), "u": np.zeros_like(u), "b": np.zeros_like(self.p["b"])}
        after, pre = np.zeros_like(into[0]), np.empty((len(steps), 3 * h, into[0].shape[1]))
        for t in range(len(steps) - 1, -1, -1):
            state, z, r, c, n, _ = steps[t]
            d = into[t] + after
            dn = d * (1 - z) * (1 - n * n)
            dc = dn * r
            gates = np.concatenate([d * (state - n) * z * (1 - z), dn * c * r * (1 - r), dc])
            after = d * z + u.T @ gates
            grad["u"] += gates @ state.T
            grad["b"] += dc.sum(1, keepdims=True)
            pre[t] = gates
            pre[t, 2 * h :] = dn
        flat = data.ravel()
        for k in range(3 * h):
            grad["x"][k] = np.bincount(flat, pre[:, k].ravel(), 256)
        return grad


class LanguageModel:
    def __init__(self, sample: list[tuple[bytes, str]], per_language: int = 1500, per_document: int = 16, epochs: int = 8, batch: int = 256, rate: float = 0.02, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = sorted({lang for _, lang in sample})
        self.layers = [Layer(rng), Layer(rng)]
        n = len(self.languages)
        self.out = {"w": rng.normal(0, 0.3, (n, 2 * HIDDEN)), "b": np.zeros((n, 1))}
        windows, labels = [], []
        for k, lang in enumerate(self.languages):
            own, used = cut([t for t, x in sample if x == lang])
            doc = np.repeat(np.arange(sum(x == lang for _, x in sample)), [-(-len(t) // WINDOW) for t, x in sample if x == lang])
            order = rng.permutation(len(own))
            order = order[np.argsort(doc[order], kind="stable")]
            rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
            own, used = own[order[rank < per_document]], used[order[rank < per_document]]
            if (used >= WINDOW // 2).sum() >= per_language // 10:
                own = own[used >= WINDOW // 2]  # enough text to leave the shorter ends out
            if len(own):  # as many of each language: rare ones repeat theirs
                own = own[rng.permutation(len(own))[:per_language] if len(own) >= per_language else rng.integers(0, len(own), per_language)]
            windows.append(own)
            labels.append(np.full(len(own), k))
        if n:
            self._train(np.concatenate(windows), np.concatenate(labels), epochs, batch, rate, rng)
        for p in (*(layer.p for layer in self.layers), self.out):
            for k in p:
                p[k] = p[k].astype(np.float32)

    def _train(self, windows: np.ndarray, labels: np.ndarray, epochs: int, batch: int, rate: float, rng: np.random.Generator) -> None:
        params = [self.layers[0].p, self.layers[1].p, self.out]
        first, second = ([{k: np.zeros_like(v) for k, v in p.items()} for p in params] for _ in range(2))
        step, total = 0, epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                grads = self._gradients(windows[pick].T, labels[pick])
                step += 1
                lr = rate * (1 - step / (total + 1))
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    for k in p:
                        g[k] = np.clip(g[k], -1, 1)
                        m[k] += 0.1 * (g[k] - m[k])
                        v[k] += 0.01 * (g[k] ** 2 - v[k])
                        p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def _gradients(self, data: np.ndarray, labels: np.ndarray) -> list[dict[str, np.ndarray]]:
        (ahead, back), back_data = self.layers, data[::-1]
        steps, back_steps = ahead.forward(data, True), back.forward(back_data, True)
        w, b = self.out["w"], self.out["b"]
        into, back_into, gw, gb = [], [], np.zeros_like(w), np.zeros_like(b)
        scale = 1 / (data.shape[0] * data.shape[1])
        for t in range(len(data)):
            state = np.concatenate([steps[t][5], back_steps[len(data) - 1 - t][5]])
            e = w @ state + b
            e = np.exp(e - e.max(0))
            e /= e.sum(0)
            e[labels, np.arange(len(labels))] -= 1
            e *= scale
            gw += e @ state.T
            gb += e.sum(1, keepdims=True)
            d = w.T @ e
            into.append(d[:HIDDEN])
            back_into.append(d[HIDDEN:])
        return [ahead.backward(data, steps, into), back.backward(back_data, back_steps, back_into[::-1]), {"w": gw, "b": gb}]

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """(position, language, window): probabilities of every position."""
        data = np.ascontiguousarray(windows.T)
        ahead, back = self.layers[0].forward(data), self.layers[1].forward(data[::-1])
        w, b = self.out["w"], self.out["b"]
        out = np.empty((len(data), len(self.languages), data.shape[1]), np.float32)
        for t in range(len(data)):
            np.add(w[:, :HIDDEN] @ ahead[t], w[:, HIDDEN:] @ back[len(data) - 1 - t], out=out[t])
        out += b
        np.exp(np.clip(out, -30, 30, out=out), out=out)
        out /= out.sum(1, keepdims=True)
        return out

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """A row per text: the means over its positions; zeros for an empty one."""
        windows, used = cut(texts)
        sums = np.empty((len(windows), len(self.languages)))
        for at in range(0, len(windows), WIDTH):
            p = self.positions(windows[at : at + WIDTH])
            some = used[at : at + WIDTH]
            for k in np.flatnonzero(some < WINDOW):
                p[some[k] :, :, k] = 0
            sums[at : at + WIDTH] = p.sum(0).T
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // WINDOW) for t in texts])
        total = np.stack([np.bincount(owner, sums[:, k], len(texts)) for k in range(len(self.languages))], 1)
        return total / np.maximum(1, [[len(t)] for t in texts])

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages or not texts:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        known = np.array([has_letter(t) for t in texts])
        p = self.probabilities([t.encode() if k else b"" for t, k in zip(texts, known, strict=True)])
        best = p.argmax(1)
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0).tolist()


def train(docs: DataFrame, folds: int = 5, held_out: int = 0, sample: int = 2000, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of at most ``sample`` documents and ``sample_bytes`` of text outside the fold ``held_out``.

    One row for each id, those with the smallest hashes of their ids first; of rows that repeat an id the least (text, language).
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    usable = source.filter(f"id is not null and lang is not null and lang <> '{UNDETERMINED}' and {crc32_text('id')} % {folds} != {held_out}")
    pick = usable.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = usable.join(F.broadcast(pick), "id").groupBy("id").agg(F.min(F.struct("text", "lang")).alias("m")).filter("m.text <> ''")  # at most `sample` ids
    return LanguageModel(bounded(rows.select("id", "m.text", F.col("m.lang").alias("label")), sample_bytes))


def language_id(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with ``__lang`` and ``__lang_score``; columns of these names that docs has are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("__lang", "__lang_score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            langs, scores = shared.value.label(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "__lang", "__lang_score"])

    carried = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    return docs.mapInArrow(run, carried + "__lang string, __lang_score double")
