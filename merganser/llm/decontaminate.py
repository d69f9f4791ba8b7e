"""Benchmark decontamination as a prefix-filtered set join.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A benchmark item's windows are its
runs of ``window`` words, or all its words if they are fewer. Each window is a set of shingles of ``shingle`` words; for
containment of the whole window one shingle is the necessary prefix, and the rarest is taken: one pass over all
documents counts how many documents hold each benchmark shingle. A second pass joins the documents' shingles to those
prefixes, drops candidates that would begin before the document or end after it (length and position), and compares
the words of the window one by one, first by hash, then byte by byte. Words that any occurrence covers are hit.

The benchmark's windows are broadcast in blocks that begin at no more than ``block`` words, whatever the items are: a long item
is cut into stretches that overlap by a window less one word. A larger benchmark takes one more pass for each block, and
each pass adds its hits to what the document already carries. A block's tables are built once a worker. Documents are never
shuffled.

Defined results: null and empty texts have no words, no hits, and are not contaminated; items without words have no
windows; equal windows of several items count for each of them; items that repeat an id count once. Items without an id hit
like others and count as one item, whose id is a null in the list. Repeated documents are judged one by one. An empty
benchmark or table is no special case. All columns of the documents are carried, and added ones start with ``__``; a column
of the documents that has the name of an added one is left out by ``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.llm.common import pieces
from merganser.llm.hashing import U, classes, distinct, equal_slices, hash_slices, runs, spans

TABLE = classes(bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122)))
ADDED = "__words long, __spans binary, __items array<string>, __hit long"
#: Bits of the table that turns most shingles away before the search.
SIEVE = 20


class Words:
    """The words of a batch of texts: their bytes, places and hashes, and the number of words before each text and in all."""

    def __init__(self, texts: list[str | None]):
        self.data, self.starts, self.ends, self.bounds = spans([(t or "").encode().lower() for t in texts], TABLE)
        self.hashes = hash_slices(self.data, self.starts, self.ends)


class Sieved:
    """Where each of many hashes stands in a small sorted array, if at all."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[(self.keys & U((1 << SIEVE) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in hashes, places in keys)."""
        at = np.flatnonzero(self.sieve[(hashes & U((1 << SIEVE) - 1)).astype(np.int64)])
        k = np.searchsorted(self.keys, hashes[at])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == hashes[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[same], k[same]


class Windows:
    """A block of benchmark windows: their words, their items, and the shingles they can be found by."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, shingle: int):
        """items: (id, words joined by spaces), no more than a stretch of words each."""
        words = Words([t.decode() for _, t in items])
        self.data, self.starts, self.ends, self.hashes = words.data, words.starts, words.ends, words.hashes
        codes = distinct(self.data, self.starts, self.ends)[0]
        found: dict[bytes, int] = {}
        first, size, names = [], [], []
        for i, (item, _) in enumerate(items):
            begin, end = int(words.bounds[i]), int(words.bounds[i + 1])
            n = min(window, end - begin)
            for k in range(begin, end - n + 1 if n else begin):
                w = found.setdefault(codes[k : k + n].tobytes(), len(first))
                if w == len(first):
                    first.append(k)
                    size.append(n)
                    names.append(set())
                names[w].add(item)
        self.first, self.size = np.array(first, np.int64), np.array(size, np.int64)
        self.items = [_sorted(x) for x in names]
        #: (hash, window, offset, length) of every shingle
        n = np.minimum(self.size, shingle)
        each = self.size - n + 1
        self.window = np.repeat(np.arange(len(first)), each)
        self.offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        self.length = n[self.window]
        self.h = np.zeros(len(self.window), U)
        for m in np.unique(self.length):
            own = self.length == m
            self.h[own] = runs(self.hashes, int(m))[self.first[self.window[own]] + self.offset[own]]
        self._tables: list[tuple] | None = None

    def prefixes(self, counts: dict[int, int]) -> None:
        """Keeps the rarest shingle of each window; ties go to the smaller hash, so that windows share it."""
        order = np.lexsort((self.h, [counts.get(h, 0) for h in self.h.view(np.int64).tolist()], self.window))
        first = order[np.unique(self.window[order], return_index=True)[1]] if len(order) else order
        by = first[np.argsort(self.h[first], kind="stable")]
        self.h, self.window, self.offset, self.length = (x[by] for x in (self.h, self.window, self.offset, self.length))

    def tables(self) -> list[tuple]:
        """For each length of shingles: what turns most hashes away, and the windows of each; built once a worker."""
        if self._tables is None:
            self._tables = []
            for n in np.unique(self.length).tolist():
                own = self.length == n
                sieve, h = Sieved(self.h[own]), self.h[own]
                left, right = (np.searchsorted(h, sieve.keys, side) for side in ("left", "right"))
                self._tables.append((n, sieve, self.window[own], self.offset[own], left, right))
        return self._tables

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, window) of every occurrence in the texts with these words."""
        starts, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        hashes, bounds = words.hashes, words.bounds
        for n, sieve, window, offset, left, right in self.tables():
            at, k = sieve.find(runs(hashes, n))
            each = right[k] - left[k]
            row = np.repeat(left[k] - np.cumsum(each) + each, each) + np.arange(each.sum())
            start, w = np.repeat(at, each) - offset[row], window[row]
            text = np.searchsorted(bounds, np.repeat(at, each), "right") - 1
            fits = (start >= bounds[text]) & (start + self.size[w] <= bounds[text + 1])
            start, w = start[fits], w[fits]
            for j in range(int(self.size.max(initial=0))):  # word by word
                more = self.size[w] > j
                same = ~more
                same[more] = hashes[start[more] + j] == self.hashes[self.first[w[more]] + j]
                start, w = start[same], w[same]
            same = self._same_bytes(words, start, w)
            starts.append(start[same])
            found.append(w[same])
        return np.concatenate(starts), np.concatenate(found)

    def _same_bytes(self, words: Words, start: np.ndarray, w: np.ndarray) -> np.ndarray:
        size = self.size[w]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        a, b = np.repeat(start, size) + step, np.repeat(self.first[w], size) + step
        same = equal_slices(words.data, words.starts[a], words.ends[a] - words.starts[a], self.data, self.starts[b], self.ends[b] - self.starts[b])
        return np.bincount(np.repeat(np.arange(len(w)), size), ~same, len(w)) == 0


def _counted(text_col: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        sieves: dict[int, Sieved] = {}
        for batch in pieces(batches, text_col):
            if total is None:
                h, length = shared.value
                sieves = {int(n): Sieved(h[length == n]) for n in np.unique(length)}
                total = {n: np.zeros(len(s.keys), np.int64) for n, s in sieves.items()}
            words = Words(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            hashes, bounds = words.hashes, words.bounds
            for n, sieve in sieves.items():
                at, k = sieve.find(runs(hashes, n))
                text = np.searchsorted(bounds, at, "right") - 1
                inside = at + n <= bounds[text + 1]
                once = np.unique(text[inside] * np.int64(len(sieve.keys)) + k[inside])  # documents, not places
                total[n] += np.bincount(once % len(sieve.keys), minlength=len(sieve.keys)) if len(once) else 0
        for n, counts in (total or {}).items():
            some = counts > 0
            yield pa.RecordBatch.from_arrays([pa.array(sieves[n].keys[some].view(np.int64)), pa.array(counts[some])], ["h", "n"])

    return run


def _sorted(items: set) -> list:
    return sorted(items, key=lambda i: (i is None, i or ""))


def _hits(spans: bytes | None) -> int:
    """Words inside any span."""
    end = hit = 0
    for start, size in sorted(np.frombuffer(spans or b"", "<i8").reshape(-1, 2).tolist()):
        hit += max(0, start + size - max(start, end))
        end = max(end, start + size)
    return hit


def _matched(text_col: str, shared, more: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            block: Windows = shared.value
            words = Words(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            bounds = words.bounds
            starts, windows = block.find(words)
            text = np.searchsorted(bounds, starts, "right") - 1
            order = np.lexsort((starts, text))
            starts, windows, text = starts[order], windows[order], text[order]
            rows = np.searchsorted(text, np.arange(batch.num_rows + 1))
            spans, items = [None] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            for i in np.unique(text):
                own = slice(rows[i], rows[i + 1])
                spans[i] = np.column_stack([starts[own] - bounds[i], block.size[windows[own]]]).astype("<i8").tobytes()
                items[i] = _sorted({x for w in np.unique(windows[own]) for x in block.items[w]})
            names, columns = batch.schema.names, batch.columns
            if more:  # what earlier blocks found
                before = {n: batch.column(names.index(n)).to_pylist() for n in ("__spans", "__items")}
                spans = [(a or b"") + (b or b"") or None for a, b in zip(before["__spans"], spans, strict=True)]
                items = [_sorted({*a, *b}) for a, b in zip(before["__items"], items, strict=True)]
                names, columns = names[:-4], columns[:-4]
            added = [pa.array(np.diff(bounds).astype(np.int64)), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(list(map(_hits, spans)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *added], [*names, "__words", "__spans", "__items", "__hit"])

    return run


def _schema(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def stretches(items, block: int, window: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Blocks of (item id, words joined by spaces) at which no more than ``block`` windows begin; each item's windows stand in
    some stretch of it."""
    held: list[tuple[str | None, bytes]] = []
    size = 0
    for item, text in items:
        words = Words([text])
        own = [words.data[a:b].tobytes() for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
        begin = 0
        while begin < len(own):
            if size >= block:
                yield held
                held, size = [], 0
            n = min(max(1, len(own) - begin - window + 1), block - size)
            held.append((item, b" ".join(own[begin : begin + n + window - 1])))
            size, begin = size + n, begin + n
            if begin + window > len(own):
                break
    yield held


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, shingle: int = 5, block: int = 200_000) -> DataFrame:
    """docs with ``__words``, ``__spans`` (pairs of first word and size), ``__items`` and ``__hit`` (words inside a span)."""
    spark = docs.sparkSession
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("__words", "__spans", "__items", "__hit")])
    text = docs.select(F.col(f"`{text_col}`").alias("text"))
    source = items.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{item_text}`"))
    out, carried = docs, _schema(docs)
    for done, pending in enumerate(stretches(source.toLocalIterator(), block, window)):
        windows = Windows(pending, window, shingle)
        counts = {}
        if len(windows.h):
            shared = spark.sparkContext.broadcast((windows.h, windows.length))
            rows = text.mapInArrow(_counted("text", shared), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
            counts = dict(rows.collect())  # at most a row per shingle of the block
        windows.prefixes(counts)
        out = out.mapInArrow(_matched(text_col, spark.sparkContext.broadcast(windows), done > 0), carried + ADDED)
    return out


def contaminated(least: int = 20):
    """The rule: some word is hit, and at least one in ``least``."""
    return (F.col("__hit") > 0) & (least * F.col("__hit") >= F.col("__words"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents that are not contaminated, with the columns they had."""
    plain = docs.toDF(*["text" if c == text_col else f"c{k}" for k, c in enumerate(docs.columns)])
    clean = contamination(plain, items, text_col="text", **how).filter(~contaminated())
    return clean.select(*plain.columns).toDF(*docs.columns)
