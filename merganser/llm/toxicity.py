"""Toxicity by compression distance.

Two zstandard dictionaries are trained on the driver, by the library's own trainer, from a bounded sample of labelled rows: one on
toxic texts, one on ordinary ones. A sample of the trainer is the distinct words of a text, in order, so that a text that
repeats itself counts once. The ordinary dictionary is trained in two rounds: first on whole texts, then on those of
their windows that the first pair takes for toxic, which chance matches bring about; both parts are kept. Both
dictionaries are filled to the same length, and the toxic part lies farthest from the window, so that a match there is
never the cheaper one merely for being near.

Whole texts are cut into windows, one word between spaces, in lower case. A window is compressed with each dictionary, by
the optimal parser and with literals left raw; the difference of the two lengths is what the toxic dictionary saves. So short
a window cannot be compressed by itself: each is put between CONTEXT, with which both dictionaries end, and TAIL, in whose
place the matcher does not look. Savings are compared with LEVELS: how many distinct windows of a text reach each one, by
themselves and by 100, and the largest saving give the document's score by a logistic calibration, fitted on texts that the
dictionaries of the calibration round had not seen. Windows are distinct within a text, and equal windows of a batch are
compressed once; a bounded cache keeps their savings.

Sizes, levels and the rounds were chosen by inner folds of the training rows.

Defined results: null and empty texts have no windows and get a low score like any other clean text. Labels that are null
are not learnt from; without both labels in the sample every score is the share of toxic labels. Repeated rows score
alike; of rows that repeat an id one is learnt from. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.llm.common import crc32_text
from merganser.llm.hashing import distinct
from merganser.llm.quality import SAMPLE_BYTES, labelled_sample, score_with

#: Bytes of each dictionary part, bytes of the segments that the trainer looks for, and of the pieces it counts.
ORDINARY_BYTES, HARD_BYTES, TOXIC_BYTES, SEGMENT, PIECE = 262_144, 131_072, 32_768, 16, 6
#: Savings (bytes) that are counted; a window of the first round's ordinary texts that saves HARD is learnt once more.
LEVELS, HARD = (1, 2, 3, 4, 5), 1
#: What windows stand between, and the number of windows whose savings a worker keeps.
CONTEXT, TAIL, CACHE = bytes(range(128, 224)), bytes([1, 2, 3, 4, 5, 6, 7, 8, 11, 12]), 300_000
WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
MATCHING = {"strategy": zstandard.STRATEGY_BTULTRA2, "min_match": 3, "target_length": 64, "window_log": 20, "hash_log": 19, "chain_log": 20, "search_log": 6}


def vocabulary(text: bytes) -> list[bytes]:
    """The distinct words of a text in lower case, in order."""
    return list(dict.fromkeys(WORD.findall(text)))


def trained(samples: list[list[bytes]], size: int) -> bytes:
    """A dictionary trained on the words of each sample; their last words themselves if they are too few to train on."""
    joined = [b" " + b" ".join(s) + b" " for s in samples if s]
    joined = [j for j in joined if len(j) >= 8]
    try:
        return zstandard.train_dictionary(size, joined, k=SEGMENT, d=PIECE).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(joined)[-size:]


def windows(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct windows of all texts; and (window, text), once each, in no order."""
    raw = b"\n".join(texts).lower() + b"\n"
    data = np.frombuffer(raw, np.uint8)
    letter = LETTER[data]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    edges = np.concatenate([[0], edge, [len(data)]])
    solid = letter[edges[:-1]]
    starts, ends = edges[:-1][solid], edges[1:][solid]
    keys, where = distinct(data, starts, ends)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    owner = np.searchsorted(bounds, starts, "right") - 1
    pairs = np.unique(owner * np.int64(max(1, len(where))) + keys)
    return [raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], pairs % max(1, len(where)), pairs // max(1, len(where))


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS, **MATCHING)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


class Dictionaries:
    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        toxic, ordinary = ([vocabulary(t.lower()) for t in texts] for texts in (toxic, ordinary))
        first = trained(ordinary, ORDINARY_BYTES)
        self._use(trained(toxic, TOXIC_BYTES), first)
        hard = [[w for w, d in zip(s, self.of(s), strict=True) if d >= HARD] for s in ordinary]
        self._use(self.toxic, first + trained(hard, HARD_BYTES))

    def _use(self, toxic: bytes, ordinary: bytes) -> None:
        self.toxic, self.ordinary, self._made, self._saved = toxic, ordinary, None, {}

    def __getstate__(self):
        return self.__dict__ | {"_made": None, "_saved": {}}

    def of(self, words: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each of these windows."""
        if self._made is None:
            size = max(len(self.toxic), len(self.ordinary))
            self._made = tuple(compressor(c.ljust(size, b"\n") + CONTEXT).compress for c in (self.toxic, self.ordinary))
        if len(self._saved) > CACHE:
            self._saved = {}
        toxic, ordinary = self._made
        saved, out = self._saved, []
        for word in words:
            d = saved.get(word)
            if d is None:
                window = b"".join((CONTEXT, b" ", word, b" ", TAIL))
                d = saved[word] = len(ordinary(window)) - len(toxic(window))
            out.append(d)
        return np.array(out, np.int64)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """A row per text: how many distinct windows reach each level, in number and by 100, and the largest saving."""
        words, keys, owner = windows(texts)
        d = self.of(words)[keys] if len(keys) else np.zeros(0, np.int64)
        n = np.maximum(np.bincount(owner, minlength=len(texts)), 10)
        columns = []
        for level in LEVELS:
            count = np.bincount(owner[d >= level], minlength=len(texts))
            columns += [np.log1p(count), np.minimum(100 * count / n, 10)]
        largest = np.zeros(len(texts))
        np.maximum.at(largest, owner, np.clip(d, 0, 10))
        return np.column_stack([*columns, largest])


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 3000) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 0.3 * (x.T @ (p - y) / len(y) + 1e-4 * w)
    return w


class ToxicityModel:
    def __init__(self, sample: list[tuple[bytes, int]]):
        sample = list(dict.fromkeys(sample))
        y = np.array([label for _, label in sample], float)
        self.prior, self.weights = float(y.mean()) if len(y) else 0.0, None
        if 0 < self.prior < 1:
            rows = np.empty((len(sample), 2 * len(LEVELS) + 1))
            fold = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) % 2  # half of each label
            for k in (0, 1):
                own = np.flatnonzero(fold == k)
                rows[own] = self._dictionaries([s for s, f in zip(sample, fold, strict=True) if f != k]).features([sample[i][0] for i in own])
            self.mean, self.scale = rows.mean(0), rows.std(0) + 1e-6
            self.weights = _logistic(np.column_stack([(rows - self.mean) / self.scale, np.ones(len(y))]), y)
            self.dictionaries = self._dictionaries(sample)

    @staticmethod
    def _dictionaries(sample: list[tuple[bytes, int]]) -> Dictionaries:
        return Dictionaries([t for t, y in sample if y], [t for t, y in sample if not y])

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x = self.dictionaries.features(texts)
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7, sample: int = 6000, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted for every row of docs."""
    model = ToxicityModel(labelled_sample(docs, labels, "toxic", folds, held_out, sample, id_col, text_col, sample_bytes))
    return score_with(docs, model, id_col, text_col).select(
        F.col(f"`{id_col}`"),
        F.coalesce(F.expr(crc32_text(f"`{id_col}`")) % folds == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
