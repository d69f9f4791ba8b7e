"""Classifiers: gradients, held-out accuracy, awkward rows."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from merganser.llm.language_id import HIDDEN, WINDOW, LanguageModel, language_id, train
from merganser.llm.quality import Ftrl, QualityModel, features, labelled_sample, quality_scores
from merganser.llm.toxicity import CONTEXT, LEVELS, TAIL, Dictionaries, ToxicityModel, compressor, toxicity_scores, windows

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
DOCS = "doc_id long, text string, lang string"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    y = np.array(labels) == 1
    return (order[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@needs_data
def test_quality_of_held_out_rows(spark):
    docs, labels = tables(spark)
    out = quality_scores(docs, labels)
    assert out.count() == docs.count()
    rows = out.filter("held_out").join(labels.filter("quality is not null"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert auc([r.score for r in rows], [r.quality for r in rows]) > 0.97
    good = [r.predicted for r in rows if r.quality == 1]
    assert sum(good) >= 0.99 * len(good)


@needs_data
def test_toxicity_of_held_out_rows(spark):
    docs, labels = tables(spark)
    rows = toxicity_scores(docs, labels).filter("held_out").join(labels.filter("toxic is not null"), "doc_id").collect()
    assert auc([r.score for r in rows], [r.toxic for r in rows]) > 0.85
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(clean) <= 0.05 * len(clean)  # the sample is small
    assert sum(r.predicted for r in rows if r.toxic) >= 0.6 * sum(r.toxic for r in rows)


@needs_data
def test_language_of_held_out_rows(spark):
    docs, _ = tables(spark)
    rows = language_id(docs, train(docs)).filter("crc32(cast(doc_id as string)) % 5 = 0").collect()
    assert sum(r.lang == r["__lang"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["__lang_score"] <= 1 for r in rows)


def awkward(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "de"), (4, "word " * 40_000, "en"), (5, "kurz", None), (5, "kurz", None), (None, "the text", "en"), *[(10 + i, f"hello world number {'abc'[i % 3]}", "en") for i in range(30)], *[(50 + i, f"bonjour le monde {'abc'[i % 3]}", "fr") for i in range(30)]]
    return spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit(1), "id": F.lit(2), "label": F.lit(3), "held_out": F.lit(True)})


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, int(i < 45), int(i >= 45)) for i in range(1, 80)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    for scores in (quality_scores, toxicity_scores):
        rows = scores(docs, labels).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
        again = scores(docs, labels).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
        none = scores(docs, labels.limit(0)).collect()
        assert len(none) == len(rows)
        assert scores(docs.limit(0), labels).count() == 0
    model = train(docs)
    rows = {r.text: (r["__lang"], r["__lang_score"]) for r in language_id(docs, model).collect()}
    assert rows[None] == rows[""] == rows["123 !?"] == ("und", 0.0)
    assert rows["bonjour le monde a"][0] == "fr" and rows["hello world number a"][0] == "en"
    nothing = train(docs.limit(0))
    assert {r["__lang"] for r in language_id(docs, nothing).collect()} == {"und"}
    assert language_id(docs.limit(0), model).count() == 0


def test_features_count_every_n_gram():
    at, owner = features([b"a b  b!", b"", b"c"], 18)
    assert np.bincount(owner, minlength=3).tolist() == [4 + 3, 0, 1]
    assert QualityModel([])([b"", b"x"]).tolist() == [0.5, 0.5]


def test_windows_are_all_words_once_a_text():
    texts = [b"One two, ONE\n2b", b"", b"\xc3\xa9t\xc3\xa9 two"]
    words, keys, owner = windows(texts)
    assert sorted((o, words[k]) for k, o in zip(keys, owner, strict=True)) == [(0, b"b"), (0, b"one"), (0, b"two"), (2, b"two"), (2, b"\xc3\xa9t\xc3\xa9")]
    assert len(set(words)) == len(words) == 4
    assert windows([])[0] == windows([b"", b"1 2"])[0] == []
    assert ToxicityModel([])([b""]).tolist() == [0.0]


def planted(n=400):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8)))
    out = []
    for k in range(n):
        words = [word() for _ in range(60)]
        if k % 4 == 0:
            words[10:50:10] = rng.choice(["vilest", "scoundrel", "wretch", "knave"], 4)
        out.append((" ".join(words).encode(), int(k % 4 == 0)))
    return out


def test_lengths_against_plain_compression():
    """Savings and features equal those of a plain loop over words with compressors of its own."""
    rows = planted(200)
    d = Dictionaries([t for t, y in rows if y], [t for t, y in rows if not y])
    size = max(len(d.toxic), len(d.ordinary))
    plain = [compressor(c + b"\n" * (size - len(c)) + CONTEXT) for c in (d.ordinary, d.toxic)]
    texts = [t for t, _ in rows[:30]] + [b"", b"Vilest VILEST knave, 12 knave"]
    for text, got in zip(texts, d.features(texts), strict=True):
        saved = []
        for w in sorted(set(re.findall(rb"[a-z]+", text.lower()))):
            a, b = (len(c.compress(CONTEXT + b" " + w + b" " + TAIL)) for c in plain)
            saved.append(a - b)
        want = []
        for level in LEVELS:
            n = sum(s >= level for s in saved)
            want += [np.log1p(n), min(100 * n / max(10, len(saved)), 10)]
        assert got.tolist() == pytest.approx([*want, min(10, max([0, *saved]))])


def test_both_dictionaries_are_trained():
    rows = planted()
    d = Dictionaries([t for t, y in rows if y], [t for t, y in rows if not y])
    magic = (0xEC30A437).to_bytes(4, "little")
    assert d.toxic[:4] == magic and d.ordinary[:4] == magic
    assert (d.of([b"scoundrel", b"vilest"]) >= 3).all() and np.mean(d.of([b"lanure", b"stolena", b"irate"])) < 2
    model = ToxicityModel(rows)
    fresh = planted(480)[400:]
    assert [int(s >= 0.7) for s in model([t for t, _ in fresh])] == [y for _, y in fresh]


def test_samples_are_reproducible_and_bounded(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i} " * (i % 7 + 1)) for i in range(400)] + [(7, None), (None, "x")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i % 60, i % 2) for i in range(300)] + [(3, None), (None, 1)], "doc_id long, quality int")
    one = labelled_sample(docs.repartition(7), labels, "quality", 5, 0, 30)
    assert one == labelled_sample(docs.repartition(3), labels.repartition(2), "quality", 5, 0, 30) and 20 < len(one) <= 30, len(one)
    few = labelled_sample(docs, labels, "quality", 5, 0, 30, sample_bytes=100)
    assert 0 < sum(len(t) for t, _ in few) <= 100
    assert all(t == b"" for t, _ in labelled_sample(docs, labels, "quality", 5, 0, 30, sample_bytes=1))
    a, b = train(docs.repartition(5), sample=20), train(docs.repartition(2), sample=20)
    assert all(np.array_equal(a.layers[0].p[k], b.layers[0].p[k]) for k in "xub")


def test_ftrl_against_plain_updates():
    """Per coordinate, in pure Python, in the order that fit() takes the rows."""
    rows = [(b"good words here", 1), (b"bad bad words", 0), (b"", 1), (b"good again", 1), (b"worse", 0)]
    bits, m = 12, Ftrl(12)
    got = m.fit([t for t, _ in rows], [y for _, y in rows], epochs=3)
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= m.l1:
            return 0.0
        return -(z[i] - math.copysign(m.l1, z[i])) / ((m.beta + math.sqrt(n[i])) / m.alpha + m.l2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for k in order.permutation(len(rows)):
            counts = Counter(features([rows[k][0]], bits)[0].tolist())
            x = {i: c * m.gain / max(1, sum(counts.values())) for i, c in counts.items()} | {1 << bits: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - rows[k][1]) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / m.alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    for i in range((1 << bits) + 1):
        assert got[i] == pytest.approx(weight(i) if i in z else 0.0, abs=1e-5)


def test_labels_against_a_plain_forward_pass():
    """Byte by byte, with the logistic function, one window at a time."""
    model = LanguageModel([(b"the words of one language " * 9, "x"), (b"die Worte der anderen " * 9, "y")], epochs=2)
    texts = ["the words", "die Worte " * 40, "x", None, "12", "", "é" * 70]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(layer, data):
        h, out = np.zeros(HIDDEN), []
        for b in data:
            a, s = layer.p["x"][:, b].astype(float), layer.p["u"].astype(float) @ h
            z, r = sigmoid(a[:HIDDEN] + s[:HIDDEN]), sigmoid(a[HIDDEN : 2 * HIDDEN] + s[HIDDEN : 2 * HIDDEN])
            n = np.tanh(a[2 * HIDDEN :] + r * (s[2 * HIDDEN :] + layer.p["b"][:, 0]))
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    langs, scores = model.label(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        if not text or not any(map(str.isalpha, text)):
            assert (lang, score) == ("und", 0.0)
            continue
        raw, total = text.encode(), np.zeros(2)
        for at in range(0, len(raw), WINDOW):
            data = raw[at : at + WINDOW].ljust(WINDOW)
            ahead, back = states(model.layers[0], data), states(model.layers[1], data[::-1])[::-1]
            for k in range(min(WINDOW, len(raw) - at)):
                e = np.exp(model.out["w"].astype(float) @ np.concatenate([ahead[k], back[k]]) + model.out["b"][:, 0])
                total += e / e.sum()
        p = total / len(raw)
        assert lang == model.languages[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-4)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = LanguageModel([(b"a" * 200, "x"), (b"b" * 200, "y")], epochs=0)
    for p in (*(layer.p for layer in model.layers), model.out):
        for k in p:
            p[k] = p[k].astype(np.float64)
    data, labels = rng.integers(0, 256, (7, 3)), np.array([0, 1, 1])

    def loss():
        ahead, back = model.layers[0].forward(data), model.layers[1].forward(data[::-1])
        total = 0.0
        for t in range(len(data)):
            e = model.out["w"] @ np.concatenate([ahead[t], back[len(data) - 1 - t]]) + model.out["b"]
            total -= (e - np.log(np.exp(e).sum(0)))[labels, np.arange(3)].sum()
        return total / data.size

    grads = model._gradients(data, labels)
    for p, g in zip([model.layers[0].p, model.layers[1].p, model.out], grads, strict=True):
        for k in p:
            places = [(int(rng.integers(p[k].shape[0])), int(data.ravel()[j]) if k == "x" else int(rng.integers(p[k].shape[1]))) for j in range(6)]
            for at in places:
                old = p[k][at]
                p[k][at] = old + 1e-5
                high = loss()
                p[k][at] = old - 1e-5
                low = loss()
                p[k][at] = old
                assert g[k][at] == pytest.approx((high - low) / 2e-5, rel=1e-3, abs=1e-7)
    assert model.layers[0].p["u"].shape == (3 * HIDDEN, HIDDEN)
