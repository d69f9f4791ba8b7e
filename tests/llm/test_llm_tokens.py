"""Encoder, token files, packing and decontamination against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from merganser.llm import hashing
from merganser.llm.common import Workspace
from merganser.llm.decontaminate import contaminated, contamination, decontaminate
from merganser.llm.packing import BoundedBestFit, pack_best_fit
from merganser.llm.token_files import ShardReader, filesystem, read_token_files, write_token_files
from merganser.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
DOCS = "doc_id long, text string"
ODD = ["a", "B", "é", " ", "  ", "\n", ".", ",", "'s", "1", "%", "\t", " ", "’", "\0", "word", "\r\n", "日", "<|endoftext|>", "é", "!?", " "]


def twins(size=1024):
    """Two words that every polynomial hash modulo a power of two takes for one: a Thue-Morse word and its complement."""
    word = "a"
    while len(word) < size:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


@pytest.mark.parametrize("path, spaces", [(BYTES, "kept"), (WORDS, "dropped")])
def test_encoder_tells_twins_and_added_tokens_apart(path, spaces):
    from tokenizers import Tokenizer

    a, b = twins()
    enc, library = Encoder(path, spaces), Tokenizer.from_file(path)
    texts = [f"{a} {b}", b, a, f"x {b}. {a}, y", "one two<|endoftext|>three four", "<|startoftext|>a b", "<|EndOfText|> c", " ".join(twins(2048))]
    assert [list(np.frombuffer(i, "<u4")) for i in enc.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_slices_are_told_apart_by_their_bytes():
    rng = random.Random(4)
    words = [w.encode() for w in twins() * 2] + [bytes(rng.choice(b"ab\0") for _ in range(rng.choice([0, 1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 70]))) for _ in range(2000)]
    ends = np.cumsum([len(w) for w in words])
    starts, data = ends - [len(w) for w in words], np.frombuffer(b"".join(words), np.uint8)
    codes, where = hashing.distinct(data, starts, ends)
    for got in (codes, hashing.hash_slices(data, starts, ends)):
        assert len(set(zip(words, got.tolist(), strict=True))) == len(set(words)) == len(set(got.tolist()))
    assert codes[where].tolist() == list(range(len(where)))
    other = rng.sample(range(len(words)), len(words))
    same = hashing.equal_slices(data, starts, ends - starts, data, starts[other], (ends - starts)[other])
    assert same.tolist() == [words[i] == words[j] for i, j in enumerate(other)]


def test_unequal_slices_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(hashing, "_chained", lambda lanes, starts, sizes: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"aaaaaaaabbbbbbbbaaaaaaaa", np.uint8)
    codes, _ = hashing.distinct(data, np.array([0, 8, 16]), np.array([8, 16, 24]))
    assert codes[0] == codes[2] != codes[1]


@pytest.mark.parametrize("path, spaces", [(BYTES, "kept"), (WORDS, "dropped")])
def test_encoder_equals_the_library(path, spaces):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["", " ", "\n", "x" * 100_000, "word " * 50_000 + "end"]
    enc = Encoder(path, spaces)
    for at in range(0, len(texts), 41):
        assert enc.encode(texts[at : at + 41]) == enc.whole(texts[at : at + 41])


def rows(n=300):
    rng = random.Random(2)
    out = [(i, " ".join(rng.choice(["alpha", "beta", "gamma.", "delta,"]) for _ in range(rng.choice([0, 1, 20, 400])))) for i in range(n)]
    out += [(5, "again"), (5, "again"), (None, "no id"), (n, None), (n + 1, "long " * 40_000)]
    rng.shuffle(out)
    return out


def plain(path, text):
    import numpy as np
    from tokenizers import Tokenizer

    t = plain.cache.setdefault(path, Tokenizer.from_file(path))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()


plain.cache = {}


def test_token_files_round_trip(spark):
    work = Workspace(spark, "test-files")
    df = spark.createDataFrame(rows(), DOCS).withColumns({"shard": F.lit(1), "path": F.lit(2)}).repartition(5)
    manifest = write_token_files(df, work.path("shards"), BYTES, work, frame_ids=500)
    got = read_token_files(spark, manifest).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, plain(BYTES, t)) for i, t in rows())
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    some = read_token_files(spark, manifest, wanted=(7, 301)).collect()
    assert {(r.doc_id, r.start) for r in some} == {(r.doc_id, r.start) for r in got if r.doc_id in (7, 301)}


def test_reader_decompresses_only_what_it_needs_and_checks_it(spark):
    work = Workspace(spark, "test-damage")
    manifest = write_token_files(spark.createDataFrame(rows(), DOCS).coalesce(1), work.path("shards"), BYTES, work, frame_ids=500)
    path = max(manifest.collect(), key=lambda r: r.n_docs).path
    store, at = filesystem(path)
    with store.open_input_file(at) as f:
        data = bytearray(f.read())
    import io

    reader = ShardReader(io.BytesIO(bytes(data)))
    asked = []
    frame = reader.frame
    reader.frame = lambda k: asked.append(k) or frame(k)
    doc = int(reader.docs["doc"][-1])
    list(reader.read([doc]))
    assert asked == [int(reader.docs["frame"][-1])] and len(reader.frames) > 1
    data[5] ^= 255
    with pytest.raises(Exception):  # noqa: B017  the frame's own checksum, or the table's
        list(ShardReader(io.BytesIO(bytes(data))).read())
    with pytest.raises(ValueError):
        ShardReader(io.BytesIO(bytes(data[:-1])))


def test_packing(spark):
    df = spark.createDataFrame(rows(), DOCS).withColumns({"piece": F.lit(1), "ids": F.lit(2), "offset": F.lit(3)}).repartition(3)
    got = pack_best_fit(df, WORDS, length=256).collect()
    docs = Counter()
    for (doc, text), n in Counter(rows()).items():
        docs[doc, plain(WORDS, text)] += n
    pieces, bins = Counter(), {}
    for r in got:
        assert r.length == len(r.ids) // 4 and r.start == 256 * r.piece and 0 < r.length <= 256
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[r.doc_id, r.piece, bytes(r.ids)] += 1
    want = Counter()
    for (doc, ids), n in docs.items():
        for k in range(0, len(ids), 1024):
            want[doc, k // 1024, ids[k : k + 1024]] += n
    assert pieces == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert pack_best_fit(spark.createDataFrame([], DOCS), WORDS).count() == 0


def test_best_fit_is_bounded_and_tight():
    rng = random.Random(3)
    sizes = [rng.randint(1, 2048) for _ in range(20_000)]
    packer = BoundedBestFit(2048, 64)
    used = Counter()
    for n in sizes:
        b, offset = packer.place(n)
        assert offset == used[b]
        used[b] += n
        assert packer.open <= 64
    assert max(used.values()) <= 2048 and len(used) <= 1.1 * sum(sizes) / 2048
    exact = BoundedBestFit(10, 2)
    assert [exact.place(n) for n in (6, 7, 3, 8, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    closing = BoundedBestFit(10, 2)
    assert [closing.place(n) for n in (6, 7, 9, 3, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]  # the fullest closed: 3 would have filled it


def naive_best_fit(sizes, length, most):
    """Goes through all open bins for each piece; of equal ones the last that was filled counts."""
    bins, made, out = [], 0, []
    for stamp, n in enumerate(sizes):
        room = [b for b in bins if b["free"] >= n]
        if room:
            b = min(room, key=lambda b: (b["free"], -b["stamp"]))
        else:
            if len(bins) == most and n < length:
                bins.remove(min(bins, key=lambda b: (b["free"], -b["stamp"])))
            b = {"free": length, "id": made}
            made += 1
            bins.append(b)
        out.append((b["id"], length - b["free"]))
        b["free"] -= n
        b["stamp"] = stamp
        if not b["free"]:
            bins.remove(b)
    return out


@pytest.mark.parametrize("seed, length, most", [(1, 20, 3), (2, 2048, 16), (3, 7, 1), (4, 2048, 1024)])
def test_best_fit_against_a_plain_search(seed, length, most):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, length), rng.randint(1, max(1, length // 4)), length]) for _ in range(3000)]
    packer = BoundedBestFit(length, most)
    assert [packer.place(n) for n in sizes] == naive_best_fit(sizes, length, most)


def test_a_full_piece_closes_nothing():
    packer = BoundedBestFit(10, 2)
    assert [packer.place(n)[0] for n in (6, 7, 10, 3, 4)] == [0, 1, 2, 1, 0]


def test_packing_is_dense(spark):
    """One task leaves less than two sequences in a hundred beyond the least possible number."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, "word " * rng.randint(1, 200)) for i in range(2000)], DOCS).coalesce(1)
    got = pack_best_fit(docs, WORDS, length=256).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(got) <= 1.02 * sum(r.n for r in got) / 256


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("block", [200_000, 12])
def test_contamination_against_brute_force(spark, block):
    rng = random.Random(5)
    vocab = ["aa", "BB", "c1", "é", "dd", "ee"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(f"i{k}", text(rng.choice([1, 2, 3, 6, 9, 40]))) for k in range(14)] + [(None, text(7)), ("twin", f"w {twins()[0]}"), (None, f"w {twins()[0]}"), ("i0", "aa aa"), ("none", "?!"), ("null", None), (None, "aa")]
    docs = [(i, text(rng.choice([0, 1, 4, 40, 90]))) for i in range(120)] + [(500, None), (501, ""), (3, "aa bb"), (503, f"w {twins()[0]} w {twins()[1]}"), (504, f"w {twins()[1]}"), (502, "zz " * 30_000)]
    got = contamination(
        spark.createDataFrame(docs, DOCS).withColumns({"n": F.lit(1), "h": F.lit(2), "item_id": F.lit(3)}).repartition(3), spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(1)), window=6, shingle=3, block=block
    ).select("doc_id", "text", "__words", "__hit", "__items", contaminated().alias("bad"))
    windows = {}
    for item, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - 5) if w else 0):
            windows.setdefault(tuple(w[k : k + 6]), set()).add(item)
    want = Counter()
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for window, names in windows.items():
            for k in range(len(w) - len(window) + 1):
                if w[k : k + len(window)] == list(window):
                    hit.update(range(k, k + len(window)))
                    found |= names
        want[i, t, len(w), len(hit), tuple(sorted(found, key=str)), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    assert Counter((r[0], r[1], r[2], r[3], tuple(sorted(r[4], key=str)), r[5]) for r in got.collect()) == want


def test_a_large_benchmark_in_blocks(spark):
    """A million windows: items of all lengths, the longest larger than a block."""
    rng = random.Random(9)
    vocab = [f"v{k}" for k in range(5000)]
    long = [rng.choice(vocab) for _ in range(700_000)]
    items = [("long", " ".join(long)), *[(f"i{k}", " ".join(rng.choice(vocab) for _ in range(60))) for k in range(7_000)]]
    docs = [(1, "zz " + " ".join(long[399_990:400_010]) + " zz"), (2, " ".join(long[5:17])), (3, items[7][1]), (4, " ".join(long[-13:]))]
    out = contamination(spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame(items, "item_id string, text string"), block=400_000)
    assert {r.doc_id: (r["__hit"], r["__items"]) for r in out.collect()} == {1: (20, ["long"]), 2: (0, []), 3: (60, ["i6"]), 4: (13, ["long"])}


def test_contamination_of_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x")], DOCS).withColumns({"__hit": F.lit("h"), "__WORDS": F.lit("w"), "c0": F.lit(1)})
    items = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    assert [r["__hit"] for r in contamination(docs, items).orderBy("doc_id").collect()] == [3, 0]
    assert [tuple(r) for r in decontaminate(docs, items).collect()] == [(2, "x", "h", "w", 1)]


def test_contamination_of_nothing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    assert decontaminate(docs, items).count() == 0
    assert decontaminate(spark.createDataFrame([(1, "a b c"), (2, "x")], DOCS), items.limit(0)).count() == 2
    assert [r.doc_id for r in decontaminate(spark.createDataFrame([(1, "a b c"), (2, "x")], DOCS), items).collect()] == [2]


def test_crc_of_ids():
    assert zlib.crc32(plain(WORDS, "")) == zlib.crc32(b"\0\0\0\0")
