"""Chat formatting, whitening and collocations against plain versions, and with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from merganser.llm import chat, whitening
from merganser.llm.collocations import _sums, collocations
from merganser.llm.common import Workspace

TURNS = "conv_id long, turn long, role string, text string"
CONTROL = ["<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<", "[", "\\", "|", "/", "s>", "INST]", "\n", "a", "é", " ", "user", "<|", "\\|"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def chats_of(rows, section=chat.SECTION):
    """Plain digests: conv_id -> (n_turns, turns, loss_chars, loss, sections)."""
    of = defaultdict(list)
    for c, t, r, x in rows:
        of[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in of.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), len({(t[0], int(t[1] / section)) for t, _, _ in turns}))
    return out


def digests(spark, rows, section=chat.SECTION, broadcast=chat.BROADCAST):
    df = spark.createDataFrame(rows, TURNS).withColumns({"alone": F.lit(1), "section": F.lit("x"), "turns": F.lit(2), "far": F.lit(3)})
    written = Workspace(spark, "chats").write(chat.format_chats(df, section=section), "formatted")
    got = chat.chat_digests(written).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_sections) for r in got}, written


def test_chats_read_back(spark):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice(CONTROL) for _ in range(rng.choice([0, 1, 2, 5, 12])))
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool\n\\n\\b", "<|im_end|>\n", "", None]), rng.choice([text(), text(), text(), None])) for c in [*range(60), None] for t in range(rng.choice([1, 2, 7, 20]))]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (5, None, "user", "first"), (6, 0, "user", "twice"), (6, 0, "user", "twice"), (7, -3, "assistant", "x" * 200_000)]
    got, written = digests(spark, rows)
    assert got == chats_of(rows)
    # no text can hold a mark: their number is that of the turns
    for r in written.collect():
        assert len(re.findall(r"<\|", r.formatted)) == r.formatted.count("<|im_end|>\n") + r.formatted.count("<|im_start|>") + r.formatted.count("<|im_sep|>")
        assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>", r.formatted)
    assert digests(spark, [])[0] == {}


def test_adjacent_turns_of_a_role_are_one_message(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", ""), (1, 4, "user", "[INST]")]
    out = chat.format_chats(spark.createDataFrame(rows, TURNS)).first()
    assert out.formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_sep|><|im_end|>\n<|im_start|>user\n[\\INST]<|im_end|>\n"
    assert [out.formatted[s.start : s.start + s.length] for s in out.loss] == ["c", ""]


def test_long_conversations_are_several_rows(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), f"{c} [INST] {t}") for c, n in ((1, 100), (2, 3), (3, 40), (None, 20)) for t in range(-5, n)] + [(2, None, "user", "x")]
    for broadcast in (chat.BROADCAST, 0):
        chat.BROADCAST, before = broadcast, chat.BROADCAST
        try:
            got, written = digests(spark, rows, section=8)
        finally:
            chat.BROADCAST = before
        assert got == chats_of(rows, 8)
    assert written.count() > 15


def plain_whitening(vectors, k=4):
    """numpy over the distinct whole-number vectors: n, sums, eigenvalues, components."""
    x = np.array(sorted({tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors}), dtype=float)
    v = np.cov(x.T, bias=True).reshape(x.shape[1], -1)
    e, c = np.linalg.eigh(v)
    return len(x), x.astype(int).sum(0).tolist(), e[::-1][:k], c[:, ::-1].T[:k], np.trace(v)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(6, 6))
    vectors = (rng.normal(size=(900, 6)) @ mixed + 3).astype(np.float32).tolist()
    vectors += [vectors[0]] * 50 + [[-0.0, 0.0, 1 / 256, -1 / 256, 0.00390624, 5.0]] * 3
    bad = [None, [1.0, None, 2.0, 3.0, 4.0, 5.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [float("-inf")] * 6, []]
    rows = list(enumerate(vectors + bad)) + [(None, vectors[3]), (3, vectors[3]), (3, vectors[4])]
    other = [(5000 + i, [float(i), float(i * i % 7)]) for i in range(20)]
    df = spark.createDataFrame(rows + other, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "n": F.lit("y"), "v": F.lit(2), "d": F.lit(1)}).repartition(19)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that several summaries merge
    try:
        got = whitening.whiten(df, fanout=2).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for d, part in ((6, [r for r in rows if r[1] in vectors]), (2, other)):
        n, sums, e, c, trace = plain_whitening([v for _, v in part])
        mine = [r for r in got if r.dimensions == d]
        k = min(4, d)
        assert len(mine) == k * len(part)
        assert {r.n for r in mine} == {n} and len({r.identity_error for r in mine}) == 1 and mine[0].identity_error < 1e-12
        want = defaultdict(list)
        for i, v in part:
            x = [math.floor(256 * float(np.float32(a))) for a in v]
            apart = [n * a - s for a, s in zip(x, sums, strict=True)]
            for j in range(k):
                want[i, j + 1, sum(a * a for a in apart)].append(float(np.dot(np.array(apart) / n, c[j]) / math.sqrt(e[j])))
        have = defaultdict(list)
        for r in mine:
            have[r.vec_id, r.component, r.deviation].append(r.whitened)
            assert abs(r.explained * trace / e[r.component - 1] - 1) < 1e-9
        assert have.keys() == want.keys()
        for j in range(1, k + 1):
            sign = {np.sign(a * b) for key in have if key[1] == j and len(have[key]) == 1 for a, b in zip(have[key], want[key], strict=True) if abs(a) > 1e-6}
            assert len(sign) == 1
            for key in have:
                if key[1] == j:
                    assert np.allclose(sorted(have[key]), sorted(x * next(iter(sign)) for x in want[key]), atol=1e-9)


def test_merging_summaries_loses_nothing():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(500, 12)) * 1000 @ rng.normal(size=(12, 12)) + 10**7).astype(np.int64)
    parts = [whitening.Summary.of(p) for p in np.split(x, [1, 2, 5, 40, 300])]
    while len(parts) > 1:
        parts = [a.merge(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
    centred = x - x.mean(0)
    assert parts[0].n == 500 and parts[0].sums == x.sum(0).tolist()
    assert np.allclose(parts[0].s, np.linalg.svd(centred, compute_uv=False), rtol=1e-12)
    assert np.allclose((parts[0].s[:, None] * parts[0].vt).T @ (parts[0].s[:, None] * parts[0].vt), centred.T @ centred, rtol=1e-9)


def test_whitening_of_few_and_flat_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0])] * 3, schema)).collect()
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(j, 1, 0, None, None, None) for j in (1, 2, 3)} and len(one) == 9
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0, 0.0, 1.0]) for i in range(5)], schema)).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.explained == (1.0 if r.component == 1 else 0.0) for r in flat)
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    far = whitening.whiten(spark.createDataFrame([(0, [1e9, 0.0]), (1, [0.0, 1.0]), (2, [1e38, 0.0])], schema)).collect()
    assert {r.vec_id for r in far} == {0, 1} and all(r.deviation is None for r in far)  # over 64 bits


def plain_collocations(rows, most, least):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        big = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in big.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in big.items():
            if inside[p] < a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


def test_collocations_against_counting(spark, monkeypatch):
    from merganser.llm import collocations as module

    rng = random.Random(5)
    words = ["the", "The", "of", "ÄRGER", "naïve", "a", "b", "<s>", "don't", "x" * 40, "日本", "\\"]
    word = lambda: words[min(int(rng.expovariate(0.5)), len(words) - 1)]
    text = lambda m: "".join(word() + rng.choice([" ", " ", " ", "\t ", ", ", "\n", ". ", " !? ", "\v", " "]) for _ in range(m))
    rows = [(rng.choice(["en", "de", None, "und", "fr"]), rng.choice([text(30), text(3), text(80), "", None, "a b a b a b"])) for _ in range(400)]
    rows += [("en", " ".join(word() for _ in range(3000))), ("xx", "one two"), ("en", "a " * 500)]  # one piece, longer than shards
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"shard": F.lit(1), "words": F.lit("a"), "n": F.lit(2), "phrase": F.lit("p")})
    want = plain_collocations(rows, 40, 12)
    assert len({r[0] for r in want}) >= 4 and any(len(r[2].split()) == 5 for r in want)
    for shard in (1 << 20, 100, 7):
        assert sorted(tuple(r) for r in collocations(df, most=40, least=12, shard=shard).collect()) == want
    monkeypatch.setattr(module, "BROADCAST", 0)
    monkeypatch.setattr(module, "DEAL", 50)  # frequent first words are dealt
    assert sorted(tuple(r) for r in collocations(df, most=40, least=12, shard=100).collect()) == want
    assert collocations(df.limit(0)).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("en", ".")], "lang string, text string"), least=1).count() == 0


def test_rows_do_not_grow_with_the_frequent_words_of_a_shard(spark, monkeypatch):
    from merganser.llm import collocations as module
    from merganser.llm.common import Workspace

    rows = [("en", " ".join(f"w{i:03}" for i in range(400)))] * 5 + [("de", "x y. rare")] * 5 + [("fr", "rare")]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    packed, marked = [], []
    sums, write = module._frequent_sums, Workspace.write
    monkeypatch.setattr(module, "_frequent_sums", lambda rows, *rest: packed.append(rows) or sums(rows, *rest))
    monkeypatch.setattr(Workspace, "write", lambda self, df, name: (name == "frequent" and marked.append(df)) or write(self, df, name))
    found = []
    for most in (module.BROADCAST, 0):
        monkeypatch.setattr(module, "BROADCAST", most)
        _, phrases = module.frequent_phrases(df, Workspace(spark, "collocations"), 5)
        found.append(sorted(tuple(r) for r in phrases.collect()))
    assert found[0] == found[1] and sum(len(r[1].split()) == 2 for r in found[0]) == 400
    assert len(packed) == 6 and all(df.count() <= 9 for df in packed)  # 400 rare first words are 7 groups
    small, large = marked
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert "LeftOuter" in large._jdf.queryExecution().optimizedPlan().toString()
    content = lambda df: sorted((r.shard, sorted(tuple(x) for x in r.frequent)) for r in df.collect())
    assert [len(x[1]) for x in content(small)] == [len(x[1]) for x in content(large)] and len(content(small)) == 2  # the third has none


def test_scores_are_exact_beyond_64_bits(spark):
    from merganser.llm import collocations as module

    f = 3_037_000_500_123
    every = spark.createDataFrame([("en", "a b", 2, f), ("en", "a", 1, f + 7), ("en", "b", 1, f + 11)], "lang string, phrase string, size int, f long")
    sizes = spark.createDataFrame([("en", 9_007_199_254_740_993)], "lang string, n long")
    before = module.frequent_phrases
    module.frequent_phrases = lambda *a, **k: (sizes, every)
    try:
        got = module.collocations(every).first()
    finally:
        module.frequent_phrases = before
    assert got.score == 1000 * f * 9_007_199_254_740_993 // ((f + 7) * (f + 11))


def test_shingles_that_a_public_hash_takes_for_equal_stay_apart(spark):
    from merganser.llm import ngram_join
    from merganser.llm.hashing import shingles, tokens

    pair = ["quality matters", ":)74f+> knsxmej"]  # equal sums of word hashes without a key
    hashes, bounds = tokens([p.encode() for p in pair], ngram_join.TABLE)
    found, _ = shingles(hashes, bounds, 5)
    assert found[0] == found[1]
    rows = [(1, pair[0]), (2, pair[1]), (3, "QUALITY\tmatters "), (4, "a a a a a a a a"), (5, "a a a a a"), (6, "a a a a"), (7, None), (8, "")]
    rows += [(10 + k, f"{p} " + " ".join(f"w{j}" for j in range(4))) for k, p in enumerate(pair)]
    for key in (None, 0):
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), key=key).collect()}
        assert [got[i] for i in range(1, 9)] == [1, 2, 1, 4, 4, 6, 7, 8]
        assert key == 0 or (got[10], got[11]) == (10, 11)


def test_packed_phrases_are_summed_across_batches():
    rng = random.Random(12)
    kind = pa.int32()
    for case in range(30):
        rows, want = [], Counter()
        for _ in range(rng.randint(0, 40)):  # rows of a shard, first word and deal: the other words and popcounts
            first, deal = rng.randrange(4), rng.randrange(2)
            found = [(first, 2 * rng.randrange(5) + deal, rng.choice([-1, 7])) for _ in range(rng.randrange(6))]
            rows.append((first, deal, found, [rng.randint(0, 9) for _ in found]))
            for phrase, n in zip(found, rows[-1][3], strict=True):
                want[phrase] += n
        rows.sort(key=lambda r: r[:2])
        columns = [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind), *[pa.array([[p[i] for p in r[2]] for r in rows], pa.list_(kind)) for i in (1, 2)], pa.array([r[3] for r in rows], pa.list_(kind))]
        whole, at, batches = pa.RecordBatch.from_arrays(columns, ["first", "deal", "w2", "w3", "n"]), 0, []
        while at < len(rows):
            n = rng.randint(0, 5)
            batches.append(whole.slice(at, n))
            at += n
        got = [tuple(r.values()) for b in _sums(2, 8, kind)(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == sorted((*p, n) for p, n in want.items() if n >= 8), case
