"""Phrases that recur, by position bitmaps in the manner of SPAM, and how much their words attract each other.

Documents are cut into shards of one language. A shard is a line of positions, one for each word, with an empty position
between pieces, so no phrase crosses a piece. A word's bitmap is compressed: only blocks of 16 positions that hold a bit
are kept, as (block, mask). Moving a phrase's bitmap by one position and ANDing it with the bitmaps of the words in the
same blocks gives the bitmaps of all its extensions, and their popcounts are how often they occur in the shard; phrases
grow depth-first. Popcounts are summed over the shards: a shard gives one row for each group of first words, with the words and the
popcounts in arrays side by side, and these rows, not one for each phrase, are shuffled and sorted by that group; the arrays are summed where
they arrive, batch by batch, and only frequent phrases become rows. Rare first words are 64 a group, others alone; one with more than 4 million
occurrences is dealt by its phrases, so no group is larger than a few times that.

A phrase can only be frequent if all that it contains is, so four passes over the shards follow each other: words, pairs of frequent
words, phrases of three words whose pairs are frequent, and longer phrases all of whose threes are frequent. At most 500,000 frequent words, pairs
or threes are broadcast, and looked up shard by shard; more are joined with what the shards hold. A piece that is longer than a shard goes on in the
next one, which repeats its last words as context: phrases that end in the context are not counted again.

Defined results: a null text is empty, a null language is ``und``; rows without an id and repeated rows count like
others; languages without a frequent phrase give no rows, and so does an empty table; ties are broken by the phrase's
bytes; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merganser.llm.common import Workspace, pieces, release

#: Words, and what stands between pieces. Everything that is neither separates words.
TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]+")
BREAKS = frozenset(b".,;:!?\n\v\f\r")
#: Words of a shard, and words that all open shards of a task hold at most.
SHARD, OPEN = 1 << 20, 1 << 22
#: Positions of a block, and blocks that are ANDed at once.
BITS, AT_ONCE = 16, 1 << 16
#: Rows of frequent words or pairs that a join may broadcast.
BROADCAST = 500_000
#: Phrases that a packed row holds at most.
WIDE = 1 << 12
#: Occurrences of first words that one group of their phrases may hold, and rare first words of a group.
DEAL, SHARE = 1 << 22, 64
#: Odd multiplier that mixes the words of a phrase.
MIX = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"
SHARDS = "shard long, lang string, words array<string>, counts array<int>, context int, ids binary"
OF_SHARD = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("context", pa.int32()), ("ids", pa.binary())])


def _packed(ids: np.ndarray) -> bytes:
    """Byte by byte plane, so that the upper bytes, nearly all alike, take no room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


class _Numbers(dict):
    """Words numbered in the order of their first occurrence; what breaks pieces is -1."""

    def __missing__(self, token: bytes) -> int:
        n = self[token] = -1 if token[0] in BREAKS else len(self.words)
        if n >= 0:
            self.words.append(token)
        return n

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []


class _Shard:
    def __init__(self, lang: str, longest: int):
        self.lang, self.longest = lang, longest
        self.numbers, self.ids, self.context = _Numbers(), array("i"), 0

    def close(self, number: int) -> pa.RecordBatch:
        """The shard as a row. If it ends within a piece, the piece's last words open the next shard."""
        ids = np.frombuffer(self.ids, np.int32)
        own = ids[self.context :]
        counts = np.bincount(own[own >= 0], minlength=len(self.numbers.words)).astype(np.int32)
        words = [w.decode("utf-8", "replace") for w in self.numbers.words]
        row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((number, self.lang, words, counts, self.context, _packed(ids)), OF_SHARD.types, strict=True)], schema=OF_SHARD)
        tail = []
        for w in reversed(self.ids[-(self.longest - 1) :]):
            if w < 0:
                break
            tail.append(self.numbers.words[w])
        del ids, own
        self.numbers, self.ids, self.context = _Numbers(), array("i"), len(tail)
        self.ids.extend(map(self.numbers.__getitem__, reversed(tail)))
        return row


def _sharded(longest: int, shard: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId() << 32, 0
        shards: dict[str, _Shard] = {}
        for batch in pieces(batches):
            langs = batch.column(0).to_pylist()
            for lang, text in zip(langs, batch.column(1).cast(pa.binary()), strict=True):
                if lang not in shards:
                    shards[lang] = _Shard(lang, longest)
                s = shards[lang]
                tokens = TOKEN.findall((text.as_py() or b"").lower())
                for i in range(0, len(tokens), shard):
                    s.ids.extend(map(s.numbers.__getitem__, tokens[i : i + shard]))
                    if len(s.ids) >= shard:
                        yield s.close(part + made)
                        made += 1
                s.ids.append(-1)
            if sum(len(s.ids) for s in shards.values()) > most:
                for lang in sorted(shards, key=lambda x: len(shards[x].ids), reverse=True)[: 1 + len(shards) // 2]:
                    yield shards.pop(lang).close(part + made)
                    made += 1
        for s in shards.values():
            if len(s.ids) > s.context:
                yield s.close(part + made)
                made += 1
        release()

    return run


class Bitmaps:
    """The words of a shard as compressed bitmaps, listed by word and by block."""

    def __init__(self, ids: np.ndarray, keep: np.ndarray, context: int):
        at = np.flatnonzero(keep[ids] & (ids >= 0)) if len(ids) else np.zeros(0, np.int64)
        word, block, bit = ids[at].astype(np.int64), at // BITS, np.uint32(1) << (at % BITS).astype(np.uint32)
        order = np.lexsort((block, word))
        word, block, bit = word[order], block[order], bit[order]
        first = np.flatnonzero(np.append(True, (np.diff(word) != 0) | (np.diff(block) != 0))[: len(word)])
        self.word, self.block = word[first], block[first]
        self.mask = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        self.by_block = np.argsort(self.block, kind="stable")
        self.starts = np.searchsorted(self.block[self.by_block], np.arange(int(self.block.max(initial=-1)) + 3))
        #: which bits of a block count: those of the context don't
        self.own = lambda block: np.where(block * BITS >= context, 0xFFFF, (0xFFFF << np.clip(context - block * BITS, 0, BITS)) & 0xFFFF).astype(np.uint32)

    def shifted(self, tag: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bitmaps one position on; a bit that leaves its block enters the next."""
        over = np.flatnonzero(mask >> (BITS - 1))
        stay = (mask << 1) & 0xFFFF
        kept = np.flatnonzero(stay)
        return np.concatenate([tag[kept], tag[over]]), np.concatenate([block[kept], block[over] + 1]), np.concatenate([stay[kept], np.ones(len(over), np.uint32)])

    def extended(self, tag: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tag, word, block, mask) of each bitmap moved by one and ANDed with every word's; a block may come twice."""
        tag, block, mask = self.shifted(tag, block, mask)
        inside = np.flatnonzero(block + 1 < len(self.starts))
        tag, block, mask = tag[inside], block[inside], mask[inside]
        low, size = self.starts[block], self.starts[block + 1] - self.starts[block]
        row = np.repeat(np.arange(len(tag)), size)
        entry = self.by_block[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]]
        both = mask[row] & self.mask[entry]
        found = np.flatnonzero(both)
        row, entry = row[found], entry[found]
        return tag[row], self.word[entry], block[row], both[found]

    def pairs(self, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, popcount) of all pairs of words."""
        keys, counts = [], []
        for i in range(0, len(self.word), AT_ONCE):
            a, b, block, mask = self.extended(self.word[i : i + AT_ONCE], self.block[i : i + AT_ONCE], self.mask[i : i + AT_ONCE])
            key, at = np.unique(a * n_words + b, return_inverse=True)
            keys.append(key)
            counts.append(np.bincount(at, np.bitwise_count(mask & self.own(block)), len(key)))
        if not keys:
            return (np.zeros(0, np.int64),) * 3
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)
        return key // n_words, key % n_words, total  # 0: in the context only, but a longer phrase may begin there

    def phrases(self, follow: np.ndarray, n_words: int, shortest: int, longest: int, threes: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, a row a phrase, and popcounts) of phrases of ``shortest`` to ``longest`` words, all of whose pairs a * n_words + b
        are in ``follow``, and all of whose threes (place of the first pair in ``follow`` * n_words + c) in ``threes``; both are sorted.
        Phrases grow depth-first, many neighbours in the tree at a time."""
        among = lambda keys, key: keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
        stack = [(np.arange(n_words, dtype=np.int32)[:, None], self.word, self.block, self.mask)]
        while stack:
            phrase, tag, block, mask = stack.pop()
            if len(tag) > AT_ONCE:  # those of the second half wait, whole bitmaps only
                at = int(np.searchsorted(tag, tag[len(tag) // 2]))
                at = at or int(np.searchsorted(tag, tag[0], "right"))
                if at < len(tag):
                    stack += [(phrase, tag[at:], block[at:], mask[at:]), (phrase, tag[:at], block[:at], mask[:at])]
                    continue
            tag, word, block, mask = self.extended(tag, block, mask)
            key = phrase[tag, -1].astype(np.int64) * n_words + word
            kept = np.flatnonzero(among(follow, key))
            if threes is not None and phrase.shape[1] >= 2:
                last = phrase[tag[kept], -2].astype(np.int64) * n_words + phrase[tag[kept], -1]
                kept = kept[among(threes, np.searchsorted(follow, last) * n_words + word[kept])]
            key = tag[kept].astype(np.int64) * n_words + word[kept]
            order = np.argsort(key, kind="stable")
            key, kept = key[order], kept[order]
            block, mask = block[kept], mask[kept]
            starts = np.flatnonzero(np.append(True, np.diff(key) != 0)[: len(key)])
            if not len(starts):
                continue
            longer = np.concatenate([phrase[key[starts] // n_words], (key[starts] % n_words).astype(np.int32)[:, None]], 1)
            if longer.shape[1] >= shortest:
                n = np.add.reduceat(np.bitwise_count(mask & self.own(block)), starts, dtype=np.int64)
                yield longer, n  # 0: in the context only, but a longer phrase may begin there
            if longer.shape[1] < longest:
                stack.append((longer, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key)))), block, mask))


def _marked(known):
    """(shard, its frequent words) by a broadcast table sorted by lang, and the rows of each lang in it: no row for each word of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows_of = known.value
        for batch in batches:
            for i, lang in enumerate(batch.column(1).to_pylist()):
                own = table.slice(*rows_of.get(lang, (0, 0))).combine_chunks()
                words = batch.column(2).slice(i, 1).flatten()
                found = pc.index_in(words, value_set=own["word"].combine_chunks().cast(words.type))
                at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                if len(at):
                    entry = own.take(found.drop_null())
                    columns = [pa.array(at, pa.int32()), *(entry[c].combine_chunks() for c in ("id", "deals", "grp"))]
                    frequent = pa.StructArray.from_arrays(columns, ["w", "id", "deals", "grp"])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), frequent)], ["shard", "frequent"])
        release()

    return run


def _opened(table: pa.Table) -> tuple[Bitmaps, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's bitmaps of frequent words; the number in the whole corpus of each word of the shard (-1: not frequent), its group as a first word, and its deals."""
    row = table.slice(0, 1).combine_chunks()
    numbers = np.full(row["n_words"][0].as_py(), -1, np.int64)
    groups, deals = np.zeros(len(numbers), np.int64), np.ones(len(numbers), np.uint64)
    frequent = row["frequent"].chunk(0).flatten()
    at = frequent.field("w").to_numpy()
    numbers[at], groups[at], deals[at] = (frequent.field(c).to_numpy() for c in ("id", "grp", "deals"))
    return Bitmaps(_unpacked(row["ids"][0].as_py()), numbers >= 0, row["context"][0].as_py()), numbers, groups, deals


def _by_group(words: list[np.ndarray], groups: np.ndarray, deals: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.Table:
    """Phrases, a column for each of their words, as rows of one group of first words and deal: the words and n in sorted arrays of a bounded length."""
    mixed = np.zeros(len(n), np.uint64)
    for column in words[1:]:
        mixed = (mixed ^ column.astype(np.uint64)) * MIX
        mixed ^= mixed >> np.uint64(32)
    deal = (mixed % deals).astype(np.int32)
    order = np.lexsort((*words[::-1], deal, groups))
    group, deal = groups[order], deal[order]
    starts = np.flatnonzero(np.append(True, (np.diff(group) != 0) | (np.diff(deal) != 0))[: len(group)])
    within = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    starts = np.flatnonzero(within % WIDE == 0)
    ends = pa.array(np.append(starts, len(group)), pa.int32())
    lists = {f"w{i}": pa.ListArray.from_arrays(ends, pa.array(column[order], kind)) for i, column in enumerate(words, 1)}
    return pa.table({"grp": pa.array(group[starts], kind), "deal": deal[starts], **lists, "n": pa.ListArray.from_arrays(ends, pa.array(n[order], pa.int32()))})


def _pairs(kind: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        maps, numbers, groups, deals = _opened(table)
        a, b, n = maps.pairs(len(numbers))
        rows = _by_group([numbers[a], numbers[b]], groups[a], deals[a], n, kind)
        return rows.add_column(0, "shard", pa.array([table["shard"][0].as_py()] * len(rows), pa.int64()))

    return run


def _local(numbers: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Phrases, a column for each of their words, in the numbers of a shard; those that it lacks a word of are left out."""
    order = np.argsort(numbers)
    found = [order[np.minimum(np.searchsorted(numbers, x, sorter=order), len(order) - 1)] for x in columns]
    here = np.logical_and.reduce([numbers[x] == y for x, y in zip(found, columns, strict=True)])
    return [x[here].astype(np.int64) for x in found]


def _longer(shortest: int, longest: int, kind: pa.DataType, *known):
    """known: the frequent pairs and, for more than three words, threes: broadcast columns, or the name of the shard's own list.
    Shorter phrases are filled up with -1."""

    def run(table: pa.Table) -> pa.Table:
        maps, numbers, groups, deals = _opened(table)
        lists = []
        for some in known:
            own = table[some].slice(0, 1).combine_chunks().flatten() if isinstance(some, str) else None
            lists.append(_local(numbers, [own.field(i).to_numpy() for i in range(own.type.num_fields)] if own is not None else some.value))
        follow = np.sort(lists[0][0] * len(numbers) + lists[0][1])
        threes = None
        if len(lists) > 1 and len(follow):
            a, b, c = lists[1]
            place = np.minimum(np.searchsorted(follow, a * len(numbers) + b), len(follow) - 1)
            here = follow[place] == a * len(numbers) + b
            threes = np.sort(place[here] * len(numbers) + c[here])
        words, counts = [np.zeros((0, longest), np.int32)], [np.zeros(0, np.int64)]
        for phrase, n in maps.phrases(follow, len(numbers), shortest, longest, threes) if len(follow) and (threes is None or len(threes)) else ():
            words.append(np.pad(phrase, ((0, 0), (0, longest - phrase.shape[1])), constant_values=-1))
            counts.append(n)
        found = np.concatenate(words)
        named = np.append(numbers, -1)[found]  # the last entry stands for no word
        rows = _by_group(list(named.T), groups[found[:, 0]], deals[found[:, 0]], np.concatenate(counts), kind)
        return rows.add_column(0, "shard", pa.array([table["shard"][0].as_py()] * len(rows), pa.int64()))

    return run


def _sums(columns: int, least: int, kind: pa.DataType):
    """Rows of _by_group(), sorted by group (the first column) and deal, to (group, the words in ``columns`` arrays, f) of phrases with f >= least.

    A batch is unpacked and summed at once; its last group is held, as sums, until the next batch shows whether it goes on.
    """

    def summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        starts = np.flatnonzero(np.append(True, np.logical_or.reduce([np.diff(k) != 0 for k in keys])))
        return [k[starts] for k in keys], np.add.reduceat(n[order], starts)

    def frequent(keys: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = np.flatnonzero(n >= least)
        if len(kept):
            words = [pa.array(k[kept], kind) for i, k in enumerate(keys) if i != 1]
            yield pa.RecordBatch.from_arrays([*words, pa.array(n[kept], pa.int64())], ["first", *(f"w{i}" for i in range(2, columns + 2)), "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            if not sizes.sum():
                continue
            keys = [np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1)] + [batch.column(i).flatten().to_numpy() for i in range(2, columns + 2)]
            n = batch.column(columns + 2).flatten().to_numpy().astype(np.int64)
            if held:
                keys, n = [np.concatenate(x) for x in zip(held[0], keys, strict=True)], np.concatenate([held[1], n])
            keys, n = summed(keys, n)
            at = int(np.flatnonzero((keys[0] == keys[0][-1]) & (keys[1] == keys[1][-1]))[0])
            yield from frequent([k[:at] for k in keys], n[:at])
            held = [k[at:].copy() for k in keys], n[at:].copy()
        if held:
            yield from frequent(*held)
        release()

    return run


def _frequent_sums(packed: DataFrame, columns: list[str], least: int, kind: pa.DataType, number: str) -> DataFrame:
    """(columns, f): rows of a shard and group of first words brought together by that group, unpacked and summed there."""
    rows = packed.select("grp", "deal", *columns, "n").repartition("grp", "deal").sortWithinPartitions("grp", "deal")
    summed = rows.mapInArrow(_sums(len(columns), least, kind), f"first {number}, {', '.join(f'w{i} {number}' for i in range(2, len(columns) + 2))}, f long")
    return summed.toDF("grp", *columns, "f").drop("grp")


def _numbered(words: DataFrame, work: Workspace) -> DataFrame:
    """words with a dense id: places within the parts of the written table, after the sizes of the parts before (a row a part)."""
    rows = work.write(words.withColumn("at", F.monotonically_increasing_id()), "counted")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    sizes = rows.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    return work.write(rows.join(F.broadcast(before), "part").select("lang", "word", "f", place.alias("id")), "words")


def _frequent_of(shards: DataFrame, local: DataFrame, words: DataFrame, number: str) -> DataFrame:
    """(shard, frequent: its frequent words with their numbers, deals and groups); shards without any are left out."""
    alone = F.col("f") * SHARE > DEAL
    grp = F.when(alone, -1 - F.col("id")).otherwise(F.expr(f"id div {SHARE}"))
    known = words.select("lang", "word", F.col("id").cast(number), F.ceil(F.col("f") / DEAL).alias("deals"), grp.cast(number).alias("grp"))
    if words.count() <= BROADCAST:
        table = known.toArrow().sort_by("lang").combine_chunks()
        langs = table["lang"].to_pylist()
        ends = [i for i in range(1, len(langs) + 1) if i == len(langs) or langs[i] != langs[i - 1]]
        rows_of = {langs[i]: (i, j - i) for i, j in zip([0, *ends], ends, strict=False)}
        frequent = shards.sparkSession.sparkContext.broadcast((table.drop_columns("lang"), rows_of))
        return shards.select("shard", "lang", "words").mapInArrow(_marked(frequent), f"shard long, frequent array<struct<w: int, id: {number}, deals: long, grp: {number}>>")
    # a left join makes a row for each word of a shard, whatever part of them is frequent
    own = F.when(F.col("id").isNotNull(), F.struct("w", "id", "deals", "grp"))
    return local.join(known, ["lang", "word"], "left").groupBy("shard").agg(F.collect_list(own).alias("frequent")).filter(F.size("frequent") > 0)


def _bounded(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it has at most BROADCAST rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def frequent_phrases(df: DataFrame, work: Workspace, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text", shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, n) with n all word occurrences, and (lang, phrase, size, f) of all phrases of 1 to ``longest`` words with f >= least."""
    slim = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    shards = work.write(slim.mapInArrow(_sharded(longest, shard, max(OPEN, shard)), SHARDS), "shards")
    local = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("w", "at")).select("shard", "lang", "w", F.col("at.words").alias("word"), F.col("at.counts").alias("n"))
    sizes = shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    words = _numbered(local.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), work)
    kind, number = (pa.int32(), "int") if words.count() < 1 << 31 else (pa.int64(), "long")
    of_shard = _frequent_of(shards, local, words, number)
    opened = shards.select("shard", "context", "ids", F.size("words").alias("n_words")).join(work.write(of_shard, "frequent"), "shard")
    w = [f"w{i}" for i in range(1, longest + 1)]
    pairs = opened.groupBy("shard").applyInArrow(_pairs(kind), f"shard long, grp {number}, deal int, w1 array<{number}>, w2 array<{number}>, n array<int>")
    two = work.write(_frequent_sums(pairs, ["w1", "w2"], least, kind, number), "pairs")

    def reach(opened: DataFrame, packed: DataFrame, frequent: DataFrame, name: str):
        """How shards learn which of their phrases are frequent: (opened, what ``_longer`` takes)."""
        columns = frequent.columns[:-1]
        if frequent.count() <= BROADCAST:
            found = frequent.toArrow()
            return opened, df.sparkSession.sparkContext.broadcast([found[c].to_numpy() for c in columns])
        single = packed.select("shard", F.inline(F.arrays_zip(*columns)))
        own = single.join(frequent.select(*columns), columns).groupBy("shard").agg(F.collect_list(F.struct(*columns)).alias(name))
        return opened.join(own, "shard"), name

    def grown(opened: DataFrame, shortest: int, longest: int, *known) -> DataFrame:
        arrays = ", ".join(f"{c} array<{number}>" for c in w[:longest])
        return opened.groupBy("shard").applyInArrow(_longer(shortest, longest, kind, *known), f"shard long, grp {number}, deal int, {arrays}, n array<int>")

    frequent = [two]
    if longest >= 3:
        opened, by_pair = reach(opened, pairs, two, "pairs")
        packed = grown(opened, 3, 3, by_pair)
        three = work.write(_frequent_sums(packed, w[:3], least, kind, number), "threes")
        frequent.append(three)
    if longest >= 4:
        opened, by_three = reach(opened, packed, three, "threes")
        frequent.append(_frequent_sums(grown(opened, 4, longest, by_pair, by_three), w, least, kind, number))
    ids = [x.select(F.filter(F.array(*x.columns[:-1]), lambda w: w >= 0).alias("ids"), "f") for x in frequent]
    more = work.write(reduce(DataFrame.unionByName, ids), "numbered")
    named = more.select("ids", "f", F.posexplode("ids").alias("i", "id")).join(_bounded(words.select("lang", "word", "id")), "id").groupBy("ids", "f").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", "word"))).alias("at"))
    every = words.select("lang", F.col("word").alias("phrase"), "f").unionByName(named.select("lang", F.array_join("at.word", " ").alias("phrase"), "f"))
    return work.write(sizes, "sizes"), work.write(every.withColumn("size", F.size(F.split("phrase", " "))), "phrases")


def collocations(df: DataFrame, most: int = 2000, least: int = 100, longest: int = 5, cover: int = 100, work: Workspace | None = None, shard: int = SHARD, **columns: str) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is the least over its cuts into two parts of floor(1000 * a * n / (l * r)), in exact arithmetic. Phrases inside
    a longer frequent one with ``100 * f >= cover * a`` are left out.
    """
    work = work or Workspace(df.sparkSession, "collocations")
    sizes, every = frequent_phrases(df, work, least, longest, shard=shard, **columns)
    some = every.filter("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    part = lambda i, n: F.array_join(F.slice("words", i, n), " ")
    inner = (
        some.filter("size >= 3")
        .select("lang", "a", "size", words.alias("words"))
        .withColumn("m", F.explode(F.expr("sequence(2, size - 1)")))
        .withColumn("i", F.explode(F.expr("sequence(1, size - m + 1)")))
        .groupBy("lang", part(F.col("i"), F.col("m")).alias("phrase"))
        .agg(F.max("a").alias("longer"))
    )
    kept = some.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    cuts = (
        kept.select("lang", "phrase", "size", "a", words.alias("words"))
        .withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
        .select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size")).alias("right"))
    )
    left, right = (every.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)) for side, f in (("left", "l"), ("right", "r")))
    # 38 digits hold a thousand times a * n up to 10^35 and l * r; the quotient is below 10 * n, so it fits a long
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(cast({wide('a')} * {wide('n')} as decimal(35,0)) * cast(1000 as decimal(4,0))) div ({wide('l')} * {wide('r')})")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(sizes, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language of a third of all phrases is ranked in parts first, so that one task gets few of them
    dealt = best.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= most).drop("deal")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
