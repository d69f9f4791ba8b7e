"""N-gram Jaccard join by T-occurrence search.

A document is the set of its distinct runs of ``n`` words. Two documents link when intersection / union reaches
``percent``. The join finds the connected components of all links and loses none:

1. Rarity. A scan hashes all shingles and deals them out by hash; each bucket counts in how many documents a shingle is.
   A shingle that a batch of documents holds more than once goes out once with its count, so one that a third of all
   documents share is a row per batch. Shingles of more than one document return to their batch with that count.
2. Documents of which too few shingles occur elsewhere cannot link. Of the others, documents with equal sets become
   one class. A class's prefix is its rarest shingles, as many as leave fewer than the required overlap behind:
   classes that link share one. Classes that share prefix shingles are put into a block.
3. In each block, T-occurrence search. The index holds leaders: a class joins the first leader it links with, else it
   becomes one. By the triangle inequality of the Jaccard distance, a class that links with a member of a leader
   reaches a lower overlap T with the leader itself. The leaders that reach T are found in the inverted lists as
   DivideSkip does it: the short lists are merged, by a heap or, if they are many and full, by one sort of all their entries,
   and the long ones are only probed by binary search, for the leaders that the short ones left within reach. Members are
   compared where they could connect two components.
4. A block of more shingles or classes than a task should hold is dealt into chunks that are searched one by one. Then only leaders
   are searched together; members of two leaders are compared only if these are still unconnected and near enough for their
   members to link, again by the triangle inequality.

Defined results: null texts, and texts without words, have an empty set and link with nothing, not even each other. A
document of fewer than n words has its whole sequence as only shingle. Rows that repeat an id are one node with several
sets, which connects all that these link with. Null ids give a row of their own, without a component, and take no part. An empty table gives an empty result. Other columns are
not read.

Shingles are compared by 64-bit hashes under a key that is drawn for each run, so that no texts can be made to collide. A document with one
shingle links with equal ones only: these are told by 128 bits of the shingle's bytes, under the key, and are never searched. A
larger set links falsely only if two of its shingles collide at once with two of one other set.

Batches are cut by the order of rows, so an input behind a shuffle, which a lost executor may bring in another order, is
written to the shared folder first.
"""

from __future__ import annotations

import heapq
import re
import secrets
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.llm.common import Workspace, pieces, settled
from merganser.llm.components import connected_components
from merganser.llm.hashing import U, classes, mix, shingles, tokens

TABLE = classes(b" \t\n\v\f\r")
WORD = re.compile(rb"[^ \t\n\v\f\r]+")
#: Shingles of one batch of documents; documents in it fit two bytes.
BATCH, BATCH_DOCS = 1_500_000, 60_000
#: Shingles, and classes, in a task of step 3.
BLOCK, BLOCK_CLASSES = 1_000_000, 1_000
#: Entries of short lists from which one sort merges them faster than a heap; and how much dearer than merging an entry it is
#: to probe a list, by which DivideSkip chooses what lists are long.
HEAP, PROBE = 500, 0.5

PARTS = "bucket int, batch long, a binary, b binary, c binary, d binary, e binary"
DOCS = "doc_id long, n long, class binary, shared binary, prefix binary"


def sets(texts: list[str | None], n: int, key: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, bounds = tokens([(t or "").encode().lower() for t in texts], TABLE, key)
    found, edges = shingles(hashes, bounds, n)
    out = []
    for i in range(len(texts)):
        own = np.sort(found[edges[i] : edges[i + 1]])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


def only_shingle(text: str, n: int, key: int) -> bytes:
    """128 bits of the bytes of a text's first shingle, which is its only one."""
    words = (m[0] for m in islice(WORD.finditer(text.encode().lower()), n))
    return blake2b(b" ".join(words), digest_size=16, key=key.to_bytes(8, "little")).digest()


def needed(n: int, percent: int) -> int:
    """The least overlap with any set that a set of n can link with."""
    return -(-n * percent // 100)


def _pack(sorted_hashes: np.ndarray) -> bytes:
    """Differences, byte planes apart: the upper planes are zeros, which any codec removes."""
    d = sorted_hashes.copy()
    d[1:] -= sorted_hashes[:-1]
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(U).ravel(), dtype=U)


def _dealt(n: int, buckets: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # a task that runs again cuts the same batches
        name = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        held: list[np.ndarray] = []
        single: dict[int, bytes] = {}
        total = 0
        edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(U)

        def rows() -> pa.RecordBatch:
            sizes = np.array([len(h) for h in held], np.int64)
            every = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint16), sizes)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            names = np.zeros((len(held), 2), U)
            for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                sums = np.concatenate([[U(0)], np.cumsum(mix(every ^ U(salt)), dtype=U)])
                names[:, k] = mix(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(U))
            for i, name_of in single.items():
                names[i] = np.frombuffer(name_of, U)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            again = every[1:] == every[:-1]
            many = np.concatenate([[False], again]) | np.concatenate([again, [False]]) if len(every) else np.zeros(0, bool)
            distinct, count = np.unique(every[many], return_counts=True)
            alone, who = every[~many], owner[~many]
            s_at, m_at = (np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in (alone, distinct))
            # hashed: the names of all tasks end in zeros
            out = [(int(mix(np.array([name], U))[0] % U(buckets)), name, np.array(ids, "<i8").tobytes(), sizes.astype("<u4").tobytes(), names.tobytes(), _pack(every[many]), owner[many].tobytes())]
            for k in range(buckets):
                s, m = slice(s_at[k], s_at[k + 1]), slice(m_at[k], m_at[k + 1])
                if s.start < s.stop or m.start < m.stop:
                    out.append((k, name, _pack(alone[s]), who[s].tobytes(), _pack(distinct[m]), count[m].astype("<u4").tobytes(), None))
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "batch", *"abcde"])

        for batch in pieces(batches):
            texts = batch.column(1).to_pylist()
            for doc, text, own in zip(batch.column(0).to_pylist(), texts, sets(texts, n, key), strict=True):
                if len(own) == 1:
                    single[len(ids)] = only_shingle(text, n, key)
                ids.append(doc)
                held.append(own)
                total += len(own)
                if total >= BATCH or len(ids) >= BATCH_DOCS:
                    yield rows()
                    ids, held, single, total, name = [], [], {}, 0, name + 1
        if ids:
            yield rows()

    return run


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _counted(table: pa.Table) -> pa.Table:
    """Of a bucket: each batch's shingles that more than one document holds, with the number of documents."""
    rows = list(zip(*[table.column(c).to_pylist() for c in ("batch", *"abcde")], strict=True))
    parts = [r for r in rows if r[5] is None]
    out = [(r[0], False, *r[1:]) for r in rows if r[5] is not None]
    single = [_unpack(r[1]) for r in parts]
    many = [_unpack(r[3]) for r in parts]
    if parts:
        distinct, where = np.unique(np.concatenate(single + many), return_inverse=True)
        weight = np.concatenate([np.ones(sum(map(len, single)), np.int64), *[np.frombuffer(r[4], "<u4").astype(np.int64) for r in parts]])
        count = np.bincount(where, weight, len(distinct)).astype(np.int64)[where]
        at_s, at_m = 0, sum(map(len, single))
        for r, s, m in zip(parts, single, many, strict=True):
            own, at_s = count[at_s : at_s + len(s)], at_s + len(s)
            of_many, at_m = count[at_m : at_m + len(m)], at_m + len(m)
            keep = own > 1
            if keep.any() or len(m):
                out.append((r[0], True, _pack(s[keep]), np.frombuffer(r[2], np.uint16)[keep].tobytes(), np.minimum(own[keep], 1 << 31).astype("<u4").tobytes(), _pack(m), np.minimum(of_many, 1 << 31).astype("<u4").tobytes()))
    return _table(out, ["batch", "part", *"abcde"], [pa.int64(), pa.bool_(), *[pa.binary()] * 5])


def _assembled(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of a batch: each document with its size, class, and, if it can link at all, shared shingles and prefix."""
        rows = list(zip(*[table.column(c).to_pylist() for c in ("part", *"abcde")], strict=True))
        own = next(r for r in rows if not r[0])
        parts = [r for r in rows if r[0]]
        ids, sizes, names = np.frombuffer(own[1], "<i8"), np.frombuffer(own[2], "<u4").astype(np.int64), np.frombuffer(own[3], "V16")
        local, local_doc = _unpack(own[4]), np.frombuffer(own[5], np.uint16)
        many = np.concatenate([np.empty(0, U), *[_unpack(r[4]) for r in parts]])
        many_n = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(r[5], "<u4").astype(np.int64) for r in parts]])
        order = np.argsort(many, kind="stable")
        many, many_n = many[order], many_n[order]
        h = np.concatenate([local, *[_unpack(r[1]) for r in parts]])
        doc = np.concatenate([local_doc, *[np.frombuffer(r[2], np.uint16) for r in parts]]).astype(np.int64)
        count = np.concatenate([many_n[np.searchsorted(many, local)] if len(local) else many_n[:0], *[np.frombuffer(r[3], "<u4").astype(np.int64) for r in parts]])
        order = np.lexsort((h, count, doc))
        h, doc = h[order], doc[order]
        bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
        out = []
        for i in range(len(ids)):
            size, shared = int(sizes[i]), h[bounds[i] : bounds[i + 1]]
            prefix = len(shared) - needed(size, percent) + 1  # rarest first, and none is rarer than those not shared
            some = size > 0 and prefix > 0
            if size == 1:  # links with equal sets only, and these are in its class
                shared = shared[:0]
            out.append((int(ids[i]), size, names[i].tobytes(), np.sort(shared).tobytes() if some else None, shared[:prefix].tobytes() if some else None))
        return _table(out, ["doc_id", "n", "class", "shared", "prefix"], [pa.int64(), pa.int64(), *[pa.binary()] * 3])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefixes = [np.frombuffer(p, "<i8") for p in batch.column(1).to_pylist()]
        sizes = [len(p) for p in prefixes]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes)), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes))], ["shingle", "rep"])


def divide_skip(lists: list, t: int) -> dict[int, int]:
    """Occurrences of every number that at least t of the ascending lists (or arrays of "i") hold (t > 0)."""
    lists = sorted(lists, key=len)
    if len(lists) < t:
        return {}
    # the more lists are probed, the fewer occurrences the merge may ask for
    aside = min(t - 1, int(t / (PROBE * np.log(max(2, len(lists[-1]))) + 1))) if lists else 0
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    if sum(map(len, short)) > HEAP:
        return _sorted_skip(short, long, t)
    out: dict[int, int] = {}
    last, n = None, 0
    for x in heapq.merge(*short):
        if x == last:
            n += 1
        else:
            if last is not None and n >= t - aside:
                out[last] = n
            last, n = x, 1
    if last is not None and n >= t - aside:
        out[last] = n
    for x in list(out):
        n = out[x]
        for k, values in enumerate(long):
            at = bisect_left(values, x)
            n += at < len(values) and values[at] == x
            if n + len(long) - k - 1 < t:
                break
        if n >= t:
            out[x] = n
        else:
            del out[x]
    return out


def _sorted_skip(short: list, long: list, t: int) -> dict[int, int]:
    """The same of many entries: numbers that the short lists leave within reach are looked up in all long ones at once."""
    found, n = np.unique(np.concatenate([np.asarray(x, np.int32) for x in short]), return_counts=True)
    for k in range(len(long) + 1):
        within = n + len(long) - k >= t
        if not within.all():
            found, n = found[within], n[within]
        if k == len(long) or not len(found):
            break
        values = np.asarray(long[k], np.int32)
        at = np.searchsorted(values, found)
        at[at == len(values)] = 0
        n = n + (values[at] == found)
    return dict(zip(found.tolist(), n.tolist(), strict=True))


def link(size_a: int, size_b: int, overlap: int, percent: int) -> bool:
    return 100 * overlap >= percent * (size_a + size_b - overlap)


class Union:
    """Connected places of a list; the root of each has the least rep."""

    def __init__(self, reps: list[int]):
        self.reps, self.root = reps, list(range(len(reps)))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            low, high = (i, j) if self.reps[i] < self.reps[j] else (j, i)
            self.root[high] = low


def by_size(reps: list[int], sizes: list[int], shared: list[np.ndarray]) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Small first; numbers in the inverted lists then ascend."""
    order = sorted(range(len(reps)), key=lambda k: (sizes[k], reps[k]))
    return [reps[k] for k in order], [sizes[k] for k in order], [shared[k] for k in order]


def grouped(reps: list[int], sizes: list[int], shared: list[np.ndarray], percent: int) -> list[tuple[int, int, int]]:
    """(rep, least rep it is connected with, its leader) of all reps of a block, by T-occurrence search over leaders."""
    reps, sizes, shared = by_size(reps, sizes, shared)
    sets = Union(reps)
    # a link with a member is at most 1 - percent/100 from it, and it at most as much from its leader
    reach = max(1, 2 * percent - 100)
    index: dict[int, array] = {}
    members: dict[int, list[tuple[int, float]]] = {}
    leader = list(range(len(reps)))
    for i in range(len(reps)):
        own = shared[i].tolist()
        near = divide_skip([index[h] for h in own if h in index], max(1, needed(sizes[i], reach)))
        best, best_at = 0.0, -1
        distance: dict[int, float] = {}
        for p, overlap in near.items():
            j = overlap / (sizes[i] + sizes[p] - overlap)
            distance[p] = 1 - j
            if link(sizes[i], sizes[p], overlap, percent):
                sets.join(i, p)
                if j > best:
                    best, best_at = j, p
        for p, d in distance.items():
            if sets.find(p) == sets.find(i):
                continue
            for m, dm in members[p]:
                if abs(d - dm) <= 1 - percent / 100 + 1e-9 and link(sizes[i], sizes[m], len(np.intersect1d(shared[i], shared[m], assume_unique=True)), percent):
                    sets.join(i, m)
                    break
        if best_at >= 0:
            members[best_at].append((i, 1 - best))
            leader[i] = best_at
        else:
            members[i] = []
            for h in own:
                index.setdefault(h, array("i")).append(i)
    return [(reps[i], reps[sets.find(i)], reps[leader[i]]) for i in range(len(reps))]


def near_leaders(reps: list[int], sizes: list[int], shared: list[np.ndarray], percent: int) -> list[tuple[int, int, bool]]:
    """(rep, rep, linked) of leaders: enough links to connect those that links connect, and all pairs of others that are as
    near as leaders of two linked members can be."""
    reps, sizes, shared = by_size(reps, sizes, shared)
    sets = Union(reps)
    reach = max(1, 3 * percent - 200)
    index: dict[int, array] = {}
    out, open_ = [], []
    for i in range(len(reps)):
        own = shared[i].tolist()
        for p, overlap in divide_skip([index[h] for h in own if h in index], max(1, needed(sizes[i], reach))).items():
            if sets.find(p) == sets.find(i):
                continue
            if link(sizes[i], sizes[p], overlap, percent):
                sets.join(i, p)
                out.append((reps[p], reps[i], True))
            elif link(sizes[i], sizes[p], overlap, reach):
                open_.append((p, i))
        for h in own:
            index.setdefault(h, array("i")).append(i)
    return out + [(reps[p], reps[i], False) for p, i in open_ if sets.find(p) != sets.find(i)]


def any_link(sizes: list[int], shared: list[np.ndarray], side: list[bool], percent: int) -> bool:
    """Does a set of one side link with one of the other?"""
    index: dict[int, array] = {}
    for i in range(len(sizes)):
        if side[i]:
            for h in shared[i].tolist():
                index.setdefault(h, array("i")).append(i)
    for i in range(len(sizes)):
        if not side[i]:
            found = divide_skip([index[h] for h in shared[i].tolist() if h in index], max(1, needed(sizes[i], percent)))
            if any(link(sizes[i], sizes[p], overlap, percent) for p, overlap in found.items()):
                return True
    return False


def _by_task(keys: int, work, names: list[str], kinds: list[pa.DataType]):
    """Goes through rows sorted by task, the first ``keys`` columns; one task's rows are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready = None, [], []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != row[:keys]:
                    ready += work(key, held) if held else []
                    key, held = row[:keys], []
                held.append(row[keys:])
            if len(ready) > 5000:
                yield _table(ready, names, kinds).combine_chunks().to_batches()[0]
                ready = []
        ready += work(key, held) if held else []
        if ready:
            yield _table(ready, names, kinds).combine_chunks().to_batches()[0]

    return run


def _arrays(held: list[tuple]) -> tuple[list[int], list[int], list[np.ndarray]]:
    return [r[0] for r in held], [r[1] for r in held], [np.frombuffer(r[2], U) for r in held]


def _groups(percent: int):
    def work(key: tuple, held: list[tuple]) -> list[tuple]:
        """key: block, chunk, whether there are others. Of a block that is whole only the links are told."""
        return [(key[0], key[2], *row) for row in grouped(*_arrays(held), percent) if key[2] or row[0] != row[1]]

    return _by_task(3, work, ["block", "large", "rep", "root", "leader"], [pa.int64(), pa.bool_(), *[pa.int64()] * 3])


def _near(percent: int):
    return _by_task(3, lambda key, held: near_leaders(*_arrays(held), percent), ["a", "b", "linked"], [pa.int64(), pa.int64(), pa.bool_()])


def _across(percent: int):
    def work(key: tuple, held: list[tuple]) -> list[tuple]:
        _, sizes, shared = _arrays(held)
        return [(key[0], key[1])] if any_link(sizes, shared, [r[3] for r in held], percent) else []

    return _by_task(4, work, ["a", "b"], [pa.int64(), pa.int64()])


def _tasks(df: DataFrame, *keys: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def _chunks(column: str = "shared"):
    """Into how many parts a group has to be dealt so that two of them fit a task."""
    return F.greatest(F.ceil(F.sum(F.length(column) / 8) / (BLOCK // 2)), F.ceil(F.count("*") / (BLOCK_CLASSES // 2)))


def _large_blocks(found: DataFrame, placed: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """(node, root) of all linked classes, with the links that connect what the chunks of large blocks left apart.

    Leaders of all chunks are searched together; if they outgrow a task, too, in pairs of chunks. Where leaders stay unconnected but
    are near enough for members to link, the members are compared across, dealt out by size.
    """
    everyone = found.filter("large").select("rep", "leader").join(placed.select("block", "rep", "n", "shared"), "rep")
    everyone = work.write(everyone, "large")
    leads = everyone.filter("rep = leader").drop("leader")
    load = leads.groupBy("block").agg(_chunks().alias("chunks")).withColumn("chunks", F.when(F.col("chunks") <= 2, 1).otherwise(F.col("chunks")))
    dealt = (
        leads.join(load, "block")
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")))
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "n", "shared")
    )
    near = work.write(_tasks(dealt, "block", "i", "j").mapInArrow(_near(percent), "a long, b long, linked boolean").distinct(), "near")
    links = found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(near.filter("linked").select("a", "b"))
    roots = connected_components(links, work, "leaders")
    ra, rb = (roots.select(F.col("node").alias(f"n{x}"), F.col("root").alias(f"r{x}")) for x in "ab")
    apart = near.filter("not linked").join(ra, F.col("a") == F.col("na"), "left").join(rb, F.col("b") == F.col("nb"), "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    apart = work.write(apart, "apart")
    if not apart.limit(1).count():
        return roots
    parts = everyone.groupBy("leader").agg(_chunks().alias("parts"))
    pa_, pb = (parts.select(F.col("leader").alias(x), F.greatest("parts", F.lit(1)).alias(f"p{x}")) for x in "ab")
    sized = apart.join(pa_, "a").join(pb, "b")
    side = lambda x, own, other: (
        sized.join(everyone.drop("block"), F.col(x) == F.col("leader"))
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col(f"p{x}")))
        .withColumn("other", F.explode(F.expr(f"sequence(0, p{'b' if x == 'a' else 'a'} - 1)")))
        .select("a", "b", F.col(own).alias("i"), F.col(other).alias("j"), "rep", "n", "shared", F.lit(x == "a").alias("first"))
    )
    rows = side("a", "own", "other").unionByName(side("b", "other", "own"))
    across = _tasks(rows, "a", "b", "i", "j").mapInArrow(_across(percent), "a long, b long")
    return connected_components(links.unionByName(across), work, "linked")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, work: Workspace | None = None, key: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id that is reachable by links) for every row of docs."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "ngram-join")
    key = secrets.randbits(64) if key is None else key
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    slim = settled(slim, work, "input")
    real = slim.filter("doc_id is not null")
    buckets = max(16, 4 * real.rdd.getNumPartitions())
    counted = real.mapInArrow(_dealt(n, buckets, key), PARTS).groupBy("bucket").applyInArrow(_counted, "batch long, part boolean, a binary, b binary, c binary, d binary, e binary")
    every = work.write(counted.groupBy("batch").applyInArrow(_assembled(percent), DOCS), "sets")
    groups = work.write(every.filter("shared is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("shared").alias("shared"), F.first("prefix").alias("prefix")), "classes")

    postings = groups.select("rep", "prefix").mapInArrow(_postings, "shingle long, rep long")
    hubs = postings.groupBy("shingle").agg(F.min("rep").alias("hub"), F.max("rep").alias("other")).filter("hub < other").drop("other")
    near = postings.join(hubs, "shingle").filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    blocks = connected_components(near, work, "blocks")
    placed = groups.join(blocks, groups["rep"] == blocks["node"], "left").select(F.coalesce("root", "rep").alias("block"), "rep", "n", "shared")
    load = placed.groupBy("block").agg(F.count("*").alias("k"), _chunks().alias("chunks")).filter("k > 1").drop("k")
    load = work.write(load.withColumn("chunks", F.when(F.col("chunks") <= 2, 1).otherwise(F.col("chunks"))), "load")
    dealt = placed.join(load, "block").select("block", F.pmod(F.xxhash64("rep"), F.col("chunks")).alias("chunk"), (F.col("chunks") > 1).alias("large"), "rep", "n", "shared")
    found = work.write(_tasks(dealt, "block", "chunk", "large").mapInArrow(_groups(percent), "block long, large boolean, rep long, root long, leader long"), "found")
    if load.filter("chunks > 1").limit(1).count():
        linked_reps = _large_blocks(found, placed, percent, work)
    else:
        linked_reps = found.select(F.col("rep").alias("node"), "root")
    several = every.groupBy("doc_id").agg(F.min(F.xxhash64("class")).alias("x"), F.max(F.xxhash64("class")).alias("y")).filter("x <> y").select(F.col("doc_id").alias("of"))
    several = work.write(several, "several")
    if several.limit(1).count():  # one node with several sets: its own, and those of their classes
        own = every.filter("shared is not null").join(several, F.col("doc_id") == F.col("of"), "left_semi").select("doc_id", F.col("class").alias("c"))
        own = own.join(groups.select("class", "rep"), F.col("c") == F.col("class")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        linked_reps = connected_components(linked_reps.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(own), work, "nodes")
    named = groups.select("class", "rep").join(linked_reps, F.col("rep") == F.col("node"), "left").select(F.col("class").alias("of"), F.coalesce("root", "rep").alias("root"))
    found = every.join(named, every["class"] == named["of"], "left").select("doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
    if several.limit(1).count():  # rows of such an id whose sets link with nothing
        nodes = linked_reps.select(F.col("node").alias("own"), F.col("root").alias("own_root"))
        found = found.join(nodes, F.col("doc_id") == F.col("own"), "left").select("doc_id", "n", F.least("root", F.coalesce("own_root", "root")).alias("root"))
    rows = found.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))
    return rows.unionByName(_without_id(slim, n))


def _without_id(slim: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes = [len(s) for s in sets(batch.column(1).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.nulls(len(sizes), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return slim.filter("doc_id is null").mapInArrow(run, "doc_id long, n_shingles long, component_id long")
