"""Token-id files: independent zstandard frames, a document index, and a trailing seek table.

A shard is a row of zstandard frames of about ``frame_ids`` ids each; a document never spans two frames. Two skippable
frames end the shard, so that any zstandard reader still decodes the ids alone:

* the document index: a zstandard-compressed table of (document id int64, number of ids uint32, frame uint32) and, as
  first byte, the width of an id in bytes (2 where all ids fit, else 4);
* the seek table of the public seekable format: for each frame its compressed size, decompressed size and the low 32
  bits of the XXH64 of its content, then the number of frames, a descriptor (bit 7: checksums) and the magic number.

A reader fetches the tail, then only the frames that hold the requested documents, and verifies each one's checksum.

Shards hold documents in ascending id order (ties by content), a range of ids each; range partitioning includes the
text's hash, so a much repeated id is split. A task writes under a name of its own attempt and reports it in the
manifest, so repeated and speculative attempts cannot mix.

Defined results: a null text counts as empty and is the end id alone; null ids come first; repeated rows are written
each; an empty table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merganser.llm.common import Workspace, pieces
from merganser.llm.tokens import AT_ONCE, encoder

#: Fixed by the public seekable format and the skippable frames of zstandard.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEK_MAGIC = 0x184D2A5E, 0x184D2A51, 0x8F92EAB1
#: Stands for a null document id in the index.
NO_ID = -(1 << 63)
INDEX = np.dtype([("doc", "<i8"), ("n", "<u4"), ("frame", "<u4")])
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"


def filesystem(uri: str):
    """(pyarrow file system, path) of a path or URI in any store that pyarrow reaches."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class ShardWriter:
    def __init__(self, out, width: int, frame_ids: int, level: int = 1):
        self.out, self.width, self.frame_ids = out, width, frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.held_ids = self.tokens = self.size = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[np.ndarray] = []
        self.new: list[tuple[int, int, int]] = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, doc: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        n = len(ids) // 4
        if self.held and self.held_ids + n > self.frame_ids:
            self.flush()
        self.held.append(ids)
        self.new.append((NO_ID if doc is None else doc, n, len(self.frames)))
        self.held_ids += n
        self.tokens += n

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            raw = np.frombuffer(raw, "<u4").astype("<u2").tobytes() if self.width == 2 else raw
            packed = self.zstd.compress(raw)
            self._put(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.docs.append(np.array(self.new, INDEX))
            self.held, self.held_ids, self.new = [], 0, []

    def close(self) -> None:
        self.flush()
        index = np.concatenate(self.docs) if self.docs else np.empty(0, INDEX)
        body = bytes([self.width]) + self.zstd.compress(index.tobytes())
        body += struct.pack("<I", len(body))  # its own size at its end: readers come from behind
        self._put(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self._put(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.n_docs = len(index)


class ShardReader:
    """Over a seekable binary file."""

    def __init__(self, file):
        self.file = file
        file.seek(0, io.SEEK_END)
        size = file.tell()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("not a token shard: no seek table at its end")
        table = size - 9 - 12 * n
        self.frames = [struct.unpack("<III", e) for e in _cut(self._at(table, 12 * n), 12)]
        (index_size,) = struct.unpack("<I", self._at(table - 12, 4))
        body = self._at(table - 12 - index_size, index_size)
        self.width = body[0]
        self.zstd = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(self.zstd.decompress(body[1:]), INDEX)
        self.starts = np.concatenate([[0], np.cumsum([f[0] for f in self.frames], dtype=np.int64)])

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        """A frame's ids as little-endian unsigned 32-bit, after its checksum held."""
        packed, size, check = self.frames[k]
        raw = self.zstd.decompress(self._at(int(self.starts[k]), packed))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if self.width == 2 else raw

    def read(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(row in the index, ids) of all documents, or of those ids; other frames are not decompressed."""
        pick = np.ones(len(self.docs), bool) if wanted is None else np.isin(self.docs["doc"], list(wanted))
        first = np.searchsorted(self.docs["frame"], np.arange(len(self.frames)))
        before = np.concatenate([[0], np.cumsum(self.docs["n"], dtype=np.int64)])
        for k in np.unique(self.docs["frame"][pick]):
            data = self.frame(int(k))
            for i in np.flatnonzero(pick & (self.docs["frame"] == k)) if wanted is not None else range(first[k], first[k + 1] if k + 1 < len(first) else len(self.docs)):
                o = 4 * int(before[i] - before[first[k]])
                yield int(i), data[o : o + 4 * int(self.docs["n"][i])]


def _cut(data: bytes, n: int) -> list[bytes]:
    return [data[i : i + n] for i in range(0, len(data), n)]


def _written(id_col: str, text_col: str, vocabulary: str, spaces: str, end_id: int, folder: str, frame_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        enc, end = encoder(vocabulary, spaces), end_id.to_bytes(4, "little")
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id) <= 1 << 16 else 4
        writer = path = stream = None
        for batch in pieces(batches, text_col, AT_ONCE):
            if writer is None:
                store, path = filesystem(f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.tok")
                store.create_dir(path.rpartition("/")[0], recursive=True)
                stream = store.open_output_stream(path)
                writer = ShardWriter(stream, width, frame_ids)
            ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            for doc, got in zip(ids, enc.encode(texts), strict=True):
                writer.add(doc, got + end)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((task.partitionId(), pa.int32()), (path, pa.string()), (writer.n_docs, pa.int64()), (writer.tokens, pa.int64()), (writer.size, pa.int64()))], ["shard", "path", "n_docs", "n_tokens", "n_bytes"])

    return run


def write_token_files(df: DataFrame, folder: str, vocabulary: str, work: Workspace, id_col: str = "doc_id", text_col: str = "text", spaces: str = "kept", end_id: int = 0, frame_ids: int = 1 << 18) -> DataFrame:
    """Writes df's texts as shards below folder; returns the manifest, a row per shard."""
    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc", F.xxhash64("text"), "text"]
    placed = slim.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    manifest = work.write(placed.mapInArrow(_written("doc", "text", vocabulary, spaces, end_id, folder, frame_ids), MANIFEST), "manifest")
    _swept(folder, {r.path for r in manifest.select("path").collect()})  # a row per shard
    return manifest


def _swept(folder: str, named: set[str]) -> None:
    """Deletes files of attempts that the manifest doesn't name: failed or repeated ones."""
    from pyarrow import fs

    store, at = filesystem(folder)
    for info in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if info.path not in named:
            store.delete_file(info.path)


def _read(wanted: tuple[int, ...] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = filesystem(path)
                with store.open_input_file(at) as file:
                    reader = ShardReader(file)
                    docs, n = reader.docs["doc"], reader.docs["n"]
                    starts = base + np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                    rows, held = [], 0
                    for i, ids in reader.read(wanted):
                        rows.append((None if docs[i] == NO_ID else int(docs[i]), int(starts[i]), int(n[i]), ids))
                        held += len(ids)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return run


def read_token_files(spark: SparkSession, manifest: DataFrame, wanted: tuple[int, ...] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of all documents, or of the wanted ones.

    The manifest has a row per shard, so the driver can add up where each one starts.
    """
    shards = sorted(manifest.select("shard", "path", "n_tokens").collect())
    rows, base = [], 0
    for _, path, n in shards:
        rows.append((path, base))
        base += n
    source = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return source.mapInArrow(_read(wanted), "doc_id long, start long, n_tokens long, ids binary")
