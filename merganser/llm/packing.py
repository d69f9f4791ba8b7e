"""Best-fit packing of token pieces into sequences of a fixed length.

A document's ids and its end id are cut into pieces of ``length`` ids; only the last may be shorter. Whole pieces are
sequences of their own. The others are packed online in each partition by bounded-space best-fit: at most
``open_bins`` sequences are open, a bitset over free space finds the one with the least room that is enough, and when
none has room and all places are taken the fullest closes first; a piece that fills a sequence needs no place. The pieces of one batch of texts, a bounded look ahead, are
placed longest first. Memory is bounded by the open bins and the batch, and nothing is shuffled. Sequences are numbered
by partition, so only what a partition leaves open at its end is not filled.

Defined results: a null text counts as empty and is the end id alone. Rows that repeat an id are packed one by one.
Null ids are kept. An empty table gives no pieces. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.llm.common import pieces
from merganser.llm.tokens import AT_ONCE, encoder

OUT = "piece int, start long, length long, ids binary, sequence_id long, offset long"


class BoundedBestFit:
    """place(n) gives (bin, offset). Bit f of ``free`` is set while an open bin has room for f."""

    def __init__(self, length: int, open_bins: int, first: int = 0):
        self.length, self.most, self.next = length, open_bins, first
        self.free, self.open, self.at = 0, 0, [[] for _ in range(length + 1)]

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _pop(self, room: int) -> int:
        bins = self.at[room]
        found = bins.pop()
        if not bins:
            self.free &= ~(1 << room)
        self.open -= 1
        return found

    def place(self, n: int) -> tuple[int, int]:
        above = self.free >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            bin_id = self._pop(room)
        else:
            if self.open == self.most and n < self.length:  # the fullest closes
                self._pop((self.free & -self.free).bit_length() - 1)
            room, bin_id = self.length, self._new()
        left = room - n
        if left:
            self.at[left].append(bin_id)
            self.free |= 1 << left
            self.open += 1
        return bin_id, self.length - room


def _packed(id_col: str, text_col: str, vocabulary: str, spaces: str, end_id: int, length: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        bins = BoundedBestFit(length, open_bins, part << 36)
        enc, end, width = encoder(vocabulary, spaces), end_id.to_bytes(4, "little"), 4 * length
        for batch in pieces(batches, text_col, AT_ONCE):
            ids = batch.column(batch.schema.get_field_index(id_col))
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            rows, piece, size, data = [], [], [], []
            for i, got in enumerate(enc.encode(texts)):
                got += end
                for k in range(0, len(got), width):
                    cut = got[k : k + width]
                    rows.append(i)
                    piece.append(k // width)
                    size.append(len(cut) // 4)
                    data.append(cut)
            seq, offset = [0] * len(size), [0] * len(size)
            for k in sorted(range(len(size)), key=size.__getitem__, reverse=True):
                seq[k], offset[k] = bins.place(size[k])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array([p * length for p in piece], pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())],
                [id_col, "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    return run


def pack_best_fit(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", spaces: str = "dropped", end_id: int = 0, length: int = 2048, open_bins: int = 1024) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset."""
    slim = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return slim.mapInArrow(_packed(id_col, text_col, vocabulary, spaces, end_id, length, open_bins), f"`{id_col}` {slim.schema[0].dataType.simpleString()}, {OUT}")
