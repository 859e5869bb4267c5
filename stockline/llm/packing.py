"""Bounded-space online best-fit packing of token pieces into fixed-length sequences.

Documents are encoded in the scan's tasks; only documents longer than a sequence are cut, into
sequence-long pieces (the last may be shorter). The compact piece table (no text, no ids) is written
once and dealt out evenly; each task packs its stream of pieces with a fixed number of open bins:

* the open bins stand in a bitset keyed by free space (bit f is set if a bin with f free tokens is
  open), so the best fit for a piece of length n is the lowest set bit from n on;
* a piece that fits nowhere opens a bin; beyond the fixed number, the fullest bin closes first.

Memory per task is the open bins, whatever the number of pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.bpe import WordEncoder, encoded_slices
from stockline.llm.storage import TEXT_ROWS, lean, rows_per_batch, stored

CAPACITY = 4096
OPEN_BINS = 1024
PIECES_PER_TASK = 40_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Online best-fit with at most ``open_bins`` open bins. ``place`` returns (bin number, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0                                    # bitset of the open bins' free space
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        at = self.bins[space]
        number = at.pop()
        if not at:
            self.free &= ~(1 << space)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)   # the fullest closes
            space, number = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.capacity - space


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY,
           text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pieces of every document: its ids and the end id, cut only if longer than ``capacity``."""

    def run(batches):
        encoder = WordEncoder(vocabulary)
        for batch in batches:
            keys = batch.column(0)
            for lo, hi, sizes, ids in encoded_slices(batch.column(1), encoder):
                ids = ids.astype("<u4")
                ends = np.cumsum(sizes)
                count = sizes // capacity + 1            # pieces of sizes + 1 tokens
                row = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, (sizes + 1)[row] - start)
                end = np.array([end_id], "<u4").tobytes()
                crc = []
                for r, s, n in zip(row.tolist(), start.tolist(), length.tolist()):
                    a = ends[r] - sizes[r] + s
                    last = s + n > sizes[r]
                    data = ids[a:a + n - last].tobytes()
                    crc.append(zlib.crc32(data + end if last else data))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start),
                     pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
                       ).mapInArrow(lean(run), PIECES)


def pack(table: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``table`` (columns of :data:`PIECES`, 1 <= length <= capacity) with sequence_id and offset.

    Pieces arrive in the order of a hash of (doc_id, piece, start, ids_crc32), so a repeated task packs alike;
    equal rows are interchangeable."""
    from pyspark import TaskContext

    def run(batches):
        bins = BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = [bins.place(n) for n in batch.column(3).to_pylist()]
            number, offset = zip(*at) if at else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(5)), pa.array([base + x for x in number], pa.int64()),
                 pa.array(offset, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    tasks = max(1, -(-table.count() // pieces_per_task))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = table.select(*names).repartition(tasks).withColumn("turn", F.xxhash64("doc_id", "piece", "start", "ids_crc32"))
    return dealt.sortWithinPartitions("turn", *names).select(*names).mapInArrow(
        run, PIECES + ", sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY,
           open_bins: int = OPEN_BINS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is one piece holding the end id. Null ids stay null; repeated rows are
    packed once each. An empty table gives an empty result. Extra columns are not read."""
    with rows_per_batch(docs.sparkSession, TEXT_ROWS):
        table = stored(pieces(docs, vocabulary, end_id, capacity, text_col, id_col), "pieces")
    return pack(table, capacity, open_bins)
