"""Rows of conversations as sorted streams of small groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.plans.ordered import running_totals


def grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of a stream sorted by its first ``keys`` columns; one group is held at a time."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            key = row[:keys]
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, k1, k2, bytes) of every turn: its place in its conversation from 1, by turn (null first),
    a 128-bit key of its role and text, and the UTF-8 bytes of its text; texts themselves go no further.

    Null roles and texts are empty. Turns of the same number stand in the order of their keys. Rows without a
    conv_id belong to no conversation and are left out; other columns are not read. Places are counted over ranges
    of (conversation, turn), so a conversation that holds a third of all rows is many tasks' work."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("k1"), F.xxhash64(F.lit(2), role, text).alias("k2"),
        F.octet_length(text).cast("long").alias("bytes"))
    return running_totals(rows, ["conv_id"], ["turn", "k1", "k2"], {"pos": None}).select("conv_id", "pos", "k1", "k2", "bytes")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, length) of :func:`numbered` turns."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("length"))
