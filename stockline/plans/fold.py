"""Ordered conditional fold: changes of a balance, each accepted only if the balance does not fall below zero.

A refused change leaves the balance, so a later one may still fit; the outcome depends on the order and is no
running sum. Rows are cut into ranges of (group, order), a hot group into many. A group that begins in a range is
folded there from its own start. A range that begins inside a group needs the balance at its border: if that is at
least the range's need (its deepest running sum), every change is accepted and the balance moves by the sum, known
from one summary row a range. Only a range in which the balance binds is folded to learn its end, all groups'
next such ranges in one job. Then every range is folded in parallel from its border's balance. Python goes through
sorted Arrow batches and holds one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockline.session import scratch_path


def conditional_fold(df: DataFrame, group: str, order: list[str], change: str, start: str,
                     partitions: int | None = None) -> DataFrame:
    """``df`` with ``accepted`` (boolean) and ``balance`` (bigint, after the row), per ``group`` in ``order``.

    ``group`` is a non-null bigint; ``change`` and ``start`` (the same on all rows of a group) are integers, a NULL
    change is refused. Rows are written to the shared folder once, one folder a range, so that a later pass reads
    only the ranges it needs; at most one row a range and pass reaches the driver."""
    seen_schema = pa.schema([("range_no", pa.int32()), *((k, pa.int64()) for k in ("first", "last", "total", "need", "end"))])
    end_schema = pa.schema([("range_no", pa.int32()), ("end", pa.int64())])

    def in_order(rows: DataFrame) -> DataFrame:
        # Read back, a range's files may come in any order; Spark sorts them, so Python holds a batch at a time.
        return rows.repartition("_range").sortWithinPartitions("_range", "_at")

    def folded(batches: Iterator[pa.RecordBatch], entries: dict[int, int | None]):
        """Goes through rows sorted by range and place, holding one batch; yields each batch and, by row, its range, group,
        change, verdict and balance. A range's first group begins with its entry, if it has one."""
        range_no, held, balance = None, None, 0
        for batch in (b for b in batches if b.num_rows):
            ranges, groups, changes, starts = (batch.column(k).to_pylist() for k in ("_range", "_g", "_c", "_s"))
            if None in starts:
                raise ValueError(f"a fold needs a start for every {group}")
            flags, balances = [], []
            for r, g, c, s in zip(ranges, groups, changes, starts):
                if r != range_no or g != held:
                    entry = entries.get(r) if r != range_no else None
                    range_no, held, balance = r, g, s if entry is None else entry
                fits = c is not None and balance + c >= 0
                balance += c if fits else 0
                flags.append(fits)
                balances.append(balance)
            yield batch, ranges, groups, changes, flags, balances

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = None
        for _, ranges, groups, changes, _, balances in folded(batches, {}):
            done = []
            for r, g, c, balance in zip(ranges, groups, changes, balances):
                if row is None or r != row["range_no"]:
                    if row:
                        done.append(row)
                    row = {"range_no": r, "first": g, "total": 0, "need": 0}
                if g == row["first"]:
                    row["total"] += c or 0
                    row["need"] = max(row["need"], -row["total"])
                row["last"], row["end"] = g, balance
            if done:
                yield pa.RecordBatch.from_pylist(done, seen_schema)
        if row:
            yield pa.RecordBatch.from_pylist([row], seen_schema)

    ranged = df.withColumns({"_g": F.col(group).cast("bigint"), "_c": F.col(change).cast("bigint"), "_s": F.col(start).cast("bigint")})
    keys = ["_g", *order]
    ranged = (ranged.repartitionByRange(partitions, *keys) if partitions else ranged.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    ranged = ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    path = scratch_path(df.sparkSession, "fold")
    ranged.write.partitionBy("_range").parquet(path)
    schema = ranged.schema
    rows = df.sparkSession.read.schema(schema).parquet(path)
    slim = rows.select("_range", "_at", "_g", "_c", "_s")
    seen = sorted(in_order(slim).mapInArrow(
        summarize, "range_no int, first long, last long, total long, need long, end long").collect())

    known: dict[int, int | None] = {}      # range -> balance at its border; None: it begins a group
    ends: dict[int, int] = {}
    while True:
        asked = {}
        before = None
        for r in seen:
            if before is None or before.last != r.first:
                known[r.range_no] = None
                ends.setdefault(r.range_no, r.end)
            elif before.range_no in ends:
                entry = known[r.range_no] = ends[before.range_no]
                if r.first != r.last:
                    ends.setdefault(r.range_no, r.end)
                elif r.range_no not in ends:
                    if entry >= r.need:
                        ends[r.range_no] = entry + r.total
                    else:
                        asked[r.range_no] = entry
            before = r
        if not asked:
            break

        def learn(batches, asked=asked):
            end = None
            for _, ranges, _, _, _, balances in folded(batches, asked):
                done = [end] if end and end["range_no"] != ranges[0] else []
                done += [{"range_no": r, "end": e} for r, after, e in zip(ranges, ranges[1:], balances) if r != after]
                end = {"range_no": ranges[-1], "end": balances[-1]}
                if done:
                    yield pa.RecordBatch.from_pylist(done, end_schema)
            if end:
                yield pa.RecordBatch.from_pylist([end], end_schema)

        found = in_order(slim.where(F.col("_range").isin(list(asked)))).mapInArrow(learn, "range_no int, end long")
        ends.update({r.range_no: r.end for r in found.collect()})

    kept = [f for f in schema.fields if f.name in df.columns]
    columns = [f.name for f in kept]

    def finish(batches):
        for batch, _, _, _, flags, balances in folded(batches, known):
            yield pa.RecordBatch.from_arrays([*batch.select(columns).columns, pa.array(flags, pa.bool_()), pa.array(balances, pa.int64())],
                                             [*columns, "accepted", "balance"])

    return in_order(rows).mapInArrow(finish, T.StructType([*kept, T.StructField("accepted", T.BooleanType()),
                                                           T.StructField("balance", T.LongType())]))
