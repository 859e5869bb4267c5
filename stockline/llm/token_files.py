"""Token-id files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

Documents are range-partitioned and sorted by id; each task encodes its range in slices and writes

* ``part-K-A.ids``  the ids of its documents, one after the other (uint16 if the vocabulary fits, else
  uint32; little-endian), each document closed by the end id;
* ``part-K-A.off``  uint64 offsets into it, one more than documents;
* ``part-K-A.doc``  int64 document ids (and ``part-K-A.null``, one byte each: 1 if the id is null).

A is new for every attempt of a task, so no store ever has to replace a file; the attempt that succeeds returns
it, and the files of others are in no index. The parts' bases are the prefix sums of their token counts (one row per
part reaches the driver) and stand with their names in ``index.json``: a document's global start is its part's base
plus its offset.
"""

from __future__ import annotations

import json
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline.llm.bpe import WordEncoder, encoded_slices
from stockline.llm.files import mapped, replaced
from stockline.llm.storage import TEXT_ROWS, lean, partitions, rows_per_batch

PART = "part int, n_docs long, n_tokens long, dtype string, name string"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int,
                      text_col: str = "text", id_col: str = "doc_id", parts: int | None = None) -> list[dict]:
    """Encode and write every document in ascending id order; returns the index (one entry per part).

    A null text is empty (its document is the end id alone); null ids come first; rows with the same
    id are ordered by their text's hash and kept. An empty table gives an empty index. Extra columns
    are not read."""
    from pyspark import TaskContext

    def run(batches):
        encoder = WordEncoder(vocabulary)
        dtype = "<u2" if max(encoder.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        path = f"{folder}/{name}"
        ids_of, lengths = [], []
        with replaced(f"{path}.ids") as out:
            for batch in batches:
                ids_of.append(batch.column(0))
                for _, _, sizes, ids in encoded_slices(batch.column(1), encoder):
                    ends = np.cumsum(sizes + 1)
                    closed = np.full(int(ends[-1]), end_id, dtype)
                    inner = np.ones(len(closed), bool)
                    inner[ends - 1] = False
                    closed[inner] = ids
                    out.write(closed.tobytes())
                    lengths.append(sizes + 1)
        lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        keys = pa.chunked_array(ids_of, pa.int64())
        with replaced(f"{path}.off") as out:
            out.write(np.concatenate(([0], np.cumsum(lengths))).astype("<u8").tobytes())
        with replaced(f"{path}.doc") as out:
            out.write(keys.fill_null(0).to_numpy().astype("<i8").tobytes())
        with replaced(f"{path}.null") as out:
            out.write(keys.is_null().to_numpy().astype("u1").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [len(lengths)],
                                          "n_tokens": [int(lengths.sum())], "dtype": [dtype], "name": [name]})

    n = parts or partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "id", "tie").sortWithinPartitions(
        "id", "tie", "text")
    with rows_per_batch(docs.sparkSession, TEXT_ROWS):
        found = sorted(rows.select("id", "text").mapInArrow(lean(run), PART).collect())
    bases = accumulate((r.n_tokens for r in found), initial=0)
    index = [{**r.asDict(), "base": base} for r, base in zip(found, bases)]
    with replaced(f"{folder}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def read_token_files(spark: SparkSession, folder: str, index: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the memory-mapped files, one task a
    part. ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not index:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{folder}/{row['name']}"
                with mapped(f"{name}.ids", row["dtype"]) as ids, mapped(f"{name}.off", "<u8") as offsets, \
                        mapped(f"{name}.doc", "<i8") as docs, mapped(f"{name}.null", "u1") as null:
                    for lo in range(0, len(docs), 10_000):
                        at = np.asarray(offsets[lo:lo + 10_001]).astype(np.int64)
                        crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:])]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(np.asarray(docs[lo:lo + 10_000]), mask=null[lo:lo + 10_000] == 1),
                            "start": at[:-1] + row["base"], "n_tokens": np.diff(at),
                            "ids_crc32": pa.array(crc, pa.int64())})

    parts = spark.createDataFrame([(r["name"], r["base"], r["dtype"]) for r in index], "name string, base long, dtype string")
    # By ranges: a hash of the part would leave several to some tasks and none to others.
    return parts.repartitionByRange(len(index), "name").mapInArrow(run, schema)
