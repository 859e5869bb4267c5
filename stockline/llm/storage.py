"""Intermediate tables in the cluster's shared folder.

A table written here is read again by every executor and survives the loss of any of them; it also
cuts the lineage, so no later failure repeats the work before it. The folder is the one named by
``spark.checkpoint.dir`` (see :func:`stockline.session.checkpoint_root`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline.session import scratch_path


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to a fresh shared path, in a folder for each value of ``by``, and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`stored` that nothing reads any more."""
    path = getattr(df, "_stored_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(doc_id, modulus: int):
    """crc32 of the decimal text of an id, modulo ``modulus`` (the contracts' train / held-out split).
    A null id has no remainder; it counts as held out (0)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


TEXT_ROWS = 2000     # whole texts handed to Python at a time: some megabytes


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` (batches to batches) that gives Arrow's unused memory back at its end: the Python worker lives on
    and takes later tasks beside the executor's own memory."""
    def leaned(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
    return leaned


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Within it, jobs hand at most so many rows at a time to Python: for rows of several megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def bytes_per_batch(spark: SparkSession, size: int):
    """Within it, jobs hand about so many bytes at a time to Python: few rows of several megabytes, many of a few bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within it, the files of a job's shuffles go when it ends: for long rows of jobs that each write a table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def smallest_hashes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows of smallest hash of a unique ``key``. A first cut at a hash that about twice as many rows stay
    below keeps what reaches the last task in proportion to ``most``, however many tasks there are."""
    mark = F.xxhash64(key)
    n = rows.count()
    if n > 4 * most:
        rows = rows.where(mark < F.lit(int(-2**63 + 2**64 * (2 * most / n))))
    return rows.orderBy(mark, key).limit(most)
