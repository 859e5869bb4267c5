"""Hot groups and repeated tasks: no task holds a hot source, no attempt replaces another's files."""

import os

from pyspark.sql import functions as F

from stockline.llm import bpe, quality, token_files
from stockline.session import scratch_path


def plain_joins(spark):
    """Sort-merge joins over fixed partitions, whatever the size of the fixture; returns what undoes it."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    return lambda: [spark.conf.set(k, v) for k, v in before.items()]


def test_a_source_with_most_rows_is_no_task_of_its_own(spark):
    undo = plain_joins(spark)
    try:
        rows = spark.range(9000).select(F.when(F.col("id") < 6000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 30)).alias("g"),
                                        *[(F.rand(k) + F.col("id") % 3).alias(x) for k, x in enumerate(quality.X)])
        groups = rows.groupBy("g").agg(*[F.avg(x).alias(f"m_{i}") for i, x in enumerate(quality.X)],
                                       *[F.lit(float(i == j)).alias(f"l_{i}_{j}") for i in range(4) for j in range(i + 1)])
        found = quality._distances(rows, groups)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 9000 and max(sizes) < 3000
        assert found.where("d2 is null").count() == 0
    finally:
        undo()


def test_slices_change_no_verdict(spark):
    texts = [(i, " ".join(f"word{(i * k) % 97}" for k in range(1, 40 + i % 60)) + (" %$#" * 80 if i % 50 == 49 else ""), "en",
              "hot" if i % 3 else f"s{i % 2}") for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    many = {r.doc_id: (r.kept, round(r.distance, 6)) for r in quality.judged(docs).collect()}
    slices, quality.SLICES = quality.SLICES, 1
    try:
        one = {r.doc_id: (r.kept, round(r.distance, 6)) for r in quality.judged(docs).collect()}
    finally:
        quality.SLICES = slices
    assert many == one and len(many) == 600


def test_two_attempts_of_token_files_replace_nothing(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    folder = scratch_path(spark, "token-files")
    first = token_files.write_token_files(docs, folder, bpe.vocabulary_path(), 2, parts=5)
    files = {f: os.stat(f"{folder.removeprefix('file:')}/{f}").st_mtime_ns for f in os.listdir(folder.removeprefix("file:"))}
    second = token_files.write_token_files(docs, folder, bpe.vocabulary_path(), 2, parts=5)
    assert not {r["name"] for r in first} & {r["name"] for r in second}
    kept = {f for f in files if f.startswith("part-")}
    assert len(kept) == 20
    assert all(os.stat(f"{folder.removeprefix('file:')}/{f}").st_mtime_ns == files[f] for f in kept)
    rows = [sorted(token_files.read_token_files(spark, folder, index).collect()) for index in (first, second)]
    assert rows[0] == rows[1] and len(rows[0]) == 50
    read = token_files.read_token_files(spark, folder, first)
    per_task = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
    assert sorted(per_task) == sorted(r["n_docs"] for r in first)
