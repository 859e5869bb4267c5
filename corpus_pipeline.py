"""A corpus pipeline of five stages, each applying one operator of ``stockline.llm`` to all that its
predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet to the shared
folder and read again as the next stage's documents. All but the last return the columns of documents.
Every stage accepts nulls in any column, empty and very long texts, repeated rows and an empty table;
columns beyond those of documents are kept as they are.

1. toxicity: documents predicted toxic go. Null and empty texts are not toxic.
2. simhash_near_dedup: of each group of near copies the document with the smallest id stays; of rows with that
   same id, one. Unlike texts of one id both stay. Rows with a null id are in no group and stay.
3. secret_scan: every secret is replaced by a mark and n_chars recounted; no document goes.
4. mixing: each document stands floor(rate) times, and once more with the chance of the rest.
5. best_fit_packing: one row per piece of a document, with its sequence and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline.llm.bpe import vocabulary_path
from stockline.llm.mixing import mixed
from stockline.llm.packing import packed
from stockline.llm.queries import BYTE_BPE, WORD_BPE, label_domains
from stockline.llm.secrets import redacted
from stockline.llm.simhash import deduplicated
from stockline.llm.storage import crc_bucket, stored
from stockline.llm.toxicity import fit, score_column


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model learns as in the query of the operator."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    model = fit(rows, labels, crc_bucket("doc_id", 5) != 0)
    return docs.where(score_column(model)(F.col("text").cast("string")) < 0.5)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one whose id is the group's smallest."""
    return deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return redacted(docs, vocabulary_path(BYTE_BPE))


# Toxic documents have gone: the mix is over the two other domains.
STAGE_MIX = {"clean": 0.9, "junk": 0.1}


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix; the domains' classifier learns from those that are left and labelled."""
    return mixed(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), STAGE_MIX)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens."""
    return packed(docs, vocabulary_path(WORD_BPE), end_id=1)


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", simhash_near_dedup), ("secret_scan", secret_scan),
          ("mixing", mixing), ("best_fit_packing", best_fit_packing)]

# No stage but the last can be left to SQL: they fit models, hash shingles and search tokens. The tests run
# each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
