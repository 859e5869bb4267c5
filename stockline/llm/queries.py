"""Registered queries of this package: one ``opN_<name>`` per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline.llm.bpe import vocabulary_path
from stockline.llm.storage import crc_bucket
from stockline.session import scratch_path

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stockline.llm.toxicity import toxicity
    learned = crc_bucket("doc_id", 5) != 0
    found = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learned)
    return found.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted",
                        F.size("passages").cast("long").alias("n_passages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stockline.llm.simhash import near_duplicates
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stockline.llm.secrets import digest_columns, scan
    return digest_columns(scan(_table(spark, sf_dir, "documents"), vocabulary_path(BYTE_BPE)))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stockline.llm.embeddings import near_duplicates
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


MIX = {"clean": 0.85, "junk": 0.1, "toxic": 0.05}


def label_domains(labels: DataFrame) -> DataFrame:
    """The labelled table's domains: toxic, else junk (quality 0), else clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(
        F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stockline.llm.mixing import mixing_rates
    return mixing_rates(_table(spark, sf_dir, "documents"), label_domains(_table(spark, sf_dir, "labels")), MIX)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stockline.llm.token_counts import token_counts
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary_path(PIECES))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stockline.llm.token_files import read_token_files, write_token_files
    folder = scratch_path(spark, "token-files")
    index = write_token_files(_table(spark, sf_dir, "documents"), folder, vocabulary_path(WORD_BPE), end_id=2)
    return read_token_files(spark, folder, index)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stockline.llm.quality import judged
    return judged(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stockline.llm.packing import packed
    return packed(_table(spark, sf_dir, "documents"), vocabulary_path(WORD_BPE), end_id=1)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stockline.llm.lm import scored
    return scored(_table(spark, sf_dir, "documents"), crc_bucket("doc_id", 10) == 0)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stockline.llm.pii import digest_columns, scan
    return digest_columns(scan(_table(spark, sf_dir, "documents")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stockline.llm.conversations import numbered
    from stockline.llm.trie import prefix_trie, rebuilt
    return prefix_trie(*rebuilt(numbered(_table(spark, sf_dir, "conversations"))))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stockline.llm.repair import damaged, repairs
    return repairs(damaged(_table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run
    return run(spark, sf_dir)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_toxicity, op2_simhash_near_dedup, op3_secret_scan, op4_embedding_near_dedup, op5_mixing,
        op6_token_counts, op7_token_files, op8_quality_rules, op9_best_fit_packing, op10_lm_scoring,
        op11_pii, op12_conversation_trie, op13_conversation_repair, pipeline)}


# The other operators fit models, hash shingles or run tokenizers: SQL cannot express them, and tests/llm
# compares them with brute-force versions.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


# crc32 of the decimal id, bit by bit. Paths are kept as digests of the turns up to them.
TRIE_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
n AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS origin, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)),
      lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT n.conv_id, o.i AS d, o.role, o.text FROM n JOIN o ON o.conv_id = n.origin AND o.i <= n.h
  UNION ALL
  SELECT n.conv_id, o.i - n.h + least(n.h, coalesce(b.n, 0)), o.role, o.text
  FROM n JOIN o ON o.conv_id = n.conv_id AND o.i > n.h LEFT JOIN n b ON b.conv_id = n.origin),
p AS (
  SELECT conv_id, 0 AS d, '' AS path, 0 AS size FROM n
  UNION ALL
  SELECT conv_id, d, md5(string_agg(md5(role) || md5(text), ',' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)), strlen(text) FROM r),
e AS (SELECT *, lead(path) OVER w IS NULL AS ends, lag(path) OVER w AS parent FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
v AS (
  SELECT path, min(parent) AS parent, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM e GROUP BY path),
k AS (SELECT parent AS path, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY parent),
s AS (
  SELECT e.path, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved_tokens
  FROM v LEFT JOIN k ON k.path = v.path JOIN e ON e.conv_id = v.conv_id AND e.d <= v.depth GROUP BY e.path)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v LEFT JOIN k ON k.path = v.path LEFT JOIN s ON s.path = v.path LEFT JOIN v u ON u.path = v.parent
"""


def all_sql() -> dict[str, str]:
    return {"op4_embedding_near_dedup": EMBEDDING_SQL, "op12_conversation_trie": TRIE_SQL}
