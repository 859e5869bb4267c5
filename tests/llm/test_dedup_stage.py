"""The near-dedup stage on rows of one id with unlike texts, on clashing column names, and run twice."""

import random

import corpus_pipeline


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "the", "ou", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_unlike_texts_of_one_id_and_clashing_columns(spark):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(1, a, "x", 1), (1, b, "y", 2), (1, b, "z", 3), (2, a, "x", 4), (3, c, "x", 5), (4, b, "x", 6), (None, c, "x", 7),
            (5, None, "x", 8), (6, "", "x", 9), (0, c, "x", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _first string, _times int").selectExpr(
        "*", "_first as own", "_times as mark", "_times as component", "_first as id", "_times as `odd name`")
    runs = [sorted((tuple(r) for r in corpus_pipeline.simhash_near_dedup(spark, docs.repartition(n), "").collect()), key=str) for n in (1, 5)]
    assert runs[0] == runs[1]
    got = sorted(((r[0], r[1]) for r in runs[0]), key=str)
    # 1 stands for a (with 2) and for b (with 4); 0 for c (with 3); 5 and 6 are both empty.
    assert got == sorted([(1, a), (1, b), (0, c), (5, None), (None, c)], key=str)
    assert corpus_pipeline.simhash_near_dedup(spark, docs, "").columns == docs.columns


def test_id_on_unlike_texts_joins_no_groups(spark):
    from stockline.llm.simhash import near_duplicates
    a, b = prose(1), prose(2)
    rows = near_duplicates(spark.createDataFrame([(5, a), (7, a), (7, b), (9, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(5, 5), (7, 5), (7, 7), (9, 7)]
