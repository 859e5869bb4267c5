"""Each stage of the corpus pipeline on all that its predecessor kept, against plain versions."""

import random

import pytest

import corpus_pipeline
from stockline.llm import simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["".join(rng.choice(["an", "the", "ou", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(30, 120)) + (" vileword badword" if i % 10 == 0 else "") for i in range(200)]
    texts += [texts[1], texts[2] + " tail", None, "", "key password=b7db7aa4a5fcc78305ab " + prose(60)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose(50), None, None, None)]
    folder = str(tmp_path_factory.mktemp("shop"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 10 == 0)) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, shop):
    docs = spark.read.parquet(f"{shop}/documents.parquet")
    toxic = corpus_pipeline.toxicity(spark, docs, shop)
    left = toxic.collect()
    assert toxic.columns == COLUMNS
    assert not any("vileword" in (r.text or "") for r in left) and len(left) == docs.count() - 20
    kept = corpus_pipeline.simhash_near_dedup(spark, toxic, shop)
    first = {}
    codes = [(r.doc_id, simhash.fingerprint(r.text)) for r in left if r.doc_id is not None]
    group = {d: d for d, _ in codes}
    for _ in range(20):
        for a, x in codes:
            for b, y in codes:
                if bin(x ^ y).count("1") <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    first = sorted(d for d, g in group.items() if d == g)
    rows = kept.collect()
    assert kept.columns == COLUMNS and sorted(r.doc_id for r in rows if r.doc_id is not None) == first
    assert sum(r.doc_id is None for r in rows) == 1
    clean = corpus_pipeline.secret_scan(spark, kept, shop)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == COLUMNS and len(texts) == len(rows) and "b7db7aa4a5fcc78305ab" not in texts[204]
    mix = corpus_pipeline.mixing(spark, clean, shop)
    assert mix.columns == COLUMNS and mix.count() > 0
    packed = corpus_pipeline.best_fit_packing(spark, mix, shop)
    assert packed.where("piece = 0").count() == mix.count()


def test_empty_input(spark, shop):
    docs = spark.read.parquet(f"{shop}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, shop).count() == 0
