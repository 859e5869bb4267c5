"""Findings of the second review: each test fails on the code before its change."""

import random
import string
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stockline.llm import bpe, lm, mixing, quality, secrets


# ---- op10: the tree grows with the corpus

def plain_scores(rows, held, floor=2):
    """Scores by the tree in memory over all tokens at once."""
    split = [(i, (t or "").lower().split()) for i, t in rows]
    train = Counter(w for i, d in split if not held(i) for w in d)
    ends = sum(not held(i) for i, _ in split)
    n, v = sum(train.values()) + ends, len(train) + (ends > 0)
    once, twice = (sum(c == k for c in train.values()) for k in (1, 2))
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    names = sorted(w for w, c in train.items() if c >= floor)
    numbers = {w: k for k, w in enumerate(names)}
    counts = np.array([train[w] for w in names] + [ends], np.int64)
    tree = lm.Tree(numbers, counts, lm.root_probability(counts, n, v, discount))
    sizes = np.array([len(d) for _, d in split])
    tokens, starts = lm.with_ends(np.array([numbers.get(w, -1) for _, d in split for w in d]), sizes, tree.end)
    use = np.repeat([not held(i) for i, _ in split], sizes + 1)
    for _ in range(lm.DEPTH):
        keys, many = lm.candidates(tree, tokens, starts, use)
        lm.add_level(tree, keys[many >= floor], many[many >= floor])
        if not (many >= floor).any():
            break
    c = np.array([x for _, d in split for x in [*(train.get(w, 0) for w in d), ends]])
    p = lm.token_probabilities(tree, tokens, starts, lm.root_probability(c, n, v, discount))
    return dict(zip((i for i, _ in split), np.add.reduceat(np.log10(p), starts)))


def test_lm_tables_equal_the_tree_in_memory(spark, monkeypatch):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, " ".join(rng.choice(words[:rng.randint(2, 60)]) for _ in range(rng.randint(0, 60)))
             + (" " + passage if i % 5 == 0 else "") + (f" rare{i // 2}" if i % 3 else "")) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "never seen"), (1003, "w1")]
    held = lambda i: i % 10 == 0
    want = plain_scores(rows, held)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)     # many blocks
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.scored(docs, F.col("doc_id") % 10 == 0).collect()}
    assert got.keys() == want.keys()
    for i, score in want.items():
        assert abs(got[i] - score) < 1e-9 * max(1, abs(score)), i


def test_lm_learns_rare_passages_of_a_large_corpus(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    filler = "x " * 7000
    rows = [(i, filler) for i in range(300)] + [(1000 + i, passage) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.scored(docs, F.col("doc_id") == 1003).collect()}
    # 2.1 million tokens: a share of two in a million would ask for more than the passage's three occurrences.
    assert got[1003].train_tokens > 2_000_000 and got[1003].score > got[1003].base_score + 100


# ---- op8: rows of small groups have a distance

def test_quality_judges_small_groups(spark):
    rng = random.Random(31)
    words = ["".join(rng.choice(["an", "the", "ou", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(30, 200)))
    junk = lambda: " ".join(rng.choice(words) + "%%%&&&" for _ in range(100))
    schema = "doc_id long, text string, lang string, source string"
    rows = [(i, prose(), "en", f"s{i % 60}") for i in range(240)]               # no source has 40 rows
    rows += [(1000 + i, junk(), "en", f"s{i}") for i in range(10)]
    rows += [(2000 + i, prose(), "de", "t") for i in range(5)] + [(2010, junk(), "de", "u"), (2011, junk(), None, None)]
    rows += [(3000 + i, prose(), "fr", "large") for i in range(60)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.base_failed or r.distance is not None, i
        assert r.kept == (not (1000 <= i < 2000 or i in (2010, 2011))), i
    # A language without 40 rows in a table without 40 rows.
    few = quality.judged(spark.createDataFrame([r for r in rows if 2000 <= r[0] < 2011], schema)).collect()
    assert all(r.distance is not None for r in few) and [r.doc_id for r in few if not r.kept] == [2010]


# ---- op3: random pieces within paths, URLs and assignments; random letters

def test_secrets_inside_longer_runs():
    count = secrets.token_counter(bpe.vocabulary_path("byte_bpe_50k.tiktoken"))
    rng = random.Random(41)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    frames = [("/home/service/application/config/production/credentials/", alnum, 24, ""),
              ("//storage.example.com/container/reports/download/signature=", alnum, 32, ""),
              ("//storage.example.com/container/reports/download/", alnum, 32, "/latest/version/index.html"),
              ("", string.ascii_lowercase, 24, ""), ("", string.ascii_uppercase, 24, "")]
    for before, chars, n, after in frames:
        hits = 0
        for _ in range(100):
            secret = draw(chars, n)
            text = f"ä see {before}{secret}{after} now"
            at = text.index(secret)
            hits += any(s <= at and at + n <= e for _, s, e in secrets.find(text, count))
        assert hits >= 90, (before, chars, hits)
    # What a pattern's span leaves of a run is tested on its own.
    digits, secret = "0123456789abcdef0123", draw(string.ascii_uppercase + string.digits, 30)
    found = secrets.find(f"x {digits}/{secret} y", count)
    assert ("hex", 2, 22) in found and any(k == "random" and s <= 23 and e == 53 for k, s, e in found)
    for plain in ("/home/service/application/config/production/credentials/default.json",
                  "getUserAccountNameFromRequestContext", "internationalization_of_the_documentation",
                  "123e4567-e89b-12d3-a456-426614174000", "========================"):
        assert not [x for x in secrets.find(f"see {plain} now", count) if x[0] == "random"], plain


# ---- op5: a rare domain word is not lost among the corpus's words

def test_mixing_tells_words_of_a_small_space_apart(spark):
    letters = "abcdefghij"
    words = spark.range(100_000).select(F.translate(F.col("id").cast("string"), "0123456789", letters).alias("w"))
    pairs = words.select("w", F.hash("w").alias("h")).where("length(w) = 5").groupBy(F.pmod("h", F.lit(1 << 14))).agg(
        F.collect_list(F.struct("w", "h")).alias("x")).where("size(x) > 1").limit(50).collect()
    common, marker = next((a.w, b.w) for r in pairs for a in r.x for b in r.x if (a.h - b.h) % (1 << 16))
    texts = [f"filler of every text {common}" + (f" {marker}" if i % 4 == 0 else "") for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "junk" if i % 4 == 0 else "clean") for i in range(400)], "doc_id long, domain string")
    got = mixing.mixing_rates(docs, labelled, {"clean": 0.9, "junk": 0.1})
    assert all((r.p_junk > 0.9) == (r.doc_id % 4 == 0) for r in got.collect())
    # The weights are no literal of the plans.
    model = mixing.fit(docs.withColumnRenamed("doc_id", "id"), labelled, ["clean", "junk"])
    rows = mixing.memberships(docs, model)
    assert len(rows._jdf.queryExecution().toString()) < 50_000
