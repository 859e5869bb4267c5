"""op1: segments over general scores, and a model fitted as by hand."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockline.llm import storage, toxicity
from tests.llm.test_operators import brute_segments


def test_segments_of_general_scores_equal_the_definition():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([-0.1, -0.1 - rng.random(), rng.random() * 2 + 0.0123]) for _ in range(rng.randint(0, 40))]
        places = [i for i, s in enumerate(scores) if s > 0]
        before = [sum(scores[:i]) for i in places]
        got = toxicity.maximal_segments(places, [scores[i] for i in places], before=before)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]


def corpus(n=600):
    """Toxic texts with words of their own, clean texts with words of theirs, and many words of neither."""
    rng = random.Random(6)
    plain = [f"plain{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(15, 60))]
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["vile", "Vile!", "nasty", "foul"]) for _ in range(rng.randint(1, 4))]
            if i % 16 == 0:
                words.append("kind")
        else:
            words += rng.choices(["kind", "gentle", "plain0"], k=3)
        rows.append((i, " ".join(words)))
    return rows, {i: int(i % 4 == 0) for i, _ in rows}


def by_hand(rows, toxic):
    """Scores, lambda, K and the curve from the definitions, over Python dictionaries."""
    forms = {i: [toxicity.bare(w) for w in t.split()] for i, t in rows}
    bad = Counter(w for i, f in forms.items() if toxic[i] for w in set(f))
    good = Counter(w for i, f in forms.items() if not toxic[i] for w in set(f))
    n_bad, n_good = sum(bad.values()), sum(good.values())
    scores, share = {}, {}
    for w in bad.keys() | good.keys():
        prior = n_bad * (bad[w] + good[w]) / (n_bad + n_good)
        t, c = bad[w] + prior, good[w] + prior
        odds = math.log(t / (n_bad + n_bad - t)) - math.log(c / (n_good + n_bad - c))
        spread = math.sqrt(1 / t + 1 / c)
        share[w] = c / (n_bad + n_good)
        if abs(odds) >= toxicity.MIN_Z * spread:
            scores[w] = round(odds - spread if odds > 0 else min(toxicity.GAP, odds + spread), 3)
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        mean = sum(share[w] * math.exp(mid * scores.get(w, toxicity.GAP)) for w in share) + (
            1 - sum(share.values())) * math.exp(mid * toxicity.GAP)
        low, high = (mid, high) if mean < 1 else (low, mid)
    found = {i: [s for _, _, s in brute_segments([scores.get(w, toxicity.GAP) for w in f])] for i, f in forms.items()}
    clean = [i for i in forms if not toxic[i]]
    size = len(clean) / sum(len(forms[i]) * math.exp(-low * max(found[i], default=0.0)) for i in clean)
    evidence = {}
    for i, s in found.items():
        values = [low * x - math.log(size * len(forms[i])) for x in s or [0.0]]
        evidence[i] = max(values) + sum(max(0.0, v) for k, v in enumerate(values) if k != values.index(max(values)))
    return scores, low, size, evidence


def test_model_equals_the_definitions(spark):
    rows, toxic = corpus()
    docs = spark.createDataFrame(rows, "id long, text string")
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    scores, rate, size, evidence = by_hand(rows, toxic)
    model = toxicity.fit(docs, labels, F.lit(True))
    assert toxicity.read_lexicon(model.lexicon) == pytest.approx(scores, abs=1.1e-3)
    assert any(s < toxicity.GAP for s in scores.values()) and any(s > 0 for s in scores.values())
    assert model.rate == pytest.approx(rate, rel=1e-2) and model.size == pytest.approx(size, rel=1e-2)
    # The curve is the maximum of the (slightly damped) likelihood over evidence in quarter steps.
    x = np.array([round(max(-25.0, min(75.0, evidence[i])) * 4) / 4 for i in toxic])
    y = np.array([toxic[i] for i in toxic])

    def loss(a, b):
        z = a + b * x
        return float(np.sum(np.logaddexp(0, z) - y * z)) + 0.5e-2 * b * b

    best = loss(model.intercept, model.slope)
    for da, db in ((0.2, 0), (-0.2, 0), (0, 0.1), (0, -0.1)):
        assert loss(model.intercept + da, model.slope + db) > best - 0.05
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i in toxic:
        assert got[i] == pytest.approx(model.probability(evidence[i]), abs=0.03)


def test_every_significant_word_is_kept(spark):
    """No bound on the lexicon: a word's evidence counts, however many others have more."""
    rows = [(w, 30 + w % 7, 0) for w in range(70_000)] + [(70_000, 5, 0), (70_001, 0, 3_000_000)]
    counts = spark.createDataFrame(rows, "w long, n_toxic long, n_clean long").select(
        F.concat(F.lit("w"), "w").alias("word"), "n_toxic", "n_clean")
    n = counts.agg(F.sum("n_toxic"), F.sum("n_clean")).first()
    found = toxicity.lexicon(counts, n[0], n[1])
    want = {w for w, t, _ in rows if t >= 30}
    assert want <= {int(r.word[1:]) for r in found.where("score > 0").collect()}


def test_labels_of_one_class_or_without_toxic_words(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "a")], "doc_id long, text string")
    learned = storage.crc_bucket("doc_id", 5) >= 0
    for labels in ([(1, 0), (2, 0)], [(1, 1)], [(1, 1), (3, 0), (None, 1), (2, None)]):
        rows = spark.createDataFrame(labels, "doc_id long, toxic int")
        got = toxicity.toxicity(docs, rows, learned).collect()
        assert len(got) == 4 and len({r.score for r in got}) == 1
