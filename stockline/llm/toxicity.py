"""Toxicity: maximum-scoring segments over token log-odds, with extreme-value calibration.

1. Token scores: log-odds of a word in toxic against clean labelled documents with an informative
   Dirichlet prior (pseudo-counts in proportion to the word's share of all words, of the size of the
   toxic class), counted once per document. Words whose log-odds are significant form the lexicon;
   each scores its log-odds, one standard deviation nearer to zero: toxic words above zero, clean words
   below it (``GAP`` at most). A word without evidence scores ``GAP``, so that such a text drifts downwards.
2. Segments: a linear-time scan finds all maximal-scoring segments of the whole text.
3. Calibration: under clean text a segment's score exceeds s with about K n exp(-lambda s) expected
   cases in n words. Lambda solves E[exp(lambda score)] = 1 over clean words; K is the maximum-likelihood
   value over the clean labelled documents. A passage is significant if that expectation is at most
   ``MAX_EXPECTED``. The document's evidence is the calibrated score of its best segment plus the
   positive calibrated scores of the others; a logistic curve fitted on the labelled documents turns it
   into the probability of label 1.

Labels are learned from a bounded sample: the ``train_docs`` labelled documents with the smallest id hashes
(all of them, below that number), whose ids may therefore be broadcast. The lexicon holds every significant
word of the sample, a table in the shared folder that tasks read; the driver sees sums over equal scores
alone. Every document is scored over its whole text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.files import store_at
from stockline.llm.storage import drop_stored, lean, smallest_hashes, stored
from stockline.llm.words import encoded_words, slices

TRAIN_DOCS = 200_000      # bound of the labelled sample
MIN_Z = 2.3
GAP = -0.1
SCORE_DECIMALS = 3        # of a word's score: few distinct scores, whatever the number of words
MAX_EXPECTED = 0.01
EDGE_MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_~`/\\"


@dataclass
class Model:
    lexicon: str | None       # folder of the (word, score) table; None: no word has evidence
    rate: float               # lambda
    size: float               # K
    intercept: float = 0.0
    slope: float = 1.0

    def calibrated(self, score: float, words: int) -> float:
        """-ln of the expected number of such segments in as many clean words."""
        return self.rate * score - math.log(self.size * max(words, 1))

    def evidence(self, segments: list, words: int) -> float:
        scores = [self.calibrated(s[2], words) for s in segments]
        if not scores:
            return self.calibrated(0.0, words)
        best = max(range(len(scores)), key=scores.__getitem__)
        return scores[best] + sum(max(0.0, x) for k, x in enumerate(scores) if k != best)

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.intercept + self.slope * evidence))))


def bare(word: str) -> str:
    """A word's form in the lexicon: lower case without marks at its edges."""
    return word.lower().strip(EDGE_MARKS)


@lru_cache(maxsize=1)
def read_lexicon(folder: str | None) -> dict[str, float]:
    """The scores of all words with evidence; a worker reads them once."""
    if folder is None:
        return {}
    store, path = store_at(folder)
    rows = pq.read_table(path, filesystem=store, columns=["word", "score"])
    return dict(zip(rows["word"].to_pylist(), rows["score"].to_pylist()))


def maximal_segments(places: list[int], scores: list[float], gap: float = GAP,
                     before: list[float] | None = None) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) of a text whose words at ``places`` (ascending)
    score ``scores`` (positive) and whose other words score below zero. ``before`` are the sums of all scores
    before each place; without it, every other word scores ``gap``. Linear time: every candidate links back to
    the nearest one with a smaller left sum."""
    if before is None:
        ahead = np.concatenate(([0.0], np.cumsum(scores)[:-1])) if len(scores) else np.zeros(0)
        before = (ahead + gap * (np.array(places, float) - np.arange(len(places)))).tolist()
    found: list[tuple] = []          # (first, end, left sum, right sum, link)
    for place, score, left in zip(places, scores, before):
        first, end, right = place, place + 1, left + score
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((first, end, left, right, j))
                break
            first, left, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
    return [(a, b, r - l) for a, b, l, r, _ in found]


def _segments(texts: pa.Array, lexicon: dict[str, float], cache: dict):
    """Per row: (number of words, its maximal segments)."""
    rows, codes, words = encoded_words(texts, lower=True)
    value = np.zeros(len(words))
    for i, w in enumerate(words):
        s = cache.get(w)
        if s is None:
            s = lexicon.get(bare(w), GAP)
            if len(cache) < 300_000:
                cache[w] = s
        value[i] = s
    per_token = value[codes] if len(words) else np.zeros(0)
    ends = np.cumsum(rows)
    toxic = np.nonzero(per_token > 0)[0]
    cuts = np.searchsorted(toxic, np.concatenate(([0], ends)))
    for r in range(len(rows)):
        places = toxic[cuts[r]:cuts[r + 1]]
        if not len(places):
            yield int(rows[r]), []
            continue
        first = ends[r] - rows[r]
        sums = np.concatenate(([0.0], np.cumsum(per_token[first:ends[r]])))
        yield int(rows[r]), maximal_segments((places - first).tolist(), per_token[places].tolist(),
                                             before=sums[places - first].tolist())


def training_sample(labels: DataFrame, bucket, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(id, toxic) of the bounded labelled sample; ``bucket`` is true for ids that may be learned from.
    Repeated labels of an id count as toxic if one of them is; null labels and ids are no labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & bucket)
    return smallest_hashes(known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")),
                           "doc_id", train_docs)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n_toxic, n_clean): documents of each class with the word; ``docs`` has (text, toxic)."""

    def run(batches):
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in slices(batch.column(0)):
                rows, codes, words = encoded_words(batch.column(0).slice(lo, hi - lo), lower=True)
                forms: dict[str, int] = {}
                form_of = np.array([forms.setdefault(bare(w), len(forms)) for w in words], np.int64)
                if not len(words):
                    continue
                pairs = np.unique(np.repeat(np.arange(len(rows)), rows) * len(forms) + form_of[codes])
                is_toxic = toxic[lo:hi][pairs // len(forms)]
                form = pairs % len(forms)
                bad = np.bincount(form[is_toxic], minlength=len(forms))
                all_ = np.bincount(form, minlength=len(forms))
                yield pa.RecordBatch.from_arrays([pa.array(list(forms)), pa.array(bad), pa.array(all_ - bad)],
                                                 ["word", "n_toxic", "n_clean"])

    rows = docs.select("text", "toxic").mapInArrow(lean(run), "word string, n_toxic long, n_clean long")
    return rows.where("word != ''").groupBy("word").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def lexicon(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(word, score, n_toxic, n_clean) of every word whose log-odds are significant; ``n_toxic`` and ``n_clean``
    are the sums over all words of :func:`word_counts`."""
    prior = F.lit(float(n_toxic)) * (F.col("n_toxic") + F.col("n_clean")) / float(n_toxic + n_clean)
    t, c = F.col("n_toxic") + prior, F.col("n_clean") + prior
    odds = F.log(t / (2.0 * n_toxic - t)) - F.log(c / (float(n_clean + n_toxic) - c))
    rows = counts.select("*", odds.alias("odds"), F.sqrt(1 / t + 1 / c).alias("spread"))
    rows = rows.where(F.abs("odds") >= MIN_Z * F.col("spread"))
    score = F.when(F.col("odds") > 0, F.col("odds") - F.col("spread")).otherwise(
        F.least(F.lit(GAP), F.col("odds") + F.col("spread")))
    return rows.select("word", F.round(score, SCORE_DECIMALS).alias("score"), "n_toxic", "n_clean")


def decay(cells: list[tuple[float, int, int]], n_toxic: int, n_clean: int) -> float:
    """Lambda: E[exp(lambda score)] = 1 over clean words. ``cells`` are (score, n_toxic, n_clean) sums over the
    words of a score; all other words score ``GAP``."""
    total = float(n_toxic + n_clean)
    score = np.array([s for s, _, _ in cells])
    share = np.array([(c + n_toxic * (t + c) / total) / total for _, t, c in cells])

    def excess(rate):
        return float((share * np.exp(rate * score)).sum() + (1 - share.sum()) * math.exp(rate * GAP) - 1)

    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(low, 1e-3)


def fit(docs: DataFrame, labels: DataFrame, bucket, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on the labelled documents. Without toxic or clean labels, or toxic words, every text scores the same."""
    sample = training_sample(labels, bucket, train_docs)
    train = docs.join(F.broadcast(sample.withColumnRenamed("doc_id", "_label_id")), F.col("id") == F.col("_label_id")
                      ).select("text", "toxic")
    counts = stored(word_counts(train), "toxic-words")
    n_toxic, n_clean = counts.agg(F.sum("n_toxic"), F.sum("n_clean")).first()
    if not n_toxic or not n_clean:
        drop_stored(counts)
        return Model(None, 1.0, 1.0, -2.0, 0.0)
    words = stored(lexicon(counts, n_toxic, n_clean), "toxic-lexicon")
    drop_stored(counts)
    cells = sorted(tuple(r) for r in words.groupBy("score").agg(F.sum("n_toxic"), F.sum("n_clean")).collect())
    if not any(s > 0 for s, _, _ in cells):
        drop_stored(words)
        return Model(None, 1.0, 1.0, -2.0, 0.0)
    model = Model(words._stored_path, decay(cells, n_toxic, n_clean), 1.0)
    # K over the clean documents' best segments, then the logistic curve over evidence bins.
    best = stored(_segment_table(train, model), "toxic-segments")
    clean = best.where("toxic = 0").agg(F.count("*"), F.sum(F.col("n") * F.exp(-model.rate * F.col("best")))).first()
    if clean[0] and clean[1]:
        model.size = clean[0] / clean[1]
    drop_stored(best)
    evidence = _segment_table(train, model).groupBy(
        "toxic", (F.round(F.greatest(F.lit(-25.0), F.least(F.lit(75.0), "evidence")) * 4) / 4).alias("x")).count().collect()
    model.intercept, model.slope = _logistic([(r.x, r.toxic, r["count"]) for r in evidence])
    return model


def _logistic(cells: list[tuple[float, int, int]]) -> tuple[float, float]:
    x, y, w = (np.array(v, float) for v in zip(*cells))
    at = np.array([math.log(((w * y).sum() + 1) / ((w * (1 - y)).sum() + 1)), 0.0])
    ridge = np.diag([1e-6, 1e-2])
    z = np.stack([np.ones_like(x), x])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at @ z, -40, 40)))
        step = np.linalg.solve((z * (w * p * (1 - p))) @ z.T + ridge, z @ (w * (p - y)) + ridge @ at)
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), max(float(at[1]), 0.0)


def _segment_table(docs: DataFrame, model: Model) -> DataFrame:
    """(toxic, n, best, evidence) of the labelled documents."""

    def run(batches):
        words, cache = read_lexicon(model.lexicon), {}
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                n, best, evidence = [], [], []
                for size, segments in _segments(batch.column(0).slice(lo, hi - lo), words, cache):
                    n.append(size)
                    best.append(max((s[2] for s in segments), default=0.0))
                    evidence.append(model.evidence(segments, size))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(best, pa.float64()),
                     pa.array(evidence, pa.float64())], ["toxic", "n", "best", "evidence"])

    return docs.select("text", "toxic").mapInArrow(lean(run), "toxic int, n long, best double, evidence double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, n_words, passages) of every row of ``docs`` (id, text).

    ``passages`` are the significant segments: word range, score and expected number under clean text."""
    schema = ("doc_id long, score double, predicted int, n_words long, "
              "passages array<struct<first:long,end:long,score:double,expected:double>>")
    passages = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()),
                                   ("expected", pa.float64())]))

    def run(batches):
        words, cache = read_lexicon(model.lexicon), {}
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                p, n, found = [], [], []
                for size, segments in _segments(batch.column(1).slice(lo, hi - lo), words, cache):
                    p.append(model.probability(model.evidence(segments, size)))
                    n.append(size)
                    kept = [(a, b, s, math.exp(-model.calibrated(s, size))) for a, b, s in segments]
                    found.append([{"first": a, "end": b, "score": s, "expected": e} for a, b, s, e in kept
                                  if e <= MAX_EXPECTED])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(p, pa.float64()),
                     pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(n, pa.int64()),
                     pa.array(found, passages)], ["doc_id", "score", "predicted", "n_words", "passages"])

    return docs.select("id", "text").mapInArrow(lean(run), schema)


def score_column(model: Model):
    """The score of a text column as a column function."""

    @F.arrow_udf("double")
    def score_of(texts: pa.Array) -> pa.Array:
        out, words = [], read_lexicon(model.lexicon)
        cache: dict = {}
        for lo, hi in slices(texts):
            for size, segments in _segments(texts.slice(lo, hi - lo), words, cache):
                out.append(model.probability(model.evidence(segments, size)))
        return pa.array(out, pa.float64())

    return score_of


def toxicity(docs: DataFrame, labels: DataFrame, bucket, train_docs: int = TRAIN_DOCS,
             text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Score every document. Only texts enter a score; language, source, id and labels do not.

    Null and empty texts have no segment and get the curve's value for no evidence. Null ids stay null and
    are scored; repeated rows are scored once each. Extra columns are not read; an empty table gives an
    empty result."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return score(rows, fit(rows, labels, bucket, train_docs))
