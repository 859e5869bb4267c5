"""Mixing to target weights with soft domain membership.

1. A classifier fitted on the labelled table predicts every document's posterior over the domains:
   multinomial naive Bayes over hashed words and word shapes, keeping the buckets whose log-odds against the
   first domain are significant. It is fitted on a bounded sample (``train_docs``) of the labelled rows.
2. A document of n words with posterior p contributes n p expected words to the domains. Projected-gradient
   least squares finds rates r >= 0 whose expected domain totals, sum of r n p, match the target weights
   of the whole budget. Residuals are measured in the metric of the domains' co-membership matrix M (the sum
   of n p p'), in which the problem has unit curvature: a document's gradient is p M^-1 (residual), the step
   is 1, and targets that can be met without the bound are met in one step. Where the bound holds many rates at 0, steps in
   the metric of the other rows alone keep the progress (:func:`solve`). A rate depends on the posterior
   alone, so a step is one aggregate over the words per distinct posterior: naive Bayes sums have two decimals
   and a bound, which keeps that table to 12,001 rows for two domains (its square for three), whatever the corpus.
   The steps taken are the whole state: a document's rate is recomputed from them, nothing is updated in
   place, and a lost executor costs its tasks alone.

Native: DataFrame functions only; the driver holds the significant bucket weights (stored as one row, which the
tasks read), the domains-by-domains matrix and one vector a step.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockline.llm.storage import drop_stored, smallest_hashes, stored

TRAIN_DOCS = 20_000
BUCKETS = 1 << 16
MIN_Z = 3.0
MAX_SCORE = 60.0           # naive Bayes sums beyond this count as this
TOLERANCE = 1e-6           # of the budget: largest domain residual
SPACE = r"[\x20\x09-\x0D]+"


@dataclass
class Classifier:
    domains: list[str]
    weights: DataFrame                      # one row: the bucket weights w_1, w_2, ... of every domain but the first
    curves: list[tuple[float, float]]       # (intercept, slope) from a domain's naive Bayes sum to its logit

    def with_sums(self, rows: DataFrame) -> DataFrame:
        """``rows`` without _buckets, with s_1, s_2, ...: naive Bayes log-odds of each domain but the first
        against the first."""
        names = [f"s_{k}" for k in range(1, len(self.domains))]
        keep = [c for c in rows.columns if c != "_buckets"]
        if not names:
            return rows.select(*keep)
        # The weights reach the tasks as scalar subqueries, not as literals in every plan. One sum over the
        # buckets: both projects become one, and no row holds the weights.
        tables = [self.weights.select(f"w_{k}").scalar().alias(f"_t_{k}") for k in range(1, len(self.domains))]
        sums = F.aggregate("_buckets", F.struct(*[F.lit(0.0).alias(x) for x in names]), lambda s, b: F.struct(
            *[(s[x] + F.get(F.col(f"_t_{k}"), b)).alias(x) for k, x in enumerate(names, 1)]))
        rows = rows.select(*rows.columns, *tables).select(*keep, sums.alias("_sums"))
        # Weights have two decimals: rounding only takes away the noise of the order they are added in.
        return rows.select(*keep, *[F.round(F.greatest(F.lit(-MAX_SCORE), F.least(F.lit(MAX_SCORE), F.col(f"_sums.{x}"))), 2).alias(x)
                                    for x in names])


def features(rows: DataFrame) -> DataFrame:
    """``rows`` (text, ...) with n_words and _buckets: the distinct buckets of a text's lower-cased words and of
    their shapes (runs of letters as one letter). The text column goes."""
    keep = [c for c in rows.columns if c != "text"]
    rows = rows.select(*keep, F.lower(F.coalesce("text", F.lit(""))).alias("_text"))
    rows = rows.select(*keep, F.array_remove(F.split("_text", SPACE), "").alias("_words"),
                       F.split(F.regexp_replace("_text", r"\p{L}+", "L"), SPACE).alias("_shapes"))
    bucket = lambda w: F.pmod(F.hash(w), F.lit(BUCKETS))
    return rows.select(*keep, F.size("_words").cast("long").alias("n_words"), F.array_distinct(F.concat(
        F.transform("_words", bucket), F.transform(F.array_distinct("_shapes"), bucket))).alias("_buckets"))


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], train_docs: int = TRAIN_DOCS) -> Classifier:
    """Naive Bayes over ``docs`` (id, text) that stand in ``labelled`` (doc_id, domain), and for every domain a
    logistic curve from its sum to its log-odds against the first. Rows of other or null domains are no
    labels; of several domains of an id the first in ``domains`` counts."""
    order = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain"))
    sample = smallest_hashes(labelled.where(F.col("doc_id").isNotNull() & F.coalesce(order > 0, F.lit(False)))
                             .groupBy("doc_id").agg(F.min(order).cast("int").alias("domain")), "doc_id", train_docs)
    train = docs.join(F.broadcast(sample.withColumnRenamed("doc_id", "_label_id")), F.col("id") == F.col("_label_id"))
    train = stored(features(train.select("domain", "text")), "mixing-training")
    model = Classifier(domains, _weights(train, len(domains)), [])
    binned = model.with_sums(train)
    binned = binned.select("domain", *[(F.round(F.col(f"s_{k}") * 2) / 2).alias(f"s_{k}") for k in range(1, len(domains))])
    for k in range(1, len(domains)):
        cells = binned.where(F.col("domain").isin(1, k + 1)).groupBy("domain", f"s_{k}").count().collect()
        model.curves.append(_curve([(r[f"s_{k}"], r.domain != 1, r["count"]) for r in cells]))
    drop_stored(train)
    return model


def _weights(train: DataFrame, size: int) -> DataFrame:
    """One row with the weights w_1, w_2, ... of all buckets, 0 where they are not significant."""
    cells = stored(train.select("domain", F.explode("_buckets").alias("bucket")).groupBy("bucket").agg(
        *[F.count_if(F.col("domain") == k + 1).alias(f"c_{k}") for k in range(size)]), "mixing-cells")
    found = cells.agg(*[F.coalesce(F.sum(f"c_{k}"), F.lit(0)) for k in range(size)]).first()
    everywhere = sum((F.col(f"c_{k}") for k in range(1, size)), F.col("c_0"))
    columns = []
    for k in range(1, size):
        # The bucket's common share as prior, of the weight of the smaller class.
        prior = min(found[k], found[0]) + 1.0
        share = (everywhere + 0.1) / (sum(found) + 0.1 * BUCKETS) * prior
        a, b = F.col(f"c_{k}") + share, F.col("c_0") + share
        odds = F.log(a / (found[k] + 1.0 + prior)) - F.log(b / (found[0] + 1.0 + prior))
        columns.append(F.when(F.abs(odds) >= MIN_Z * F.sqrt(1 / a + 1 / b), F.round(odds, 2)).otherwise(0.0).alias(f"w_{k}"))
    names = [f"w_{k}" for k in range(1, size)]
    weights = np.zeros((size - 1, BUCKETS))
    if names:
        for r in cells.select("bucket", *columns).where(" or ".join(f"{x} != 0" for x in names)).collect():   # at most BUCKETS
            weights[:, r.bucket] = r[1:]
    drop_stored(cells)
    row = pa.table({x: pa.array([w], pa.list_(pa.float64())) for x, w in zip(names, weights)} or {"none": pa.array([0])})
    return stored(train.sparkSession.createDataFrame(row), "mixing-weights")


def _curve(cells: list[tuple[float, bool, int]]) -> tuple[float, float]:
    """Logistic curve through (sum, is the domain, number) cells, by ridge-regularised Newton steps."""
    if not cells:
        return 0.0, 0.0
    x, y, w = (np.array(v, float) for v in zip(*cells))
    z, ridge = np.stack([np.ones_like(x), x]), np.diag([1e-3, 1e-1])
    at = np.array([math.log(((w * y).sum() + 1) / ((w * (1 - y)).sum() + 1)), 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at @ z, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))) @ z.T + ridge, z @ (w * (p - y)) + ridge @ at)
        at = at - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), max(float(at[1]), 0.0)


def memberships(rows: DataFrame, model: Classifier) -> DataFrame:
    """``rows`` (text, ...) without its text, with n_words and posterior columns p_0, p_1, ..."""
    keep = [c for c in rows.columns if c != "text"]
    rows = model.with_sums(features(rows))
    odds = [F.exp(F.lit(a) + b * F.col(f"s_{k}")) for k, (a, b) in enumerate(model.curves, 1)]
    rows = rows.select(*keep, "n_words", *[x.alias(f"_o_{k}") for k, x in enumerate(odds, 1)])
    every = sum((F.col(f"_o_{k}") for k in range(1, len(odds) + 1)), F.lit(1.0))
    return rows.select(*keep, "n_words", (1.0 / every).alias("p_0"),
                       *[(F.col(f"_o_{k}") / every).alias(f"p_{k}") for k in range(1, len(odds) + 1)])


def rate_of(steps: list[list[float]]) -> Column:
    """Rate of a row with posterior p_0, p_1, ... after the given projected-gradient steps, from rate 1."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.lit(u) * F.col(f"p_{k}") for k, u in enumerate(step)), F.lit(0.0)))
    return rate


def _rate_by_data(steps: list[list[float]]) -> Column:
    """:func:`rate_of` with the steps as data to one fixed expression: every round of :func:`solve` runs the
    same plan. It is interpreted, hence for the small table of posteriors only."""
    if not steps:
        return F.lit(1.0)
    rows = ", ".join("array(" + ", ".join(f"{u!r}D" for u in step) + ")" for step in steps)
    change = " + ".join(f"s[{k}] * p_{k}" for k in range(len(steps[0])))
    return F.expr(f"aggregate(array({rows}), 1.0D, (r, s) -> greatest(0.0D, r - ({change})))")


@dataclass
class Solution:
    """Steps of the rates, and what they leave of each domain's target share (expected - target). ``reached``: nothing
    above the tolerance; otherwise no rates >= 0 reach the targets."""
    steps: list[list[float]]
    residual: list[float]

    @property
    def reached(self) -> bool:
        return max(map(abs, self.residual)) <= TOLERANCE


def reachable(table: DataFrame, targets: list[float], inverse: np.ndarray) -> bool:
    """Whether some rates >= 0 meet the targets: whether they lie in the cone of the posteriors of ``table`` (p_k).

    The cone's point nearest to the targets is found from its rays: each round one aggregate finds the row that the
    residual points away from most, and the best weights of at most as many rows as domains are solved for again."""
    size, t = len(targets), np.array(targets)
    rays, best = [], float(t @ inverse @ t)
    while True:
        miss = -t
        for used in itertools.chain.from_iterable(itertools.combinations(range(len(rays)), k) for k in range(1, size + 1)):
            c = np.array([rays[k] for k in used]).T
            x = np.linalg.lstsq(c.T @ inverse @ c, c.T @ inverse @ t, rcond=None)[0]
            if (x >= 0).all() and (c @ x - t) @ inverse @ (c @ x - t) < miss @ inverse @ miss:
                miss, kept = c @ x - t, used
        now = float(miss @ inverse @ miss)
        if np.abs(miss).max() <= TOLERANCE:
            return True
        if rays:
            if now > best * (1 - 1e-9):
                return False
            rays, best = [rays[k] for k in kept], now
        along = sum((F.col(f"p_{k}") * float(g) for k, g in enumerate(inverse @ miss)), F.lit(0.0))
        row = table.agg(F.min_by(F.array(*[F.col(f"p_{k}") for k in range(size)]), along)).first()[0]
        rays.append(np.array(row))


def solve(table: DataFrame, targets: list[float]) -> Solution:
    """Least-squares rates over ``table`` (n_words, p_k): expected domain shares of the budget (all words)
    towards ``targets``. A table without words takes no step (rate 1).

    Each round measures the residual. The plain projected-gradient step always lowers the objective, but is short once
    many rates are 0: then the step in the metric of the rows whose rate is positive is tried first, and taken back if the
    objective does not fall by it. Rounds go on until the residual is within the tolerance, however many it takes. Only if
    a round brings little is it asked whether the targets can be met at all; if they can't, rates would grow without
    bound on ever fewer documents, so the rounds end there and what is missed is reported."""
    size = len(targets)
    p = [F.col(f"p_{k}") for k in range(size)]
    table = stored(table.groupBy(*p).agg(F.sum("n_words").alias("n_words")).where("n_words > 0"), "posteriors")
    pairs = [(i, j) for i in range(size) for j in range(i + 1)]
    goal = np.array(targets)

    def measured(taken):
        """(residual, co-membership of the rows of positive rate)"""
        words = F.col("n_words")
        row = table.withColumn("_rate", _rate_by_data(taken)).agg(
            F.sum(words), *[F.sum(words * F.col("_rate") * x) for x in p],
            *[F.coalesce(F.sum(F.when(F.col("_rate") > 0, words * p[i] * p[j])), F.lit(0.0)) for i, j in pairs]).first()
        if not row[0]:
            return None, None
        gram = np.zeros((size, size))
        for (i, j), x in zip(pairs, row[size + 1:]):
            gram[i, j] = gram[j, i] = x / row[0]
        return np.array(row[1:size + 1], float) / row[0] - goal, gram

    taken: list[list[float]] = []
    residual, gram = measured(taken)
    if residual is None:
        drop_stored(table)
        return Solution([], [0.0] * size)
    inverse = np.linalg.inv(gram + 1e-4 * np.eye(size))      # all rates are 1: the co-membership of all rows
    can = None
    while np.abs(residual).max() > TOLERANCE:
        now = residual @ inverse @ residual
        for step in (np.linalg.solve(gram + 1e-9 * np.eye(size), residual), inverse @ residual):
            then, gram_then = measured([*taken, step.tolist()])
            if then @ inverse @ then < now:
                taken.append(step.tolist())
                residual, gram = then, gram_then
                break
        if residual @ inverse @ residual > 0.9 * now:
            can = reachable(table, targets, inverse) if can is None else can
            if not can or residual @ inverse @ residual >= now:
                break
    drop_stored(table)
    return Solution(taken, residual.tolist())


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text_col: str = "text",
                 id_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, n_words, p_<domain>..., rate, missed) of every row. ``missed`` is the same on all rows: the largest share
    of the budget by which a domain's expected total is off its target (0 within the tolerance; above it, no
    rates >= 0 meet the targets).

    ``targets`` gives the domains (the first is the classifier's reference) and their weights (scaled to
    sum 1). Null and empty texts have no words; their posterior is the prior. Null ids stay null; repeated rows get
    equal rates; an empty table gives an empty result, no labels equal posteriors by prior. Extra columns
    are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    _, found, table = _solved(rows, labelled, targets, train_docs)
    missed = 0.0 if found.reached else max(map(abs, found.residual))
    return table.select(F.col("id").alias("doc_id"), "n_words",
                        *[F.col(f"p_{k}").alias(f"p_{d}") for k, d in enumerate(targets)], rate_of(found.steps).alias("rate"), F.lit(missed).alias("missed"))


def _solved(rows, labelled, targets, train_docs):
    model = fit(rows, labelled, list(targets), train_docs)
    table = stored(memberships(rows, model), "memberships")
    weights = np.array(list(targets.values()), float)
    return model, solve(table, (weights / weights.sum()).tolist()), table


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` (doc_id, text, ...) in the mix: each row floor(rate) times, and once more with the chance of
    the rest, drawn by a hash of its id and text; rows drawn 0 times go. Columns are those of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"),
                       F.struct(*docs.columns).alias("_own"))
    # The rows are stored beside their posteriors: writing them costs less than finding their words again.
    _, found, table = _solved(rows, labelled, targets, train_docs)
    draw = F.pmod(F.xxhash64("_own.doc_id", "_own.text"), F.lit(1 << 20)) / float(1 << 20)
    rows = table.select("_own", rate_of(found.steps).alias("_rate"))
    times = (F.floor("_rate") + (draw < F.col("_rate") - F.floor("_rate")).cast("int")).cast("int")
    return rows.withColumn("_times", times).where("_times > 0").withColumn(
        "_turn", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[F.col(f"_own.{c}") for c in docs.columns])
