"""op5's rates against a plain non-negative least-squares solve, where the bound holds, and where targets can't be met."""


import numpy as np
import pytest

from stockline.llm import mixing


def nnls(posteriors, words, targets):
    """Plain accelerated projected gradient in double precision, run far past convergence."""
    a = posteriors.T * words / words.sum()
    gram = np.linalg.inv((posteriors.T * words) @ posteriors / words.sum() + 1e-4 * np.eye(len(targets)))
    r = z = np.ones(len(words))
    t = 1.0
    for _ in range(60_000):
        after = np.maximum(0, z - posteriors @ (gram @ (a @ z - targets)))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = after + (t - 1) / t2 * (after - r)
        r, t = after, t2
    miss = a @ r - targets
    return r, miss, miss @ gram @ miss


def table(spark, posteriors, words):
    return spark.createDataFrame([(int(w), *map(float, p)) for w, p in zip(words, posteriors)],
                                 "n_words long, " + ", ".join(f"p_{k} double" for k in range(posteriors.shape[1])))


def rates(posteriors, steps):
    r = np.ones(len(posteriors))
    for s in steps:
        r = np.maximum(0, r - posteriors @ np.array(s))
    return r


def case(seed, n=300, toxic=40):
    rng = np.random.default_rng(seed)
    posteriors = rng.dirichlet([8, 1, 0.3], n)
    posteriors[:toxic] = rng.dirichlet([0.2, 0.3, 6], toxic)
    return posteriors, rng.integers(1, 4000, n)


@pytest.mark.parametrize("seed", [1, 2])
def test_three_domains_reach_their_targets_where_many_rates_are_0(spark, seed):
    posteriors, words = case(seed)
    targets = np.array([0.93, 0.05, 0.02])
    found = mixing.solve(table(spark, posteriors, words), targets.tolist())
    r = rates(posteriors, found.steps)
    share = posteriors.T @ (words * r) / words.sum()
    assert (r == 0).sum() > 5 and (r >= 0).all()
    assert found.reached and np.abs(share - targets).max() <= 1e-5
    assert np.abs(nnls(posteriors, words, targets)[1]).max() <= 1e-5


def test_targets_out_of_reach_are_reported(spark):
    posteriors, words = case(3)
    posteriors = 0.8 * posteriors + 0.2 / 3          # every document holds a fifteenth of each domain at least
    targets = np.array([0.99, 0.005, 0.005])
    found = mixing.solve(table(spark, posteriors, words), targets.tolist())
    r = rates(posteriors, found.steps)
    got = posteriors.T @ (words * r) / words.sum() - targets
    before = posteriors.T @ words / words.sum() - targets
    inverse = np.linalg.inv((posteriors.T * words) @ posteriors / words.sum() + 1e-4 * np.eye(3))
    assert not found.reached and np.allclose(got, found.residual) and (r >= 0).all()
    assert nnls(posteriors, words, targets)[2] <= got @ inverse @ got < before @ inverse @ before


def test_reachable_tells_the_cone_of_posteriors(spark):
    rng = np.random.default_rng(5)
    posteriors, words = case(6, n=60, toxic=10)
    frame = table(spark, posteriors, words)
    for k in range(6):
        inside = posteriors.T @ (rng.random(60) ** 8)
        outside = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1]][k % 3])
        assert mixing.reachable(frame, (inside / inside.sum()).tolist(), np.eye(3))
        assert not mixing.reachable(frame, outside.tolist(), np.eye(3))


def test_absent_domain_and_empty_table(spark):
    posteriors, words = case(4)
    posteriors[:, :2] += posteriors[:, 2:] / 2
    posteriors[:, 2] = 0
    found = mixing.solve(table(spark, posteriors, words), [0.9, 0.05, 0.05])
    assert not found.reached and abs(found.residual[2] + 0.05) < 1e-9
    assert mixing.solve(table(spark, posteriors, words).limit(0), [0.9, 0.05, 0.05]).steps == []


def test_query_meets_its_targets(spark):
    from stockline.llm.queries import MIX, op5_mixing
    got = op5_mixing(spark, "/root/testdata/sf0.01").toPandas()
    words = got.n_words.sum()
    for domain, weight in MIX.items():
        assert abs((got.rate * got.n_words * got[f"p_{domain}"]).sum() / words - weight) <= 1e-5 + got.missed.max()
    assert (got.missed == 0).all()


def test_sample_takes_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from stockline.llm.storage import smallest_hashes
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    want = [r.doc_id for r in rows.orderBy(F.xxhash64("doc_id")).limit(300).collect()]
    assert [r.doc_id for r in smallest_hashes(rows, "doc_id", 300).collect()] == want
    assert smallest_hashes(rows, "doc_id", 6000).count() == 5000
