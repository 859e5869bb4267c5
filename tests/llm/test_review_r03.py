"""Findings of round 3: op10's sequences are exchanged as packed cells."""
import random

import numpy as np
from pyspark.sql import functions as F

from stockline.llm import lm
from stockline.llm.files import unpacked
from tests.llm.test_review_r02 import plain_scores


def test_sequences_travel_as_few_packed_cells():
    """A sequence with its small count takes less than its 8-byte key, and a block a row for each range."""
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-2**63, 2**63 - 1, 200_000))
    n = rng.integers(0, 3, len(keys))
    cells = lm.dealt(7, lm.SEQUENCES, keys, [n], 12).to_pylist()
    assert [c["slice"] for c in cells] == list(range(12)) and {c["block"] for c in cells} == {7}
    assert sum(len(c["data"]) for c in cells) < 7 * len(keys)
    back = [unpacked(c["data"], c["plain"], 2) for c in cells]
    assert (np.concatenate([np.cumsum(b[0]) for b in back]) == keys).all()
    assert (np.concatenate([b[1] for b in back]) == n).all()


def test_many_blocks_and_ranges_give_the_scores_of_one_tree(spark, monkeypatch):
    """One very frequent word, words of one block only, held-out and empty texts; small blocks and many ranges."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        words = [w for _ in range(rng.randrange(25)) for w in ("the", rng.choice(["a", "b", "c", f"w{i // 3}", f"x{rng.randrange(60)}"]))]
        rows.append((i, None if i % 50 == 7 else " ".join(words)))
    held = lambda i: i % 10 == 0
    want = plain_scores(rows, held)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(lm, "RANGE_KEYS", 1500)
    for size in (400, 8000):
        monkeypatch.setattr(lm, "BLOCK_BYTES", size)
        got = {r.doc_id: r.score for r in lm.scored(docs, F.col("doc_id") % 10 == 0).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
