"""op4 at the ends of double's range: cosines do not depend on a vector's length."""
from stockline.llm.embeddings import near_duplicates


def test_lengths_do_not_matter(spark):
    base = [[1.0, 0.0, 0.5], [0.0, 1.0, -0.5], [1.0, 0.01, 0.5], [-1.0, 0.0, -0.5]]
    rows = [(10 * k + j, [x * scale for x in v]) for k, scale in enumerate([1.0, 1e-170, 1e200, 5e-300, 1e307]) for j, v in enumerate(base)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    # Over all scales: 0 and 2 are near each other, 1 and 3 only near their own multiples.
    assert got == {i: {0: (9, 0), 1: (4, 1), 2: (9, 0), 3: (4, 3)}[i % 10] for i, _ in rows}
