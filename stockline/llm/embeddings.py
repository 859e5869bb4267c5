"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosines, connected components.

Equal vectors are collapsed first (with their number). Each distinct vector gets ``tables`` keys of
``bits`` signs; vectors with a common key are compared by exact cosine in double precision in the task
that holds their bucket. A pair is counted in the first table that holds it, so links are counted once. A
bucket larger than ``BLOCK`` is cut into blocks by id hash and its block pairs are spread over tasks: the
work of a hot bucket is shared and no task holds it whole. Link counts and a spanning set of links
leave the task, never all pairs; no bucket is capped.

``bits`` grows with the logarithm of the table so that buckets stay small, and ``tables`` is the number
that misses a pair at the threshold with a chance of at most ``MISS``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.components import connected_components
from stockline.llm.simhash import _unite
from stockline.llm.storage import partitions, stored

MIN_COSINE = 0.95
MISS = 1e-4
BLOCK = 2048
SEED = 20_011


def sizes(n: int, min_cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for ``n`` distinct vectors."""
    bits = min(30, max(8, math.ceil(math.log2(max(n, 2))) - 6))
    same = (1 - math.acos(min_cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def _keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """[rows, tables] sign keys; the hyperplanes depend on the dimension alone."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes >= 0).reshape(len(x), tables, bits)
    return (signs << np.arange(bits)).sum(axis=2).astype(np.int32)


def _signed(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """(t, key, id, many, dim, vec, keys) of every vector and table."""

    def run(batches):
        for batch in batches:
            ids, many, vecs = (batch.column(k) for k in range(3))
            dims = np.asarray(vecs.value_lengths())
            flat = vecs.flatten().to_numpy().astype(np.float64)
            first = np.cumsum(dims) - dims
            for dim in np.unique(dims):
                rows = np.nonzero(dims == dim)[0]
                for lo in range(0, len(rows), 512):
                    at = rows[lo:lo + 512]
                    x = flat[first[at][:, None] + np.arange(dim)]
                    # By a power of two, which changes no cosine: squares of very large or small ones leave double's range.
                    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
                    keys = _keys(x, bits, tables)
                    own = np.repeat(at, tables)
                    raw = [v.tobytes() for v in x]
                    packed = [k.tobytes() for k in keys]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(keys.reshape(-1)),
                         ids.take(pa.array(own)), many.take(pa.array(own)), pa.array(np.full(len(own), dim, np.int32)),
                         pa.array([v for v in raw for _ in range(tables)], pa.binary()),
                         pa.array([k for k in packed for _ in range(tables)], pa.binary())],
                        ["t", "key", "id", "many", "dim", "vec", "keys"])

    return vectors.select("id", "many", "vec").mapInArrow(
        run, "t int, key int, id long, many long, dim int, vec binary, keys binary")


def _compare(t, left, own, min_cosine):
    """Linked pairs (i, j) of one block pair that no earlier table holds; i < j within one block."""
    x, keys = left
    norm = np.sqrt((x * x).sum(axis=1))
    out_i, out_j = [], []
    first_half = np.nonzero(own)[0]
    second = np.nonzero(~own)[0]
    both = len(second) > 0
    cols = second if both else first_half
    for lo in range(0, len(first_half), 1024):
        rows = first_half[lo:lo + 1024]
        near = (x[rows] @ x[cols].T) >= min_cosine * norm[rows][:, None] * norm[cols][None, :]
        a, b = np.nonzero(near)
        i, j = rows[a], cols[b]
        if not both:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 18):
            p, q = i[k:k + (1 << 18)], j[k:k + (1 << 18)]
            fresh = ~(keys[p, :t] == keys[q, :t]).any(axis=1) if t else np.ones(len(p), bool)
            out_i.append(p[fresh])
            out_j.append(q[fresh])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def _links(signed: DataFrame, min_cosine: float) -> DataFrame:
    """(id, links, root): per bucket, the number of vectors linked to ``id`` there and a spanning link."""
    spark = signed.sparkSession
    hot = signed.groupBy("t", "key", "dim").count().where(F.col("count") > BLOCK).select(
        "t", "key", "dim", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    rows = signed.join(hot, ["t", "key", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("t", "key", "dim", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"),
                       "own", "id", "many", "vec", "keys")
    group = ["t", "key", "dim", "b1", "b2"]
    rows = rows.repartition(partitions(spark), *group).sortWithinPartitions(*group, "id")

    def flush(held):
        out = []
        names = np.stack([held[c].to_numpy() for c in range(5)], axis=1)
        edge = np.nonzero(np.concatenate(([True], (names[1:] != names[:-1]).any(axis=1), [True])))[0]
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if hi - lo < 2:
                continue
            t, _, dim, b1, b2 = names[lo].tolist()
            x = np.frombuffer(b"".join(held[8].slice(lo, hi - lo).to_pylist()), np.float64).reshape(hi - lo, dim)
            keys = np.frombuffer(b"".join(held[9].slice(lo, hi - lo).to_pylist()), np.int32).reshape(hi - lo, -1)
            first = held[5].slice(lo, hi - lo).to_numpy() == b1
            i, j = _compare(t, (x, keys), first if b1 != b2 else np.ones(hi - lo, bool), min_cosine)
            if not len(i):
                continue
            many = held[7].slice(lo, hi - lo).to_numpy()
            links = np.bincount(i, many[j], hi - lo) + np.bincount(j, many[i], hi - lo)
            roots = _unite(np.arange(hi - lo), i, j)
            at = np.nonzero(links)[0]
            ids = held[6].slice(lo, hi - lo).to_numpy()
            out.append((ids[at], links[at].astype(np.int64), ids[roots[at]]))
        ids, links, roots = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(roots)], ["id", "links", "root"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= 4 * BLOCK:  # whole groups only; a group has at most about two blocks
                names = np.stack([held.column(c).to_numpy() for c in range(5)], axis=1)
                last = np.nonzero((names != names[-1]).any(axis=1))[0]
                if len(last):
                    cut = int(last[-1]) + 1
                    yield flush([c.combine_chunks() for c in held.slice(0, cut).columns])
                    held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield flush([c.combine_chunks() for c in held.columns])

    return rows.mapInArrow(run, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, id_col: str = "vec_id",
                    vec_col: str = "embedding", miss: float = MISS) -> DataFrame:
    """One row per row of ``vectors``: (vec_id, n_links, component_id, kept).

    ``n_links`` counts the other rows linked directly (equal vectors included), ``component_id`` is the
    smallest id reachable. Vectors of different dimensions, and vectors that are null, empty, zero or hold
    null or non-finite components, link with nothing and are their own component. A null id links
    with nothing and has a null component. Repeated rows are vectors of their own. An empty table gives an
    empty result. Extra columns are not read."""
    vec = F.col(vec_col).cast("array<double>")
    usable = (F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
              & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
              & F.exists("vec", lambda v: v != 0.0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).withColumn(
        "usable", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("class", F.when(F.col("usable"), F.sha2(F.concat_ws(",", F.col("vec").cast("array<string>")), 256)))
    rows = stored(rows.select("id", "class", F.when(F.col("usable"), F.col("vec")).alias("vec")), "vectors")
    classes = stored(rows.where("class is not null").groupBy("class").agg(
        F.min("id").alias("id"), F.count("*").alias("many"), F.first("vec").alias("vec")), "vector-classes")
    bits, tables = sizes(classes.count(), min_cosine, miss)
    found = stored(_links(_signed(classes, bits, tables), min_cosine), "vector-links")
    linked = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_class = stored(classes.select("class", "id", "many").join(counts, "id", "left").join(
        linked, F.col("id") == F.col("node"), "left").select(
        "class", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id")), "vector-components")
    out = rows.select("id", "class").join(per_class, "class", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
