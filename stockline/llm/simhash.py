"""SimHash near-duplicates: 64-bit fingerprints linked by a binary-trie self-join.

Fingerprints are made per document inside the scan's tasks. Equal fingerprints are collapsed first
(map-side combined), so copies cost nothing further. Two fingerprints within ``max_bits`` differing
bits agree exactly on one of ``max_bits + 1`` bit blocks; each fingerprint therefore goes once to
each block's table, rotated so that the block is the top of its binary trie. Tries that share the
whole block are joined with themselves: node pairs are traversed together from that point, the
differing bits of their paths are accumulated, and a pair is dropped when they exceed ``max_bits``.
Only a spanning set of the links of each trie leaves the task; the links' components are found by
:mod:`stockline.llm.components`.

Pairs whose leaves are already known to be in one component are not traversed, so a large group of
near copies costs about its size, not its square. No bucket, candidate or partner is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.components import connected_components
from stockline.llm.storage import TEXT_ROWS, lean, partitions, rows_per_batch, stored

WORDS_PER_SHINGLE = 4
MAX_BITS = 4
HASH_SEED = 42
LEAF_PAIRS = 64        # node pairs with at most this many leaf pairs are compared directly
FRONTIER = 1 << 17     # node pairs expanded at once
TRIE_ROWS = 1 << 18    # fingerprints of whole tries joined at once


def fingerprint(text: str | None, shingle_words: int = WORDS_PER_SHINGLE, seed: int = HASH_SEED) -> int:
    """64-bit SimHash of word shingles (repeats included). A-Z are lower-cased, words are runs of
    non-white-space, a text of fewer words is one shingle, no word gives 0."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - shingle_words].tolist()
    ends = ends[shingle_words - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(starts), 1 << 16):
        hashes = np.array([digest(joined[s:e], seed) for s, e in
                           zip(starts[lo:lo + (1 << 16)], ends[lo:lo + (1 << 16)])], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                 shingle_words: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(id, fp) of every row; ``fp`` is the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
                       ).mapInArrow(lean(run), "id long, fp long")


# ---- the trie self-join -----------------------------------------------------------------------

def _roots(labels: np.ndarray) -> np.ndarray:
    while True:
        up = labels[labels]
        if np.array_equal(up, labels):
            return labels
        labels = up


def _unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest-row labels after linking rows i[k] and j[k]."""
    while len(i):
        a, b = labels[i], labels[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        i, j, low, high = i[open_], j[open_], low[open_], high[open_]
        np.minimum.at(labels, high, low)
        labels = _roots(labels)
    return labels


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _leaf_pairs(a_lo, a_hi, b_lo, b_hi):
    """All row pairs of the given (small) node pairs."""
    na, nb = a_hi - a_lo, b_hi - b_lo
    count = na * nb
    which = np.repeat(np.arange(len(count)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return a_lo[which] + k // nb[which], b_lo[which] + k % nb[which]


def trie_components(codes: np.ndarray, group: np.ndarray, top_bit: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """Label (smallest row) of each row's component under "``max_bits`` or fewer differing bits".

    ``codes`` (uint64) are sorted within each run of equal ``group``; the rows of a group agree on all
    bits above ``top_bit``. Rows of different groups are not compared."""
    n = len(codes)
    labels = np.arange(n)
    if n < 2:
        return labels
    same = group[1:] == group[:-1]
    near = same & (_popcount(codes[1:] ^ codes[:-1]) <= max_bits)
    at = np.nonzero(near)[0]
    labels = _unite(labels, at, at + 1)
    edges = np.nonzero(np.concatenate(([True], ~same, [True])))[0]
    lo, hi = edges[:-1].astype(np.int64), edges[1:].astype(np.int64)
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    stack = [(top_bit, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    ones_before: dict[int, np.ndarray] = {}
    while stack:
        bit, a_lo, a_hi, b_lo, b_hi, diff = stack.pop()
        if len(a_lo) > FRONTIER:
            half = len(a_lo) // 2
            stack.append((bit, *(x[half:] for x in (a_lo, a_hi, b_lo, b_hi, diff))))
            a_lo, a_hi, b_lo, b_hi, diff = (x[:half] for x in (a_lo, a_hi, b_lo, b_hi, diff))
            if len(a_lo) > FRONTIER:
                stack.append((bit, a_lo, a_hi, b_lo, b_hi, diff))
                continue
        # Nodes that lie in one component already need no comparison.
        changes = np.concatenate(([0], np.cumsum(labels[1:] != labels[:-1])))
        done = ((changes[a_hi - 1] == changes[a_lo]) & (changes[b_hi - 1] == changes[b_lo])
                & (labels[a_lo] == labels[b_lo]))
        own = a_lo == b_lo
        done |= own & (a_hi - a_lo < 2)
        a_lo, a_hi, b_lo, b_hi, diff, own = (x[~done] for x in (a_lo, a_hi, b_lo, b_hi, diff, own))
        if not len(a_lo):
            continue
        # Few leaves: compare them directly.
        small = (a_hi - a_lo) * (b_hi - b_lo) <= LEAF_PAIRS
        if bit < 0:
            small[:] = True
        if small.any():
            i, j = _leaf_pairs(a_lo[small], a_hi[small], b_lo[small], b_hi[small])
            hit = (i != j) & (_popcount(codes[i] ^ codes[j]) <= max_bits)
            labels = _unite(labels, i[hit], j[hit])
            a_lo, a_hi, b_lo, b_hi, diff, own = (x[~small] for x in (a_lo, a_hi, b_lo, b_hi, diff, own))
            if not len(a_lo):
                continue
        # Every leaf pair is within the budget when the bits left cannot exceed it.
        clique = diff + bit + 1 <= max_bits
        if clique.any():
            for x_lo, x_hi, y_lo in ((a_lo, a_hi, b_lo), (b_lo, b_hi, a_lo)):
                size = (x_hi - x_lo)[clique]
                rows = np.repeat(x_lo[clique] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                labels = _unite(labels, rows, np.repeat(y_lo[clique], size))
            a_lo, a_hi, b_lo, b_hi, diff, own = (x[~clique] for x in (a_lo, a_hi, b_lo, b_hi, diff, own))
            if not len(a_lo):
                continue
        if bit not in ones_before:
            ones_before[bit] = np.concatenate(
                ([0], np.cumsum((codes >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        ones = ones_before[bit]
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        children = []
        for (p_lo, p_hi, a_bit) in ((a_lo, a_mid, 0), (a_mid, a_hi, 1)):
            for (q_lo, q_hi, b_bit) in ((b_lo, b_mid, 0), (b_mid, b_hi, 1)):
                d = diff + (a_bit != b_bit)
                fit = (p_lo < p_hi) & (q_lo < q_hi) & (d <= max_bits)
                if a_bit > b_bit:
                    fit &= ~own          # a node paired with itself needs its mixed pair once
                children.append((p_lo[fit], p_hi[fit], q_lo[fit], q_hi[fit], d[fit]))
        # Pairs with fewer differing bits are taken first: they join most components early.
        stack.append((bit - 1, *(np.concatenate([children[k][c] for k in (1, 2)]) for c in range(5))))
        stack.append((bit - 1, *(np.concatenate([children[k][c] for k in (0, 3)]) for c in range(5))))
    return labels


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the ``max_bits + 1`` bit blocks of a fingerprint, from the top."""
    n = max_bits + 1
    widths = [64 // n + (k < 64 % n) for k in range(n)]
    return [(sum(widths[:k]), widths[k]) for k in range(n)]


def links(reps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Spanning links (u, v) between the ids of distinct fingerprints ``reps`` (fp, id)."""
    spark = reps.sparkSession
    blocks = _blocks(max_bits)
    code = F.expr("transform(array({}), (r, t) -> struct(t as t, r as code))".format(", ".join(
        "fp" if not s else f"(shiftleft(fp, {s}) | shiftrightunsigned(fp, {64 - s}))" for s, _ in blocks)))
    rows = reps.select("id", F.explode(code).alias("c")).select("id", "c.t", "c.code")
    rows = rows.withColumn("key", F.expr("case t " + " ".join(
        f"when {t} then shiftrightunsigned(code, {64 - w})" for t, (_, w) in enumerate(blocks)) + " end"))
    # Unsigned order of the rotated code within its trie.
    rows = rows.withColumn("ord", F.expr("code ^ (-9223372036854775807L - 1L)"))
    rows = rows.repartition(partitions(spark), "t", "key").sortWithinPartitions("t", "key", "ord", "id")

    def flush(t, key, code, ids):
        order = t * (1 << 20) + key
        out = []
        for table in np.unique(t):
            at = t == table
            codes, group, own = code[at].view(np.uint64), order[at], ids[at]
            labels = trie_components(codes, group, 63 - blocks[int(table)][1], max_bits)
            linked = labels != np.arange(len(labels))
            out.append((own[linked], own[labels[linked]]))
        u, v = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                    for c in ("t", "key", "code", "id")]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if len(held[0]) >= TRIE_ROWS:  # whole tries only: the last one may go on in the next batch
                last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
                cut = int(np.argmax(last))
                if cut:
                    yield flush(*(x[:cut] for x in held))
                    held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield flush(*held)

    return rows.select("t", "key", "code", "id").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    shingle_words: int = WORDS_PER_SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, fingerprint as 16 hex digits, component_id).

    ``component_id`` is the smallest id that can be reached over links of ``max_bits`` or fewer
    differing bits, itself included. Null and empty texts have fingerprint zero, linked like any
    other. A row with a null id takes part in no link; its component is null. Repeated ids give one
    row each. An empty table gives an empty result. Extra columns are not read."""
    with rows_per_batch(docs.sparkSession, TEXT_ROWS):
        fps = stored(fingerprints(docs, text_col, id_col, shingle_words), "fingerprints")
    classes = components(fps.where("id is not null"), max_bits)
    return fps.join(classes, "fp", "left").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component, component_id) of every fingerprint of ``fps`` (id, fp): the smallest fingerprint it is linked
    with over any number of links, and the smallest id there. Fingerprints are the nodes: an id that stands on unlike
    texts joins nothing."""
    reps = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    found = connected_components(links(reps.select("fp", F.col("fp").alias("id")), max_bits))
    rows = stored(reps.join(found, reps["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")), "fingerprint-components")
    least = rows.groupBy("component").agg(F.min("least").alias("component_id"))
    return stored(rows.select("fp", "component").join(least, "component"), "fingerprint-groups")


def deduplicated(docs: DataFrame, shingle_words: int = WORDS_PER_SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of each group of near copies: the one of smallest doc_id, of several
    such the one whose text and then whose row has the smallest hash, so that a repeated run keeps the same rows. Texts
    that are not linked stay apart even if they share an id. Rows with a null id are in no group and stay. Columns are
    those of ``docs``, whatever their names."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.where("doc_id is not null").select(own.alias("own"), F.col("doc_id").alias("id"), mark.alias("mark"))
    with rows_per_batch(docs.sparkSession, TEXT_ROWS):
        fps = stored(fingerprints(docs.where("doc_id is not null").select(mark.alias("mark"), "text"), "text", "mark", shingle_words),
                     "fingerprints")
    # Texts are looked up by their hash: every copy of a text has the same fingerprint.
    by_text = fps.groupBy(F.col("id").alias("mark")).agg(F.min("fp").alias("fp"))
    groups = stored(by_text.join(components(fps, max_bits).select("fp", "component"), "fp").select("mark", "component"), "text-groups")
    # The list of texts grows with the corpus: never broadcast, the same join at every size.
    first = F.struct("id", "mark", F.xxhash64(F.to_json("own")))
    kept = rows.join(groups.hint("merge"), "mark").groupBy("component").agg(F.min_by("own", first).alias("own"))
    return kept.select("own.*").unionByName(docs.where("doc_id is null"))
