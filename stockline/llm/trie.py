"""Prefix trie of conversations by vertical bitmaps.

Conversations are cut into shards of ``SPAN`` consecutive ids, long ones also into blocks of ``SPAN`` turns. A shard's
index maps (position, turn) to the bitset of its conversations with that turn there. Going down depth first, the
intersection of a node's bitset with the postings of the next position gives its children; popcounts are their
members, and the bits of conversations that end there are its end list. A node is known across shards by a 128-bit
key of its whole path, so the shards' tries are put together by sums and minima over equal keys; no task holds more
than one shard, however many conversations share a prefix.

Totals over subtrees need no walk up the trie. A node belongs to its smallest conversation, which then owns all
of its own path below it too. Summed over a subtree, the members' bytes less the nodes' bytes are what each member
has there on nodes of others, and each leaf is one owner's end: both are sums over members.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockline.llm.conversations import grouped
from stockline.llm.storage import lean, stored

SPAN = 1024
NO_ENDS = hashlib.sha256(b"").hexdigest()
_ROOT = (0, 0)
_PART = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("q1", pa.int64()), ("q2", pa.int64()), ("depth", pa.int64()),
                   ("n", pa.int64()), ("conv_id", pa.int64()), ("bytes", pa.int64()), ("n_ends", pa.int64()),
                   ("shard", pa.int64()), ("ends", pa.string())])


def _bits(bitset: int):
    while bitset:
        low = bitset & -bitset
        yield low.bit_length() - 1
        bitset ^= low


def descend(rows: list[tuple], first: int, shard: int):
    """The nodes of one shard, depth first, as rows of the partial trie.

    ``rows``: (conv_id, pos, k1, k2, p1, p2, q1, q2, bytes, length), ``first`` the shard's smallest id. A block of
    positions after the first begins at the nodes that its conversations stand on (q1, q2)."""
    postings: dict[int, dict] = defaultdict(dict)     # position -> turn -> bitset
    turns: dict[int, dict] = defaultdict(dict)        # position -> conversation -> (turn, path, bytes)
    live: dict[int, int] = defaultdict(int)           # position -> bitset of those with a turn there
    ending: dict[int, int] = defaultdict(int)         # position -> bitset of those that end there
    begin: dict[tuple, int] = defaultdict(int)        # node to begin at -> bitset
    depth = min(r[1] for r in rows) - 1
    for conv, pos, k1, k2, p1, p2, q1, q2, size, length in rows:
        bit = 1 << (conv - first)
        turn = (k1, k2)
        postings[pos][turn] = postings[pos].get(turn, 0) | bit
        turns[pos][conv - first] = (turn, (p1, p2), size)
        live[pos] |= bit
        if pos == length:
            ending[pos] |= bit
        if pos == depth + 1:
            begin[(q1, q2)] |= bit
    stack = [(depth, node, members, False, None, None) for node, members in begin.items()]
    while stack:
        depth, node, members, own, parent, size = stack.pop()
        if own:
            ends = members & ending[depth]
            listed = ",".join(str(first + b) for b in _bits(ends)) if ends else None
            yield (*node, *(parent or (None, None)), depth, members.bit_count(), first + (members & -members).bit_length() - 1,
                   size, ends.bit_count(), shard, listed)
        left = members & live[depth + 1]
        while left:
            turn, path, size = turns[depth + 1][(left & -left).bit_length() - 1]
            child = left & postings[depth + 1][turn]
            left ^= child
            stack.append((depth + 1, path, child, True, node if depth >= 0 else None, size))


def _placed(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every turn with its path's key and bytes before it, and the root's row (pos 0) of every conversation."""
    h = [F.xxhash64(F.lit(s), "pos", "k1", "k2") for s in (1, 2)]
    rows = turns.join(lengths, "conv_id").withColumns({
        "block": F.floor((F.col("pos") - 1) / SPAN), "h1": h[0], "h2": h[1]})
    within = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Blocks before: one row per SPAN turns of a conversation.
    carried = rows.groupBy("conv_id", "block").agg(
        F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"), F.sum("bytes").alias("t")).select(
        "conv_id", "block", F.bit_xor("t1").over(before).alias("c1"), F.bit_xor("t2").over(before).alias("c2"),
        F.sum("t").over(before).alias("c")).where("c1 is not null")
    nil = F.lit(0).cast("long")
    rows = rows.withColumns({"p1": F.bit_xor("h1").over(within), "p2": F.bit_xor("h2").over(within),
                             "upto": F.sum("bytes").over(within)}).join(carried, ["conv_id", "block"], "left")
    path = [F.col(f"p{i}").bitwiseXOR(F.coalesce(f"c{i}", nil)) for i in (1, 2)]
    rows = rows.select("conv_id", "block", "pos", "k1", "k2", path[0].alias("p1"), path[1].alias("p2"),
                       path[0].bitwiseXOR(F.col("h1")).alias("q1"), path[1].bitwiseXOR(F.col("h2")).alias("q2"), "bytes", "length",
                       (F.col("upto") - F.col("bytes") + F.coalesce("c", nil)).alias("before"))
    root = lengths.select("conv_id", nil.alias("block"), nil.alias("pos"), *[nil.alias(c) for c in (
        "k1", "k2", "p1", "p2", "q1", "q2", "bytes")], "length", nil.alias("before"))
    return rows.unionByName(root)


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node, the root included: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256).

    ``turns``: (conv_id, pos from 1 without gaps, k1, k2, bytes) as of :func:`stockline.llm.conversations.numbered`;
    ``lengths``: (conv_id, length) of every conversation, also of those without turns (they end at the root).
    conv_id is a node's smallest member, n_leaves counts childless nodes of its subtree, itself included, saved_tokens
    adds up (members - 1) x bytes of the last text over it, and ends_sha256 is the digest of the ids that end there,
    ascending and comma-joined. Without conversations there is no node."""
    rows = stored(_placed(turns, lengths), "trie-rows")

    def walk(batches):
        out = []
        for (shard, _), shard_rows in grouped(batches, 2):
            out += descend(shard_rows, shard * SPAN, shard)
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PART)], schema=_PART)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PART)], schema=_PART)

    shards = rows.select(F.floor(F.col("conv_id") / SPAN).alias("shard"), "block", "conv_id", "pos", "k1", "k2", "p1", "p2", "q1", "q2",
                         "bytes", "length")
    parts = stored(shards.repartition("shard", "block").sortWithinPartitions("shard", "block", "conv_id", "pos").mapInArrow(
        lean(walk), "p1 long, p2 long, q1 long, q2 long, depth long, n long, conv_id long, bytes long, n_ends long, shard long, "
                    "ends string"), "trie-parts")
    nodes = stored(parts.groupBy("p1", "p2").agg(
        F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("depth").alias("depth"), F.sum("n").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.min("bytes").alias("bytes"), F.sum("n_ends").alias("n_ends")), "trie-nodes")

    def digest(batches):
        # The pieces of a node's list arrive in order and are never held together.
        keys, now, state = [], None, None
        for batch in batches:
            for p1, p2, _, ends in zip(*[c.to_pylist() for c in batch.columns]):
                if (p1, p2) != now:
                    if now:
                        keys.append((*now, state.hexdigest()))
                    now, state = (p1, p2), hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            if len(keys) >= 20_000:
                yield _digests(keys)
                keys = []
        if now:
            yield _digests([*keys, (*now, state.hexdigest())])

    def _digests(found):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["p1", "p2", "ends_sha256"])

    ends = parts.where("ends is not null").select("p1", "p2", "shard", "ends").repartition("p1", "p2").sortWithinPartitions(
        "p1", "p2", "shard").mapInArrow(lean(digest), "p1 long, p2 long, ends_sha256 string")
    owners = nodes.groupBy("conv_id").agg(F.sum("bytes").alias("owned"), F.max((F.col("n_ends") == F.col("n_convs")).cast("int")).alias("leaf"))
    # Bytes that a conversation has on nodes of others: they come first on its path.
    shared = rows.groupBy("conv_id").agg(F.sum("bytes").alias("total")).join(owners, "conv_id", "left").select(
        "conv_id", (F.col("total") - F.coalesce("owned", F.lit(0))).alias("others"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    totals = rows.join(shared, "conv_id").select(
        "p1", "p2", F.greatest(F.lit(0), F.col("others") - F.col("before")).alias("saved"), F.col("leaf").cast("long").alias("leaves"))
    no = lambda kind: F.lit(None).cast(kind)
    facts = ["q1", "q2", "depth", "n_convs", "conv_id"]

    def fact(df, **given):
        cols = {**{c: no("long") for c in facts}, "child": no("long"), "saved": no("long"), "leaves": no("long"),
                "ends_sha256": no("string")} | given
        return df.select("p1", "p2", *[v.alias(k) for k, v in cols.items()])

    children = nodes.where("depth > 0").select(F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    whole = stored(fact(nodes, **{c: F.col(c) for c in facts}).union(fact(children, child=F.lit(1).cast("long"))).union(
        fact(totals, saved=F.col("saved"), leaves=F.col("leaves"))).union(fact(ends, ends_sha256=F.col("ends_sha256"))).groupBy(
        "p1", "p2").agg(*[F.max(c).alias(c) for c in facts], F.coalesce(F.sum("child"), F.lit(0)).alias("n_children"),
                        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
                        F.coalesce(F.max("ends_sha256"), F.lit(NO_ENDS)).alias("ends_sha256")), "trie-whole")
    # A node with many children is a skewed key of this join, which the engine splits.
    parents = whole.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(parents.hint("merge"), ["q1", "q2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations that begin as the first of their family does.

    Conversation c gets the first h turns of conversation c - c % ``family`` (all if fewer, none if absent), then its
    own after its first h; h is crc32(decimal c) % ``heads``."""
    c = F.col("conv_id")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", "n", (c - F.pmod(c, F.lit(family))).alias("origin"), (F.crc32(c.cast("string").cast("binary")) % heads).alias("h"))
    origins = own.select(c.alias("origin"), F.col("n").alias("n_origin"))
    plan = own.join(origins, "origin", "left").select(
        "conv_id", "origin", "h", F.least("h", F.coalesce("n_origin", F.lit(0))).alias("head"),
        F.greatest(F.lit(0), F.col("n") - F.col("h")).alias("rest"))
    plan = stored(plan.withColumn("length", F.col("head") + F.col("rest")), "trie-plan")
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "origin").join(plan, "origin").where("pos <= head").select(
        "conv_id", "pos", "k1", "k2", "bytes")
    rest = turns.join(plan.where("rest > 0"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "k1", "k2", "bytes")
    return first.union(rest), plan.select("conv_id", "length")
