"""Language-model scoring with a probabilistic suffix tree (PST) over words.

Symbols are the A-Z lower-cased white-space words of a text and one end token; a state is a context of
up to ``DEPTH`` preceding words of the same document.

* Counting is level by level over all training tokens: a sequence of k words can only be frequent if the
  sequences without its first and without its last word are. Those seen at least ``MIN_COUNT`` times, the same
  number at every corpus size, go on; they are the contexts and the next symbols of the tree.
* A context is retained if its next-symbol distribution diverges from that of the context one word shorter by
  at least ``MIN_DIVERGENCE`` nats more than a sample of its size does by chance.
* Distributions are smoothed by absolute discounting: what is taken from the seen symbols goes to the
  next shorter retained context. The root is the discounted word distribution; the discount's share goes to
  the one class of unknown words, so every text has a probability.
* Each token is scored in the longest retained suffix of what precedes it.

The tree grows with the corpus and is never collected or sent out: its sequences are keyed by a 64-bit hash
(sequences whose hashes are equal would be counted as one). Documents are re-coded once into blocks (the distinct
words of a few megabytes of text, and word numbers in text order). A block gives each of its distinct keys once, sorted
and packed, one cell for each range of keys; Spark shuffles the cells by range, a task adds up one range at a time
and answers every cell, and the answers go back by block into files of the shared folder, one a part of the blocks.
The blocks themselves are never shuffled, and a key takes one row of a range for each block that has it, so
no frequent word or context makes a range large.

:class:`Tree` is the same model in memory, for small vocabularies; the tests compare the two.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.files import PackedWriter, packed, read_packed, unpacked
from stockline.llm.storage import bytes_per_batch, delete_path, lean, partitions, shuffles_freed, stored
from stockline.llm.words import encoded_words, slices
from stockline.session import scratch_path

DEPTH = 3
MIN_COUNT = 2
MIN_DIVERGENCE = 0.02
DISCOUNT = 0.75
BLOCK_BYTES = 4 << 20
RANGE_KEYS = 2_000_000     # keys of all blocks that a task adds up at a time, at most on average


@dataclass
class Level:
    """Frequent sequences of one length: sorted keys, counts, and what scoring needs of each.

    key = (number of the sequence without its last word) * base + number of that word."""
    keys: np.ndarray
    counts: np.ndarray
    suffix: np.ndarray | None = None      # number of the sequence without its first word
    own: np.ndarray | None = None         # discounted P(last word | the words before it)
    rest: np.ndarray | None = None        # as a context: weight of the shorter context
    retained: np.ndarray | None = None    # as a context: kept by the divergence test


@dataclass
class Tree:
    words: dict[str, int] = field(default_factory=dict)   # frequent words; the end token has the last number
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    root: np.ndarray = field(default_factory=lambda: np.zeros(0))   # root probability of the frequent words
    rest: np.ndarray | None = None
    retained: np.ndarray | None = None
    levels: list[Level] = field(default_factory=list)     # of 2, 3, ... words

    @property
    def base(self) -> int:
        return len(self.words) + 2

    @property
    def end(self) -> int:
        return len(self.words)

    def find(self, level: int, prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Numbers of the sequences prefix + word among those of ``level + 2`` words; -1 if absent."""
        keys = self.levels[level].keys
        if not len(keys):
            return np.full(len(prefix), -1, np.int64)
        key = prefix * self.base + word
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((prefix >= 0) & (word >= 0) & (keys[at] == key), at, -1)


def _shift(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The value before each token; -1 at a document's first token."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = -1
    return out


def with_ends(codes: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens with an end token after each document, places of the documents' first tokens)."""
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(len(codes) + len(sizes), end, np.int64)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = codes
    return out, ends - sizes


def candidates(tree: Tree, tokens: np.ndarray, starts: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the sequences one word longer than the tree's levels, in tokens marked ``use``."""
    gram = tokens
    for level in range(len(tree.levels)):
        gram = tree.find(level, _shift(gram, starts), tokens)
    before = _shift(gram, starts)
    at = use & (before >= 0) & (gram >= 0)
    return np.unique(before[at] * tree.base + tokens[at], return_counts=True)


def add_level(tree: Tree, keys: np.ndarray, counts: np.ndarray) -> None:
    """Add the frequent sequences of the next length and finish the contexts one word shorter."""
    order = np.argsort(keys)
    level = Level(keys[order], counts[order])
    prefix, word = level.keys // tree.base, level.keys % tree.base
    shorter = tree.levels[-1] if tree.levels else None
    if shorter is None:
        context_counts, level.suffix, shorter_p = tree.counts, word, tree.root[word]
    else:
        context_counts = shorter.counts
        first_suffix = shorter.suffix[prefix]              # the context without its first word
        at = tree.find(len(tree.levels) - 1, first_suffix, word)
        level.suffix = at
        shorter_p = _probability(tree, len(tree.levels) + 1, first_suffix, word, at)
    level.own = np.maximum(level.counts - DISCOUNT, 0.0) / context_counts[prefix]
    n = len(context_counts)
    rest = np.maximum(1.0 - np.bincount(prefix, level.own, n), 1e-12)
    p = level.own + rest[prefix] * shorter_p
    gain = np.bincount(prefix, p * np.log(p / shorter_p), n)
    unseen = np.maximum(1.0 - np.bincount(prefix, shorter_p, n), 0.0)
    kinds = np.bincount(prefix, minlength=n)
    chance = kinds / (2.0 * np.maximum(context_counts, 1))      # divergence of a sample from its own law
    diverges = (kinds > 0) & (gain + rest * unseen * np.log(rest) - chance >= MIN_DIVERGENCE)
    holder = tree if shorter is None else shorter
    holder.rest, holder.retained = rest, diverges
    tree.levels.append(level)


def _probability(tree: Tree, words: int, context: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """P(word | context) for contexts of ``words - 1`` words; ``at`` numbers context + word, -1 if absent."""
    if words == 1:
        return tree.root[word]
    level = tree.levels[words - 2]
    holder = tree if words == 2 else tree.levels[words - 3]
    inner = np.full(len(word), -1, np.int64)
    if words == 2:
        shorter = tree.root[word]
    else:
        inner_context = holder.suffix[context]
        inner = tree.find(words - 3, inner_context, word)
        shorter = _probability(tree, words - 1, inner_context, word, inner)
    own = np.where(at >= 0, level.own[np.maximum(at, 0)], 0.0)
    return np.where(holder.retained[context], own + holder.rest[context] * shorter, shorter)


def token_probabilities(tree: Tree, tokens: np.ndarray, starts: np.ndarray, root: np.ndarray) -> np.ndarray:
    """P of every token (numbers of frequent words, -1 for others) in its longest retained context.
    ``root`` holds the tokens' root probabilities."""
    p, gram, holder = root, tokens, tree
    for level in range(len(tree.levels)):
        context = _shift(gram, starts)
        gram = tree.find(level, context, tokens)
        if holder.retained is None:
            break
        at = np.maximum(context, 0)
        here = (context >= 0) & holder.retained[at] if len(holder.retained) else np.zeros(len(tokens), bool)
        if here.any():
            own = np.where(gram >= 0, tree.levels[level].own[np.maximum(gram, 0)], 0.0) if len(tree.levels[level].own) else 0.0
            p = np.where(here, own + holder.rest[at] * p, p)
        holder = tree.levels[level]
        gram = np.where(gram >= 0, gram, -1)
    return p


def root_probability(c: np.ndarray, n: int, v: int, discount: float) -> np.ndarray:
    """Discounted share of words seen ``c`` times; 0 is the class of unknown words."""
    if not n:
        return np.ones(len(c))
    return np.where(c > 0, (c - discount) / n, max(discount * v / n, 1.0 / (n + 1)))


def blocks(docs: DataFrame) -> DataFrame:
    """Re-coded documents: two rows per few megabytes of text, the block (what = 0) and its distinct words in the order of
    their hashes (what = 1), which go when they are counted. ``docs`` has (id, held, text)."""
    from pyspark import TaskContext

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            held_all = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in slices(batch.column(2), BLOCK_BYTES):
                rows, codes, words = encoded_words(batch.column(2).slice(lo, hi - lo), lower=True, as_list=False)
                hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False).view(np.int64)
                order = np.argsort(hashes, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                codes, hashes, words = rank[codes], hashes[order], words.take(pa.array(order))
                held = held_all[lo:hi]
                train = np.bincount(codes[~np.repeat(held, rows)], minlength=len(words))
                one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
                first = lambda x: pa.concat_arrays([x, pa.nulls(1, x.type)])
                last = lambda x: pa.concat_arrays([pa.nulls(1, x.type), x])
                yield pa.RecordBatch.from_pydict({
                    "what": pa.array([0, 1], pa.int32()),
                    "block": pa.array([task << 32 | k] * 2, pa.int64()),
                    "ids": first(pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo))),
                    "held": first(one(held, pa.bool_())),
                    "sizes": first(pa.array([rows.astype("<i4").tobytes()])),
                    "codes": first(pa.array([pa.compress(codes.astype("<i4").tobytes(), codec="zstd", asbytes=True)])),
                    "hashes": pa.array([packed([np.diff(hashes, prepend=0)])[0]] * 2),
                    "n": pa.array([len(hashes)] * 2, pa.int64()),
                    "words": last(one(words, pa.string())),
                    "train": last(one(train, pa.int64())),
                    "tokens": first(pa.array([len(codes) + hi - lo], pa.int64())),
                    "ends": first(pa.array([int((~held).sum())], pa.int64()))})
                k += 1
                pa.default_memory_pool().release_unused()

    return docs.select("id", "held", "text").mapInArrow(
        run, "what int, block long, ids array<long>, held array<boolean>, sizes binary, codes binary, hashes binary, n long, "
             "words array<string>, train array<long>, tokens long, ends long")


@dataclass
class Packed:
    """Columns of 8 bytes a block, in one file per part of the blocks."""
    files: dict[int, str]       # part -> file
    columns: int

    def of(self, part: int, block: int) -> list[np.ndarray]:
        if part not in self.files:
            return [np.zeros(0, np.int64)] * self.columns
        return read_packed(self.files[part], block, self.columns)


def part_of(spark, block="block"):
    """The part a block belongs to; as many as the session has shuffle partitions."""
    return F.pmod(F.hash(block), F.lit(partitions(spark)))


# What cells carry, and the number of columns of the answer.
WORDS, SEQUENCES, TOTALS, GAINS = range(4)
ANSWERED = {WORDS: 1, SEQUENCES: 1, TOTALS: 2, GAINS: 2}
CELLS = "kind int, slice int, block long, data binary, plain long"


def ranges_of(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, first, last) of the ranges that the sorted ``keys`` fall into."""
    slot = ((keys >> 32) + (1 << 31)) * ranges >> 32
    edge = np.nonzero(np.concatenate(([True], slot[1:] != slot[:-1], [True])))[0] if len(keys) else np.zeros(1, np.int64)
    return list(zip(slot[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist()))


def dealt(block: int, kind: int, keys: np.ndarray, columns: list[np.ndarray], ranges: int) -> pa.RecordBatch:
    """Cells of a block's sorted keys and their columns of 8 bytes, one for each range."""
    cells = [(slot, *packed([np.diff(keys[lo:hi], prepend=0), *(c[lo:hi] for c in columns)])) for slot, lo, hi in ranges_of(keys, ranges)]
    return _cells(block, kind, cells)


def _cells(block: int, kind: int, cells: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
    n = len(cells)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array([c[0] for c in cells], pa.int32()), pa.array(np.full(n, block, np.int64)),
         pa.array([c[1] for c in cells], pa.binary()), pa.array([c[2] for c in cells], pa.int64())],
        ["kind", "slice", "block", "data", "plain"])


def word_cells(table: DataFrame, ranges: int) -> DataFrame:
    """Cells of the blocks' words themselves and their training counts: words are counted as such, not by hash."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block, hashes, n, words, train = (batch.column(i)[k] for i in range(5))
                rows = pa.RecordBatch.from_arrays([words.values, train.values], ["word", "train"])
                cells = []
                for slot, lo, hi in ranges_of(_hashes(hashes.as_py(), n.as_py()), ranges):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(rows.slice(lo, hi - lo))
                    cells.append((slot, sink.getvalue().to_pybytes(), 0))
                yield _cells(block.as_py(), WORDS, cells)

    return table.select("block", "hashes", "n", "words", "train").mapInArrow(lean(run), CELLS)


def _hashes(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, 8 * n, 1)[0])


def _words_answer(cells: list[tuple[bytes, int]]) -> tuple[list[int], list[np.ndarray], list[int]]:
    tables = [pa.ipc.open_stream(data).read_all().combine_chunks() for data, _ in cells]
    words = pa.concat_arrays([x.cast(pa.large_string()) for t in tables for x in t.column("word").chunks])
    which = pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False)
    c = np.bincount(which, np.concatenate([t.column("train").to_numpy() for t in tables])).astype(np.int64)
    return [len(t) for t in tables], [c[which]], [int(c.sum()), *(int(x.sum()) for x in (c > 0, c == 1, c == 2))]


def _answer(kind: int, cells: list[tuple[bytes, int]], floor: float) -> tuple[list[int], list[np.ndarray], list[int]]:
    """(rows of each cell, columns of the answer to all rows, totals) of one range; ``cells`` in the order of their blocks.

    To words: the count. To sequences: 2 * count + whether the block speaks for the sequence, 0 for rare ones. To totals:
    kinds and sum of the frequent next symbols of a context. To gains: these two of retained contexts, 0 for others."""
    if kind == WORDS:
        return _words_answer(cells)
    columns = {SEQUENCES: 2, TOTALS: 3, GAINS: 4}[kind]
    rows = [unpacked(data, plain, columns) for data, plain in cells]
    sizes = [len(r[0]) for r in rows]
    distinct, which = np.unique(np.concatenate([np.cumsum(r[0]) for r in rows]), return_inverse=True)
    cols = [np.concatenate([r[k] for r in rows]) for k in range(1, columns)]
    del rows
    added = lambda x: np.bincount(which, x, len(distinct))
    if kind == SEQUENCES:
        many, seen = added(cols[0]).astype(np.int64), np.nonzero(cols[0] > 0)[0][::-1]
        first = np.full(len(distinct), -1, np.int64)
        first[which[seen]] = seen           # the last to be assigned, of the smallest block, stays
        mark = np.where(many[which] >= floor, 2 * many[which] + (first[which] == np.arange(len(which))), 0)
        return sizes, [mark], [int((many >= floor).sum())]
    if kind == TOTALS:
        return sizes, [added(c).astype(np.int64)[which] for c in cols], [0]
    # Rounded: the order of a sum decides nothing.
    kept = np.round(added(cols[0].view(np.float64)), 9) >= MIN_DIVERGENCE
    out = []
    for c in cols[1:]:
        total = np.zeros(len(distinct), np.int64)
        np.maximum.at(total, which, c)      # every block that speaks in the context knows it; others say 0
        out.append(np.where(kept, total, 0)[which])
    return sizes, out, [0]


def _rest(kinds: np.ndarray, seen: np.ndarray, big: np.ndarray) -> np.ndarray:
    """Weight of the shorter context, from the kinds and the sum of a context's frequent next symbols and its count."""
    return np.maximum(1.0 - (seen - DISCOUNT * kinds) / np.maximum(big, 1), 1e-12)


def exchanged(cells: DataFrame, ranges: int, floor: float, name: str) -> dict[int, tuple[Packed, list[int]]]:
    """kind -> (files with the answers to the blocks' keys, totals). Only the files' names and totals reach the driver."""
    spark = cells.sparkSession
    folder = scratch_path(spark, name)

    def groups(batches, keys: int):
        """(first ``keys`` columns, rows of the others) of neighbouring rows that agree in the first."""
        now, rows = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:keys] != now:
                    if rows:
                        yield now, rows
                    now, rows = row[:keys], []
                rows.append(row[keys:])
        if rows:
            yield now, rows

    def answer(batches):
        for (kind, slot), rows in groups(batches, 2):
            sizes, columns, totals = _answer(kind, [r[1:] for r in rows], floor)
            ends = np.cumsum(sizes).tolist()
            out = [packed([c[hi - size:hi] for c in columns]) for size, hi in zip(sizes, ends)]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, slot, np.int32)), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([d for d, _ in out], pa.binary()), pa.array([p for _, p in out], pa.int64()),
                 pa.array([totals] + [None] * (n - 1), pa.list_(pa.int64()))],
                ["kind", "slice", "block", "data", "plain", "totals"])

    def write(batches):
        writer, now, totals, done = None, None, None, []
        for (part, kind, block), rows in groups(batches, 3):
            if (part, kind) != now:
                if writer:
                    done.append((*now, writer.close(), totals))
                writer, now, totals = PackedWriter(folder), (part, kind), None
            cells = [unpacked(data, plain, ANSWERED[kind]) for data, plain, _ in rows]
            writer.add(block, [np.concatenate(c) for c in zip(*cells)])
            for t in (r[2] for r in rows if r[2] is not None):
                totals = [x + y for x, y in zip(totals, t)] if totals else t
        if writer:
            done.append((*now, writer.close(), totals))
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64())))],
                ["part", "kind", "file", "totals"])

    answers = cells.repartition(ranges, "slice").sortWithinPartitions("kind", "slice", "block").mapInArrow(
        lean(answer), CELLS + ", totals array<long>")
    files = answers.select(part_of(spark).alias("part"), "kind", "block", "data", "plain", "totals", "slice").repartition(
        partitions(spark), "part").sortWithinPartitions("part", "kind", "block", "slice").drop("slice").mapInArrow(
        lean(write), "part int, kind int, file string, totals array<long>").collect()
    return {kind: (Packed({r.part: r.file for r in files if r.kind == kind}, columns),
                   [sum(t) for t in zip(*[r.totals for r in files if r.kind == kind and r.totals])])
            for kind, columns in ANSWERED.items()}


def _longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of the sequences context + word."""
    z = context.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


END_HASH = 0x5EED_0E4D


@dataclass
class LevelFiles:
    """What the blocks know of their sequences of one length, in the order of their keys."""
    marks: Packed                   # 2 * count + whether the block speaks for the sequence, 0 for rare ones
    totals: Packed | None = None    # of the contexts the block speaks in: kinds and sum of the frequent next symbols
    kept: Packed | None = None      # of all the block's contexts: these two if retained, else 0


@dataclass
class Facts:
    """What every task knows of the corpus: a few numbers and the names of the blocks' files."""
    n: int
    v: int
    discount: float
    ends: int
    floor: float
    ranges: int
    counts: Packed                                              # words' counts
    levels: list[LevelFiles] = field(default_factory=list)      # frequent sequences of 2, 3, ... words


@dataclass
class Walk:
    """The tokens of a block and the longest sequences that end at each."""
    starts: np.ndarray
    word: np.ndarray       # hash
    count: np.ndarray      # of the word
    key: np.ndarray        # hash of the sequence
    valid: np.ndarray      # it is frequent
    number: np.ndarray     # its place in ``names``; -1 for rare ones
    names: np.ndarray      # the block's frequent sequences, sorted
    sizes: np.ndarray      # their counts
    p: np.ndarray          # probability of the word in its longest retained context so far
    cells: list[tuple[int, np.ndarray, list[np.ndarray]]] = field(default_factory=list)   # (kind, keys, columns) to be exchanged

    def longer(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the sequence before each token; places of the sequences one word longer that may be frequent; their
        hashes)."""
        context = _shift(self.number, self.starts)
        at = np.nonzero((context >= 0) & self.valid)[0]
        return context, at, _longer(_shift(self.key, self.starts)[at], self.word[at])


def walk(part: int, block: int, sizes: np.ndarray, codes: np.ndarray, hashes: np.ndarray, facts: Facts) -> Walk:
    c = np.append(facts.counts.of(part, block)[0] if len(hashes) else np.zeros(0, np.int64), facts.ends)
    tokens, starts = with_ends(codes, sizes, len(hashes))
    word, frequent = np.append(hashes, END_HASH)[tokens], c[:-1] >= facts.floor
    out = Walk(starts, word, c[tokens], word, c[tokens] >= facts.floor, np.append(_places(frequent), -1)[tokens],
               hashes[frequent], c[:-1][frequent], root_probability(c, facts.n, facts.v, facts.discount)[tokens])
    for level in facts.levels:
        context, at, keys = out.longer()
        distinct, which = np.unique(keys, return_inverse=True)
        marks = level.marks.of(part, block)[0]
        frequent, many = marks > 0, marks >> 1
        if level.kept is None:
            _tell(out, level.totals and level.totals.of(part, block), context, at, which, marks)
        else:
            kinds, seen = level.kept.of(part, block)
            known = np.nonzero(context >= 0)[0]
            known = known[kinds[context[known]] > 0]
            own = np.zeros(len(word))
            own[at] = np.where(frequent, (many - DISCOUNT), 0.0)[which] / out.sizes[context[at]]
            place = context[known]
            out.p[known] = own[known] + _rest(kinds, seen, out.sizes)[place] * out.p[known]
        out.key, out.valid, out.number = np.zeros(len(word), np.int64), np.zeros(len(word), bool), np.full(len(word), -1, np.int64)
        out.key[at], out.valid[at], out.number[at] = keys, frequent[which], _places(frequent)[which]
        out.names, out.sizes = distinct[frequent], many[frequent]
    return out


def _places(marked: np.ndarray) -> np.ndarray:
    """Place of each marked value among the marked; -1 for others."""
    return np.where(marked, np.cumsum(marked) - 1, -1)


def _tell(state: Walk, totals: list[np.ndarray] | None, context: np.ndarray, at: np.ndarray, which: np.ndarray, marks: np.ndarray) -> None:
    """What the block has to say of the contexts of a level that is not finished, for the sequences it speaks for: kinds
    and sum of the next symbols; then, when their totals are known, its share of the divergence."""
    some = np.empty(len(marks), np.int64)
    some[which] = at                       # one of the places of each sequence
    spoken = np.nonzero(marks & 1)[0]
    some, many, n = some[spoken], marks[spoken] >> 1, len(state.names)
    holder = context[some]
    here = np.bincount(holder, minlength=n)
    own = here > 0
    if totals is None:
        state.cells.append((TOTALS, state.names[own], [here[own], np.bincount(holder, many, n).astype(np.int64)[own]]))
        return
    kinds, seen = (np.zeros(n, np.int64) for _ in range(2))
    kinds[own], seen[own] = totals
    rest, shorter = _rest(kinds, seen, state.sizes), state.p[some]
    p = (many - DISCOUNT) / state.sizes[holder] + rest[holder] * shorter
    gain = np.bincount(holder, p * np.log(p / shorter), n).astype(float)      # without holders, bincount gives integers
    # What is left to unseen symbols, and what a sample diverges by chance, shared by kinds.
    gain += rest * np.log(rest) * (here / np.maximum(kinds, 1) - np.bincount(holder, shorter, n)) - here / (2.0 * np.maximum(state.sizes, 1))
    state.cells.append((GAINS, state.names, [gain, kinds, seen]))


def _walks(batches, facts: Facts):
    """(batch, row, block, sizes, held, walk) of every block."""
    for batch in batches:
        for k in range(batch.num_rows):
            cell = lambda name: batch.column(batch.schema.get_field_index(name))[k]  # noqa: B023, E731
            sizes = np.frombuffer(cell("sizes").as_py(), "<i4").astype(np.int64)
            codes = np.frombuffer(pa.decompress(cell("codes").as_py(), 4 * int(sizes.sum()), codec="zstd"), "<i4").astype(np.int64)
            hashes = _hashes(cell("hashes").as_py(), cell("n").as_py())
            held = cell("held").values.to_numpy(zero_copy_only=False).astype(bool)
            block = cell("block").as_py()
            yield batch, k, block, sizes, held, walk(cell("part").as_py(), block, sizes, codes, hashes, facts)


def cells(table: DataFrame, facts: Facts, longer: bool) -> DataFrame:
    """Cells of every block: what the levels that are not finished need, and if ``longer`` its distinct sequences one word
    longer than the levels, with their training count in the block."""

    def run(batches):
        for _, _, block, sizes, held, state in _walks(batches, facts):
            if longer:
                _, at, keys = state.longer()
                keys, which = np.unique(keys, return_inverse=True)
                state.cells.append((SEQUENCES, keys, [np.bincount(which, np.repeat(~held, sizes + 1)[at], len(keys)).astype(np.int64)]))
            for kind, keys, columns in state.cells:
                yield dealt(block, kind, keys, columns, facts.ranges)

    return table.mapInArrow(lean(run), CELLS)


def grow(table: DataFrame, facts: Facts, depth: int) -> None:
    """Adds the levels to ``facts``. A pass over the blocks counts the next level, adds up the contexts of the last one and
    tests those of the one before."""
    longer = depth > 0
    while longer or any(level.kept is None for level in facts.levels):
        found = exchanged(cells(table, facts, longer), facts.ranges, facts.floor, "lm-level")
        for level in facts.levels:
            if level.totals is None:
                level.totals = found[TOTALS][0]
            elif level.kept is None:
                level.kept = found[GAINS][0]
        if longer:
            marks, totals = found[SEQUENCES]
            if sum(totals):
                facts.levels.append(LevelFiles(marks))
            longer = sum(totals) > 0 and len(facts.levels) < depth


def scored(docs: DataFrame, held_out, depth: int = DEPTH, min_share: float = 0.0,
           text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held_out`` is a boolean column: rows the counts and the tree do not learn from. ``min_share`` asks more than
    ``MIN_COUNT`` occurrences of a sequence: that share of all training tokens. Null texts are empty
    (the end token alone); null ids stay null; repeated rows are scored once each; an empty table gives an
    empty result. Without training rows every count is 0 and ``score`` is 0. Extra columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held"),
                       F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    with shuffles_freed(spark):
        return _scored(rows, depth, min_share)


def _scored(rows: DataFrame, depth: int, min_share: float) -> DataFrame:
    spark = rows.sparkSession
    table = stored(blocks(rows), "lm-blocks", "what")
    with bytes_per_batch(spark, BLOCK_BYTES):
        ends, most = (int(x or 0) for x in table.where("what = 0").agg(F.sum("ends"), F.sum("tokens")).first())
        ranges = max(partitions(spark), -(-most // RANGE_KEYS))
        counts, totals = exchanged(word_cells(table.where("what = 1"), ranges), ranges, 0.0, "lm-counts")[WORDS]
        delete_path(spark, f"{table._stored_path}/what=1")
    n, v, once, twice = totals or [0] * 4
    n, v = n + ends, v + (ends > 0)
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    facts = Facts(n, v, discount, ends, max(float(MIN_COUNT), min_share * n), ranges, counts)
    table = table.where("what = 0").select("block", part_of(spark).alias("part"), "ids", "held", "sizes", "codes", "hashes", "n")

    def finish(batches):
        log_all = math.log10(n + 0.1 * (v + 1))
        for batch, k, _, sizes, held, state in _walks(batches, facts):
            total = lambda x: np.add.reduceat(x, state.starts)  # noqa: B023, E731  every document has its end token
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("ids"))[k].values, pa.array(held),
                 pa.array(sizes + 1), pa.array(total((state.count > 0).astype(np.int64))),
                 pa.array(np.full(len(sizes), n, np.int64)), pa.array(total(np.log10(state.count + 0.1) - log_all)),
                 pa.array(total(np.log10(state.p)))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    with bytes_per_batch(spark, BLOCK_BYTES):
        grow(table.drop("ids"), facts, depth)
        return stored(table.mapInArrow(
            lean(finish), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
                          "score double"), "lm-scores")
