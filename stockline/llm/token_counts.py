"""Token counts without tokens: a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word by their end; dynamic programming
carries, for every position, the best score and its number of pieces, never the pieces. The rules are
those of the unigram model of the ``tokenizers`` library with byte fallback:

* white space becomes U+2581, one is put in front of a text that does not start with it, and a text is cut
  before each of them; a cut is the model's unit, so equal units are counted once per task;
* of equally good paths to a position the one found first stays, starts in ascending order (so the one
  with the longest last piece): only a strictly better score replaces it;
* a character that is no piece by itself may be unknown at the lowest score less 10; it counts as its bytes.

The vocabulary is a public piece file; as unigram scores its pieces get the log-probabilities of Zipf's
law over their ranks, ``-ln(rank + 1)``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.storage import lean
from stockline.llm.words import slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 150_000


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file by id."""
    import sentencepiece
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(pieces.id_to_piece(i), -math.log(i + 1)) for i in range(pieces.get_piece_size())]


class Counter:
    """(number of tokens, best score) of the units of a text."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def unit(self, unit: str) -> tuple[int, float]:
        best = [0.0] + [None] * len(unit)
        count = [0] * (len(unit) + 1)
        at = 0                                   # positions up to here are final
        unknown = self.unknown

        def close(upto: int) -> None:
            """Let unknown characters end the positions that no single-character piece has reached."""
            nonlocal at
            while at < upto:
                at += 1
                if not single[at]:
                    score = best[at - 1] + unknown
                    if best[at] is None or score > best[at]:
                        best[at], count[at] = score, count[at - 1] + len(unit[at - 1].encode("utf-8", "surrogatepass"))

        single = [False] * (len(unit) + 1)
        for last, (size, piece) in self.automaton.iter(unit):
            end = last + 1
            if at < end - 1:
                close(end - 1)
            score = best[end - size] + piece
            if size == 1:
                single[end] = True
            if best[end] is None or score > best[end]:
                best[end], count[end] = score, count[end - size] + 1
        close(len(unit))
        return count[-1], best[-1]

    def word(self, word: str) -> tuple[int, float]:
        found = self.known.get(word)
        if found is None:
            found = self.unit(MARK + word)
            if len(self.known) < CACHE_WORDS:
                self.known[word] = found
        return found

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, best scores) of each text; null and empty texts have none."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), " ", MARK)
        texts = pc.if_else(pc.starts_with(texts, MARK), texts, pc.binary_join_element_wise(MARK, texts, ""))
        split = pc.split_pattern(texts, MARK)    # a first, empty part stands before the first mark
        coded = pc.dictionary_encode(split.flatten())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        found = [self.word(w) for w in coded.dictionary.to_pylist()]
        tokens = np.array([n for n, _ in found], np.int64)
        scores = np.array([s for _, s in found], np.float64)
        sizes = np.asarray(pc.list_value_length(split).to_numpy(zero_copy_only=False), np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        real = np.ones(len(codes), bool)
        real[np.cumsum(sizes) - sizes] = False
        n = len(sizes)
        return (np.bincount(owner[real], tokens[codes[real]], n).astype(np.int64),
                np.bincount(owner[real], scores[codes[real]], n))


def token_counts(docs: DataFrame, vocabulary_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, best_score) of every whole text.

    Null and empty texts have 0 tokens and score 0; null ids stay null; repeated rows are counted once
    each; an empty table gives an empty result. Extra columns are not read."""

    def run(batches):
        counter = Counter(unigram_vocabulary(vocabulary_path))
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo)
                empty = pc.equal(pc.fill_null(texts, ""), "").to_numpy(zero_copy_only=False)
                tokens, scores = counter.texts(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.where(empty, 0, tokens)),
                     pa.array(np.where(empty, 0.0, scores))], ["doc_id", "n_tokens", "best_score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
                       ).mapInArrow(lean(run), "doc_id long, n_tokens long, best_score double")
