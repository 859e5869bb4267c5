"""Whole texts to token ids with the ``tokenizers`` library, one library call per distinct word part.

The vocabulary (``word_bpe_49k.json``) lower-cases, drops white space and never merges across it, so
the ids of a text are the ids of its white-space words in turn. A batch's words are dictionary
encoded, each distinct word is split once by the vocabulary's own pattern, each distinct part goes
once through the library's BPE model, and ids are gathered by word number. Ids of remembered words are
kept as little-endian 32-bit bytes, a fraction of the memory of lists of integers. Words with characters
outside printable ASCII and the Latin letters U+00C0-U+024F, and texts that spell a special token,
go through the library's full pipeline unchanged.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stockline.llm.words import encoded_words, slices

CACHE_PARTS = 400_000     # parts remembered per task
CACHE_WORDS = 400_000     # words remembered per task


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordEncoder:
    """Token ids of texts; exact for vocabularies whose pre-tokens never cross white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split).findall
        # Bytes that are not printable in Latin-1 stand for themselves plus 256, in order.
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.byte_letters = {b: 256 + k for k, b in enumerate(odd)}
        self.plain = regex.compile("[!-~À-ÖØ-öø-ɏ]*").fullmatch
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.byte_letters)
            ids = b"".join([self.id_bytes[t.id] for t in self.model.tokenize(letters)])
            if len(self.parts) >= CACHE_PARTS:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def word(self, word: str) -> bytes:
        """Ids of a word whose A-Z are lower-cased."""
        if word.isascii():                      # a word, or a word and one mark: the commonest cases
            if word.isalpha():
                return self.part(word)
            if word[:-1].isalpha() and not word[-1].isdigit() and word.isprintable():
                return self.part(word[:-1]) + self.part(word[-1])
        if self.plain(word):
            parts = self.split(word.lower())
            if len(parts) == 1:
                return self.part(parts[0])
            return b"".join([self.part(p) for p in parts])
        return np.array(self.text(word), "<u4").tobytes()

    def text(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens per row, all ids) of the texts; null is an empty text."""
        texts = pc.fill_null(texts, "")
        apart = np.zeros(len(texts), bool)
        for s in self.special:
            apart |= pc.match_substring(texts, s, ignore_case=True).to_numpy(zero_copy_only=False)
        if apart.any():
            texts = pc.if_else(pa.array(apart), "", texts), texts
            sizes, ids = self._encode(texts[0])
            own = {int(i): np.asarray(self.text(texts[1][int(i)].as_py()), np.uint32) for i in np.nonzero(apart)[0]}
            starts = np.cumsum(sizes) - sizes
            parts = [own[i] if i in own else ids[starts[i]:starts[i] + sizes[i]] for i in range(len(sizes))]
            return np.array([len(p) for p in parts], np.int64), np.concatenate(parts)
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows, codes, words = encoded_words(texts, lower=True)
        if not len(codes):
            return np.zeros(len(rows), np.int64), np.zeros(0, np.uint32)
        known, word = self.words, self.word
        ids = []
        for w in words:
            x = known.get(w)
            if x is None:
                x = word(w)
                if len(known) < CACHE_WORDS:  # the first words are the frequent ones
                    known[w] = x
            ids.append(x)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        first = np.cumsum(sizes) - sizes
        per_token = sizes[codes]
        ends = np.cumsum(per_token)
        out = flat[np.repeat(first[codes] - (ends - per_token), per_token) + np.arange(int(ends[-1]))]
        row_ends = np.concatenate(([0], ends))[np.cumsum(rows)]
        return np.diff(np.concatenate(([0], row_ends))), out


def encoded_slices(texts: pa.Array, encoder: WordEncoder):
    """(first row, last row, tokens per row, ids as unsigned 32-bit) over slices of a few megabytes."""
    for lo, hi in slices(texts):
        sizes, ids = encoder.encode(texts.slice(lo, hi - lo))
        yield lo, hi, sizes, ids
