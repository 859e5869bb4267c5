"""Whitespace words of a batch of texts as Arrow dictionaries.

Words are runs of characters other than 0x20 and 0x09-0x0D. A batch is handled in slices of a few
megabytes, so memory follows the slice (or the single longest text), not the partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def slices(texts: pa.Array, slice_bytes: int = SLICE_BYTES):
    """(first, last) row ranges whose texts hold about ``slice_bytes`` bytes; one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > slice_bytes:
            yield lo, i
            lo, total = i, 0
        total += int(size)
    if lo < len(sizes):
        yield lo, len(sizes)


def encoded_words(texts: pa.Array, lower: bool, as_list: bool = True):
    """(words per row, word number of each token, distinct words) of a slice; null is an empty text.

    ``lower`` lower-cases A-Z only."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(split.flatten())
    codes = coded.indices.to_numpy(zero_copy_only=False)
    rows = np.asarray(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
    words = coded.dictionary
    empty = np.nonzero(pc.equal(words, "").to_numpy(zero_copy_only=False))[0]
    if len(empty):  # the splitter returns an empty string before leading and after trailing white space
        real = codes != empty[0]
        owner = np.repeat(np.arange(len(rows)), rows)[real]
        rows = np.bincount(owner, minlength=len(rows)).astype(np.int64)
        codes = codes[real]
        words = words.filter(pc.not_equal(words, ""))
        codes = codes - (codes > empty[0])
    return rows, codes.astype(np.int64), words.to_pylist() if as_list else words
