"""Secret scans: fixed patterns plus a token-efficiency test for random strings.

The patterns find assignments of credentials, access-key ids and long hexadecimal runs. The
token-efficiency test looks at every run of 20 or more characters of the base64 / URL alphabet: a
byte-pair vocabulary spends few characters per token on strings it has never seen, so a run with fewer
than ``MAX_CHARS_PER_TOKEN`` characters per token is random. Known digests (hexadecimal strings of a
digest's length, base64 of a digest's length after its algorithm's name, UUIDs) and identifiers (names, numbers,
dates and versions joined by separators, few of whose characters are in long pieces or pieces of many parts; words joined by capital letters,
where the vocabulary knows the words) are excluded first. A run that is not random as a whole, a path or
a URL for instance, is tested piece by piece between its separators, and what a pattern's span leaves of a run on
its own. The test adds spans; spans of the patterns stay.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.storage import lean

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_RANDOM = 12, 18, 16, 20
MAX_CHARS_PER_TOKEN = 2.2
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
WORDS_IN_ASSIGN = (b"passw", b"secret", b"token", b"api")

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_DIGEST = re.compile(r"(?:0x)?[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NAME = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)")
_TIME = re.compile(r"[0-9]{2,8}T[0-9]{2,9}Z?")
LONGEST_PIECE = 12       # of an identifier that is judged by its pieces
# Base64 digits of a digest of each algorithm, without padding (fixed values: ceil(bits / 6)).
ENCODED_DIGITS = {"md5": 22, "sha1": 27, "sha224": 38, "sha256": 43, "sha384": 64, "sha512": 86, "h1": 43}
_LABELLED = re.compile(r"(?<![A-Za-z0-9])(md5|sha-?(?:1|224|256|384|512)|h1)[-=_/:]([A-Za-z0-9+/_-]+)(={0,2})(?![A-Za-z0-9+/_=-])",
                       re.IGNORECASE)
_LABEL = 8               # characters before a run that may name its algorithm
# Pieces between separators, from wide to narrow: of a path or URL (they may be base64url), of an assignment or
# name (they may be base64), and without any separator.
_PIECES = [re.compile(rf"[^{x}]{{{MIN_RANDOM},}}") for x in ("=", "/=.", "=._-", "+/_.=-")]


def _long_runs(data: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the runs of at least 16 characters of the secret alphabet (all ASCII)."""
    mask = np.concatenate(([False], _RUN[np.frombuffer(data, np.uint8)], [False]))
    edge = np.nonzero(mask[1:] != mask[:-1])[0]
    start, end = edge[::2], edge[1::2]
    at = end - start >= MIN_HEX
    return list(zip(start[at].tolist(), end[at].tolist()))


def is_known(run: str, tokens_of) -> bool:
    """A digest or an identifier: nothing secret in a string that looks random."""
    if _UUID.fullmatch(run) or _DIGEST.fullmatch(run) and len(run.removeprefix("0x")) in DIGEST_LENGTHS:
        return True
    parts = [p for p in re.split(r"[+/_.=-]+", run) if p]
    names = [n for p in parts for n in _NAME.findall(p)]
    if not names or all(n.isdigit() for n in names):
        return True
    # What else is in it is tested piece by piece.
    if 2 * sum(len(p) for p in parts if is_plain(p)) >= sum(map(len, parts)):
        return True
    letters = [n for n in names if not n.isdigit()]
    # Names are words: few switches between cases and digits, letters in long stretches.
    if len(run) / len(names) < 4 or sum(map(len, letters)) / len(letters) < 4:
        return False
    # The vocabulary's tokens are the evidence that they are words.
    return sum(map(len, letters)) / sum(map(tokens_of, letters)) >= MAX_CHARS_PER_TOKEN


def is_plain(piece: str) -> bool:
    """A name, number, date or version: short, and of few stretches of one kind. Random pieces of four characters or
    more seldom are, so that a random string is not excused by the separators it holds by chance."""
    if len(piece) <= 3 or _TIME.fullmatch(piece):
        return True
    names = _NAME.findall(piece)
    if len(piece) <= LONGEST_PIECE:
        return len(names) <= 1 + len(piece) // 4
    return len(names) <= 2 and sum(len(n) for n in names if not n.isdigit()) <= LONGEST_PIECE


def labelled_digests(text: str) -> list[tuple[int, int]]:
    """Ranges of base64 digests that follow their algorithm's name and have its length, name included."""
    return [m.span() for m in _LABELLED.finditer(text)
            if len(m[2]) == ENCODED_DIGITS[m[1].lower().replace("-", "")]]


def is_random(run: str, tokens_of) -> bool:
    return len(run) / tokens_of(run) < MAX_CHARS_PER_TOKEN and not is_known(run, tokens_of)


def random_parts(run: str, tokens_of) -> list[tuple[int, int]]:
    """Ranges of the random strings in ``run``: all of it, or its widest random pieces."""
    if is_random(run, tokens_of):
        return [(0, len(run))]
    found: list[tuple[int, int]] = []
    if _UUID.fullmatch(run):
        return found
    for pieces in _PIECES:
        found += [m.span() for m in pieces.finditer(run)
                  if len(m[0]) < len(run) and not any(a < m.end() and m.start() < b for a, b in found)
                  and is_random(m[0], tokens_of)]
    return found


def find(text: str | None, tokens_of) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as in :data:`KINDS`. Null is empty."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    runs = _long_runs(data)
    lower = data.lower()
    spans = []
    if any(w in lower for w in WORDS_IN_ASSIGN):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if runs:
        ascii_text = len(data) == len(text)
        place = (lambda at: at) if ascii_text else (lambda at: len(data[:at].decode("utf-8", "surrogatepass")))
        assigns, hexes, randoms = [s[1:] for s in spans], [], []
        for a, b in runs:
            run = data[a:b].decode("ascii")
            first, taken = None, []
            for m in ACCESS.finditer(run):
                if len(m[0]) >= MIN_ACCESS:
                    first = place(a) if first is None else first
                    spans.append(("access", first + m.start(), first + m.end()))
                    taken.append(m.span())
            for m in HEX.finditer(run):
                if len(m[0]) >= MIN_HEX:
                    first = place(a) if first is None else first
                    hexes.append(("hex", first + m.start(), first + m.end()))
                    taken.append(m.span())
            if b - a < MIN_RANDOM:
                continue
            if assigns:
                first = place(a) if first is None else first
                taken += [(s - first, e - first) for s, e in assigns if s < first + b - a and first < e]
            # What a pattern has found needs no second span; a digest is none.
            label = data[max(a - _LABEL, 0):a].decode("latin-1")
            taken += [(max(s - len(label), 0), e - len(label)) for s, e in labelled_digests(label + run)]
            last = 0
            for s, e in [*sorted(taken), (b - a, b - a)]:
                if s - last >= MIN_RANDOM:
                    for lo, hi in random_parts(run[last:s], tokens_of):
                        first = place(a) if first is None else first
                        randoms.append(("random", first + last + lo, first + last + hi))
                last = max(last, e)
        spans += hexes + randoms
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def token_counter(path: str):
    """Number of tokens of a string under a tiktoken rank file."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda run: len(coding.encode_ordinary(run))


def scan(docs: DataFrame, ranks_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>) of every row.

    Null and empty texts have no span; null ids stay null; repeated rows are scanned once each; an empty
    table gives an empty result. Extra columns are not read."""
    return _scan(docs, ranks_path, text_col, id_col, None)


def redacted(docs: DataFrame, ranks_path: str, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` in ``text`` and ``n_chars`` recounted.
    Overlapping spans are replaced as one; null texts stay null; all rows and columns are kept."""
    return _scan(docs, ranks_path, "text", "doc_id", mark)


def _scan(docs, ranks_path, text_col, id_col, mark):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        count = token_counter(ranks_path)
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t.as_py(), count)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    def clean(batches):
        count = token_counter(ranks_path)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                out, last = [], 0
                for _, start, end in find(text, count):
                    if start >= last:
                        out += [text[last:start], mark]
                    last = max(last, end)
                texts.append("".join(out) + text[last:] if out else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    if mark is None:
        return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
                           ).mapInArrow(lean(run), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
    out = docs.mapInArrow(lean(clean), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts and span digests of :func:`scan`'s rows."""
    listed = lambda rows: F.concat_ws(",", F.transform(rows, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        listed("spans").alias("spans"), n("random"))
