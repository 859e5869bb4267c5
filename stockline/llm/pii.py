"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score.

Everything is a built-in column function. The patterns are written so that each text is read in linear time:
runs are matched possessively, and a run is tried from its first character (or the end of the match before)
only. Places come from the texts between the matches: ``split`` gives them, and their lengths add up to code
point offsets. A match is a candidate; the validators (octets of at most 255, Luhn, mod 97, digit counts)
confirm or drop it, with no second try. A confirmed span scores its kind's base value, more where a word of its
kind stands within ``BEFORE`` characters before or ``AFTER`` after it (as far as the neighbouring match of the
kind), less where a word does that tells of something else. The first four kinds always stay, whatever
their score; of the others, those of at least ``min_score``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEFORE, AFTER = 48, 24
BLOCK = 256      # matches whose offsets are added up in one list
MIN_SCORE = 50   # hundredths


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits (not empty) passes the Luhn check."""
    def value(c, i):
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number of A-Z and 0-9 (at least five characters) leaves 1 of 97, its first four moved to the end."""
    def step(a, c):
        return F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _card(m: Column) -> Column:
    return F.when(F.length(_digits(m)).between(14, 19), luhn(_digits(m))).otherwise(False)


def _account(m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)


_OCTET = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_ALWAYS: Callable[[Column], Column] = lambda m: F.lit(True)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its pattern, validator, score and the words (lower case) that change it."""
    name: str
    pattern: str
    holds: str | None        # what a text must contain to have a match
    valid: Callable[[Column], Column]
    score: int
    words: str
    more: int
    other_words: str
    less: int
    base: bool = True        # stays whatever its score


# The contract's patterns, possessive where giving characters back cannot help.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", _ALWAYS, 80,
         r"mail|contact|kontakt|correo|courriel|write to|reach|from:|to:|cc:", 15, r"no-?reply|example", 30),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".",
         lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 60,
         r"\bip\b|address|adresse|direcci|host|server|client|login|visitor", 30, r"version|release|\bv\s?$|section|\bver\b|chapter", 40),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", None, _card, 70,
         r"card|visa|master|amex|credit|debit|kredit|karte|tarjeta|carte|payment", 25, r"isbn|order|serial|tracking|invoice|barcode", 30),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: F.length(_digits(m)).between(10, 15), 70,
         r"tel|phone|call|mobil|cell|fax|whatsapp|llam|appel|rufnummer|\bt:", 25, r"order|serial|version|total|sum\b", 30),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4})(?:\x20(?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){1,6}"
                 r"(?:\x20(?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", None, _account, 70,
         r"iban|account|konto|cuenta|compte|bank|bic|swift|transfer", 25, r"order|serial|part no|license|key", 30, False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", _ALWAYS, 40,
         r"\bssn\b|social sec|tax ?id|taxpayer|seguridad social|sozialvers", 45, r"order|serial|part|invoice|ticket", 20, False),
    Kind("local", r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}[\x20.-]{1,2})\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", None,
         _ALWAYS, 30, r"\btel|phone|call|mobil|\bcell|\bfax|whatsapp|llam|appel|rufnummer", 45, r"order|serial|part|invoice|isbn", 30, False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _score(kind: Kind, near: Column) -> Column:
    points = (F.lit(kind.score) + F.when(near.rlike(kind.words), kind.more).otherwise(0)
              - F.when(near.rlike(kind.other_words), kind.less).otherwise(0))
    return F.least(F.lit(100), F.greatest(F.lit(0), points))


def _blocks(values: Column, run: Callable[[Column, Column], Column]) -> Column:
    """``run`` of each block of ``BLOCK`` values and its number, as an array."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    return F.transform(numbers, lambda b: run(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), b))


def _running(values: Column, first: Column) -> Column:
    """``first`` and then its sums with each value."""
    return F.aggregate(values, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def _places(kind: Kind) -> list[dict[str, Column]]:
    """Columns to add one after the other: matches, whether one holds, the texts between them, and where those begin."""
    k = kind.name
    ok, gaps, lengths, bases = F.col(f"ok_{k}"), F.col(f"g_{k}"), F.col(f"n_{k}"), F.col(f"b_{k}")
    zero = F.lit(0).cast("long")
    found = F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))
    total = _blocks(lengths, lambda part, b: F.aggregate(part, zero, lambda a, x: a + x))
    begins = _blocks(lengths, lambda part, b: F.slice(_running(part, bases[b]), F.lit(1), F.size(part)))
    return [
        {f"m_{k}": found if kind.holds is None else F.when(F.contains("text", F.lit(kind.holds)), found)},
        {f"ok_{k}": F.exists(f"m_{k}", kind.valid)},
        {f"g_{k}": F.when(ok, F.split("text", kind.pattern, -1))},
        {f"n_{k}": F.when(ok, F.transform(f"m_{k}", lambda m, i: (F.length(m) + F.length(gaps[i])).cast("long")))},
        {f"b_{k}": F.when(ok, _running(total, zero))},
        {f"p_{k}": F.when(ok, F.flatten(begins))},
    ]


def scan(docs: DataFrame, min_score: float = MIN_SCORE / 100, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, spans array<struct<start,rank,end,kind,score>>) of every row: whole texts, code points, end exclusive,
    by start, then kind as in :data:`KINDS`. ``score`` is from 0 to 1.

    Null and empty texts have no span; null ids stay null; repeated rows are scanned once each; an empty table
    gives an empty result. Extra columns are not read. Spans of different kinds may overlap; those of one kind
    do not. Offsets of many matches are added up in blocks, so the work stays about linear in their number."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    steps: list[dict[str, Column]] = [{} for _ in range(6)]
    for kind in KINDS:
        for step, columns in zip(steps, _places(kind)):
            step.update(columns)
    for step in steps:
        rows = rows.withColumns(step)

    def spans(rank: int, kind: Kind) -> Column:
        k = kind.name

        def span(m, i):
            gap, rest = F.col(f"g_{k}")[i], F.col(f"g_{k}")[i + 1]
            start = F.col(f"p_{k}")[i] + F.length(gap)
            near = F.lower(F.concat_ws(" ", F.right(gap, F.lit(BEFORE)), F.left(rest, F.lit(AFTER))))
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(m)).alias("end"), F.lit(k).alias("kind"),
                            F.when(kind.valid(m), _score(kind, near) / 100.0).alias("score"))

        least = 0.0 if kind.base else min_score
        return F.when(F.col(f"ok_{k}"), F.filter(F.transform(f"m_{k}", span), lambda s: F.coalesce(s["score"] >= least, F.lit(False))))

    kept = [spans(r, kind) for r, kind in enumerate(KINDS)]
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>")
    return rows.select("doc_id", F.array_sort(F.concat(*[F.coalesce(s, empty) for s in kept])).alias("spans"))


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts, span lists and their digest of :func:`scan`'s rows."""
    listed = lambda part: F.concat_ws(",", F.transform(part, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[n(k) for k in BASE],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        F.concat_ws(",", F.transform("spans", lambda s: F.format_number(s["score"], 2))).alias("scores"))
