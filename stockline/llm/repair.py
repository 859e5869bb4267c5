"""Conversation structure repair: the cheapest edits that turn the roles into an alternating dialogue.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant. Turns are aligned to
the grammar string of each feasible length by the Wagner-Fischer recurrence, from the last turn back: with r symbols
left the string goes on with user if r is even, else with assistant, whatever its length, so the lengths share their
cells. Costs are counted beyond what every repair pays (deleting blank and repeated turns, truncated turns); each unit
by which the symbols left differ from the turns left costs at least ``STEP`` of that, so an incumbent's cost bounds
the band of cells that can matter. A first, narrow band gives the incumbent, its cost the band that is enough. Every
length that reaches the least cost is traced from the first turn on, always by the first letter that keeps the cost,
and the audits of all lengths are compared.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.conversations import grouped
from stockline.llm.storage import lean

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
STEP = 2          # an insertion, or the deletion of a turn that would cost 1 as truncated
FIRST_BAND = 8    # excess cost that the first band allows
ROLES = {0: "user", 1: "assistant"}
WHITE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
FAR = 1 << 29


def faults(turns: list[tuple[str, str]]) -> str:
    """One letter a turn: blank, duplicate, truncated, or a dot."""
    seen, found = set(), []
    for turn in turns:
        text = turn[1].rstrip(WHITE)
        found.append("b" if not text else "d" if turn in seen else "." if text[-1] in ".!?" else "t")
        seen.add(turn)
    return "".join(found)


class Alignment:
    """Costs of aligning turns i.. to the last r symbols, in the band |r - turns left| <= width.

    Row i holds r = left[i] - width .. left[i] + width. Only every so many rows are kept; the rows between are made
    again when the trace needs them, so memory grows with the square root of the number of turns times the width."""

    def __init__(self, initials: list[str], found: str, width: int):
        n = len(found)
        self.n, self.width = n, width
        self.must = [f in "bd" for f in found]
        self.cut = [TRUNCATED if f == "t" else 0 for f in found]
        self.keeps = [{"u": 0, "a": 1}.get(c, -1) for c in initials]      # parity of r that a kept turn needs
        self.system = [c == "s" for c in initials]
        self.left = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            self.left[i] = self.left[i + 1] + (not self.must[i])
        self.each = max(1, isqrt(n))
        self.at = np.arange(-width, width + 1)
        last = np.where(self.at >= 0, INSERT * self.at, FAR).astype(np.int64)
        self.kept, self.made = {n: last}, {}
        row = last
        for i in range(n - 1, -1, -1):
            row = self._row(i, row)
            if i % self.each == 0:
                self.kept[i] = row

    def _row(self, i: int, below: np.ndarray) -> np.ndarray:
        r = self.left[i] + self.at
        if self.must[i]:
            row = below + DELETE                                       # as many turns left: the same places
        else:
            row = np.full(len(below), FAR, np.int64)
            row[:-1] = below[1:] + DELETE                              # the same r stands one place higher below
            odd = r % 2
            row = np.minimum(row, below + self.cut[i] + np.where(odd == self.keeps[i], 0, REROLE))
        row[r < 0] = FAR
        # r = 0 takes no symbol: a turn there is deleted.
        if not self.must[i]:
            zero = -self.left[i] + self.width
            if 0 <= zero < len(row):
                row[zero] = below[zero + 1] + DELETE if zero + 1 < len(below) else FAR
        # Insertions go from r - 1 to r.
        run = np.minimum.accumulate(row - INSERT * self.at) + INSERT * self.at
        row = np.where(r < 0, FAR, run)
        return np.minimum(row, FAR)

    def cost(self, i: int, r: int) -> int:
        place = r - self.left[i] + self.width
        if r < 0 or not 0 <= place <= 2 * self.width:
            return FAR
        if i not in self.kept and i not in self.made:
            self.made = {}
            stop = min(self.n, (i // self.each + 1) * self.each)
            row = self.kept[stop]
            for k in range(stop - 1, i - 1, -1):
                self.made[k] = row = self._row(k, row)
        return int((self.kept if i in self.kept else self.made)[i][place])

    def starts(self) -> dict[int, int]:
        """Least cost of each whole length: even ones, and those of a kept system turn before an even rest. What is
        deleted before the system turn is part of the cost."""
        found = {}
        row = self.kept[0]
        for place in np.nonzero(row < FAR)[0].tolist():
            r = self.left[0] + place - self.width
            if r % 2 == 0:
                found[r] = int(row[place])
        gone = paid = 0
        for k in range(self.n):
            if self.system[k] and not self.must[k]:
                for r in self._even(k + 1):
                    total = gone + self.cut[k] + self.cost(k + 1, r)
                    if total < found.get(r + 1, FAR):
                        found[r + 1] = total
            gone += DELETE
            paid += DELETE if self.must[k] else self.cut[k]      # by every repair
            if gone - paid > STEP * (self.width + 1):
                break
        return found

    def _even(self, i: int):
        low = max(2, self.left[i] - self.width)
        return range(low + low % 2, self.left[i] + self.width + 1, 2)

    def audit(self, lengths: list[int], total: int) -> str:
        """The ASCII-least edits of that cost, over strings of these lengths. Their audits are traced side by side, letter
        by letter; a length whose letter is larger is out."""
        out, i, spent = [], 0, 0
        # r left, and the turns that may be the system turn still to come.
        going = [(r, self._system_turns(r, total) if r % 2 else None) for r in lengths]
        while i < self.n or going[0][0]:
            steps = [self._step(i, r, systems, total - spent) for r, systems in going]
            letter = min(s[0] for s in steps)
            going = [(r, systems) for e, r, systems in steps if e == letter]
            out.append(letter)
            if letter == "I":
                spent += INSERT
                continue
            spent += DELETE if letter == "D" else self.cut[i] + (REROLE if letter == "R" else 0)
            i += 1
        return "".join(out)

    def _step(self, i: int, r: int, systems: list[int] | None, to_go: int) -> tuple:
        """(letter, r, system turns) of the least letter that keeps the cost."""
        if systems is not None:
            # Only deletions come before the system turn, and D is the least letter.
            return ("D", r, systems) if systems[-1] > i else ("K", r - 1, None)
        if i < self.n and self.cost(i + 1, r) + DELETE == to_go:
            return "D", r, None
        if r and self.cost(i, r - 1) + INSERT == to_go:
            return "I", r - 1, None
        return ("K" if r % 2 == self.keeps[i] else "R"), r - 1, None

    def _system_turns(self, length: int, total: int) -> list[int]:
        """System turns with which the length reaches the cost, ascending."""
        return [k for k in range(min(self.n, total // DELETE + 1)) if self.system[k] and not self.must[k]
                and DELETE * k + self.cut[k] + self.cost(k + 1, length - 1) == total]


def align(initials: list[str], found: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of turns with these role initials and faults; ties ASCII-least."""
    paid = sum(DELETE if f in "bd" else TRUNCATED if f == "t" else 0 for f in found)
    excess = FIRST_BAND
    while True:
        made = Alignment(initials, found, excess // STEP + 1)
        whole = made.starts()
        best = min(whole.values(), default=FAR)
        if best - paid <= excess:
            break
        # The incumbent's own excess is a band that holds every repair as cheap.
        excess = best - paid if best < FAR else 2 * excess + DELETE * len(found)
    return best, made.audit([length for length, cost in whole.items() if cost == best], best)


def apply(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The repaired (role, text) turns."""
    left = sum(e != "D" for e in audit)
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "I":
            out.append((ROLES[left % 2], ""))
        else:
            out.append(turns[i] if edit == "K" else (ROLES[left % 2], turns[i][1]))
            i += 1
        left -= 1
    return out


_OUT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string, faults string")
_ARROW = [pa.int64()] * 7 + [pa.string()] * 3
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _turn_rows(conversations: DataFrame) -> DataFrame:
    """Turns by conversation, in order; a conversation's own row comes first, so that one without turns is kept."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    given = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text]
    extra = [F.col("present") if "present" in conversations.columns else F.lit(True).alias("present")]
    return conversations.where("conv_id is not null").select(*given, *extra).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "turn", "role", "text", "present")


def repairs(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, faults).

    Turns stand by turn (null first), equal numbers by role and text. Null roles and texts are one space. A turn's first
    fault counts: blank, duplicate (role and text seen earlier), truncated (last character not one of .!?). ``gaps``
    are numbers missing between the smallest and largest turn, nulls ignored; ``illegal`` counts neighbours whose role
    initials are not su, ua or au. A role that is empty has no initial and can't be kept. Rows without a conv_id are
    left out. A boolean column ``present`` that is false marks a row that only names its conversation. A conversation
    is one alignment and is held by one task, with its texts; conversations are dealt out by id."""
    def run(batches):
        out = []
        for (conv,), rows in grouped(batches, 1):
            rows = [r for r in rows if r[3]]
            turns = [(r[1], r[2]) for r in rows]
            numbers = {r[0] for r in rows if r[0] is not None}
            gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
            found = faults(turns)
            initials = [role[:1] for role, _ in turns]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            cost, audit = align(initials, found) if turns else (0, "")
            lines = "\n".join(f"{role}:{text}" for role, text in apply(turns, audit))
            out.append((conv, gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit,
                        hashlib.sha256(lines.encode("utf-8", "surrogatepass")).hexdigest(), found))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW)], _NAMES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW)], _NAMES)

    return _turn_rows(conversations).mapInArrow(lean(run), _OUT)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations, one row per turn: (conv_id, turn from 0, role, text). Rules as in :func:`repairs`."""
    def run(batches):
        for (conv,), rows in grouped(batches, 1):
            turns = [(r[1], r[2]) for r in rows if r[3]]
            if not turns:
                continue
            done = apply(turns, align([role[:1] for role, _ in turns], faults(turns))[1])
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv] * len(done), pa.int64()), pa.array(range(len(done)), pa.int64()),
                     pa.array([r for r, _ in done], pa.string()), pa.array([t for _, t in done], pa.string())],
                    ["conv_id", "turn", "role", "text"])

    return _turn_rows(conversations).mapInArrow(lean(run), "conv_id long, turn long, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations damaged by rule, for measuring repairs: crc32 of "conv_id:turn" modulo 20 drops a turn (0), empties its
    text (1), removes its .!? (2), repeats it (3) or sets its role to user (4). Nulls count as one space. A dropped turn
    leaves a row with ``present`` false."""
    space = F.lit(" ")
    code = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    rows = rows.withColumn("code", code)
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") != 0).alias("present"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
