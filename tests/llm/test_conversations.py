"""op12 and op13 against brute force over whole tables and edge tables."""

import functools
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, p1 string, length int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


def trie_by_hand(rows):
    """The contract over (conv_id, turn, role, text) rows, by lists of whole prefixes."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, v in whole.items():
        for k in range(len(v) + 1):
            members[tuple(v[:k])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for q in members:
        if q:
            children[q[:-1]] += 1
    for q, m in members.items():
        for k in range(len(q) + 1):
            saved[q[:k]] += (len(m) - 1) * (len(q[-1][1].encode()) if q else 0)
            leaves[q[:k]] += children[q] == 0
    out = []
    for q, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(q))
        out.append((min(m), len(q), min(members[q[:-1]]) if q else None, len(m), children[q], leaves[q], saved[q],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(conversations):
    from stockline.llm.conversations import numbered
    from stockline.llm.trie import prefix_trie, rebuilt
    return sorted((tuple(r) for r in prefix_trie(*rebuilt(numbered(conversations))).collect()), key=str)


def test_trie_query(spark):
    from stockline.llm.queries import op12_conversation_trie
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in op12_conversation_trie(spark, SF).collect()), key=str) == trie_by_hand(rows)


def test_trie_of_copies_long_and_odd_conversations(spark, monkeypatch):
    from stockline.llm import trie
    monkeypatch.setattr(trie, "SPAN", 8)      # blocks and shards cut prefixes
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice("ua"), rnd.choice(["x", "é", "", None])) for c in range(60) for t in range(rnd.choice([1, 2, 9, 30]))]
    rows += [(c, t, "s", "same") for c in range(100, 140) for t in range(20)]      # copies over several shards
    rows += [(200, None, None, None), (200, 3, "u", "b"), (200, 3, "u", "b"), (None, 1, "u", "lost"), (10**15, 0, "u", "far")]
    assert trie_of(table(spark, rows)) == trie_by_hand(rows)


def test_trie_of_no_conversations(spark):
    assert trie_of(table(spark, [])) == []
    assert trie_of(table(spark, [(None, 1, "u", "x")])) == []


def exhaustive(initials, found):
    """The least (cost, audit) over every target length, by trying every edit."""
    n, best = len(found), None
    for length in [0, *range(2, 2 * n + 4)]:
        target = "s" * (length % 2) + "ua" * (length // 2)

        @functools.cache
        def go(i, j):
            if i == n and j == length:
                return 0, ""
            ways = []
            if i < n:
                c, a = go(i + 1, j)
                ways.append((c + 3, "D" + a))
            if j < length and target[j] in "ua":
                c, a = go(i, j + 1)
                ways.append((c + 2, "I" + a))
            if i < n and j < length and found[i] not in "bd":
                c, a = go(i + 1, j + 1)
                c += found[i] == "t"
                if initials[i] == target[j]:
                    ways.append((c, "K" + a))
                if target[j] in "ua":
                    ways.append((c + 2, "R" + a))
            return min(ways, default=(10**9, ""))

        best = go(0, 0) if best is None else min(best, go(0, 0))
    return best


def test_alignment_is_the_cheapest_and_least(spark):
    from stockline.llm.repair import align
    rnd = random.Random(3)
    for _ in range(800):
        n = rnd.randint(1, 9)
        initials = [rnd.choice(["s", "u", "u", "a", "a", "t", ""]) for _ in range(n)]
        if rnd.random() < 0.5:
            initials = ["ua"[k % 2] if rnd.random() < 0.8 else c for k, c in enumerate(initials)]
        found = "".join(rnd.choice("....ttbd") for _ in range(n))
        assert align(initials, found) == exhaustive(tuple(initials), found), (initials, found)


WHITE = " \t\n\x0b\x0c\r"


def repair_by_hand(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is None:
            continue
        convs[c]
        r, x = " " if r is None else r, " " if x is None else x
        code = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        if code == 0:
            continue
        if code == 1:
            x = ""
        if code == 2:
            x = "".join(k for k in x if k not in ".!?")
        if code == 4:
            r = "user"
        convs[c] += [(t is not None, t or 0, r, x)] * (2 if code == 3 else 1)
    out = []
    for c, vs in convs.items():
        turns = [v[2:] for v in sorted(vs)]
        found = ""
        for i, (r, x) in enumerate(turns):
            s = x.strip(WHITE)
            found += "b" if not s else "d" if (r, x) in turns[:i] else "." if s[-1] in ".!?" else "t"
        initials = [r[:1] for r, _ in turns]
        cost, audit = exhaustive(tuple(initials), found) if turns else (0, "")
        left, done, i = sum(e != "D" for e in audit), [], 0
        for e in audit:
            role = "assistant" if left % 2 else "user"
            if e == "K":
                done.append(":".join(turns[i]))
            if e == "R":
                done.append(f"{role}:{turns[i][1]}")
            if e == "I":
                done.append(f"{role}:")
            left -= e != "D"
            i += e != "I"
        numbers = {v[1] for v in vs if v[0]}
        out.append((c, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, found.count("b"), found.count("d"), found.count("t"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out)


def test_repair_query(spark):
    from stockline.llm.queries import op13_conversation_repair
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op13_conversation_repair(spark, SF).drop("faults").collect()
    assert sorted(tuple(r) for r in got) == repair_by_hand(rows)


def test_repair_of_odd_rows(spark):
    from stockline.llm.repair import damaged, repaired_turns, repairs
    rnd = random.Random(9)
    rows = [(c, rnd.choice([None, 0, 1, 2, 5]), rnd.choice(["user", "assistant", "system", "tool", "", None]),
             rnd.choice(["Yes.", "no", " \n", "", None, "é?", "x" * 5000 + "!"])) for c in range(40) for _ in range(rnd.randint(1, 7))]
    rows += [(None, 1, "user", "lost.")]
    # Conversations that lose every turn stay.
    rows += [(c, 0, "user", "Hi.") for c in range(1000, 1400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    bad = damaged(table(spark, rows))
    want = repair_by_hand(rows)
    assert sorted(tuple(r) for r in repairs(bad).drop("faults").collect()) == want
    lines = defaultdict(list)
    for r in sorted(repaired_turns(bad).collect()):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() for c, *_ in want} == {w[0]: w[-1] for w in want}
    assert repairs(damaged(table(spark, []))).count() == 0


def test_long_conversation_in_bounded_time():
    from stockline.llm.repair import align, apply
    rnd = random.Random(1)
    initials = ["ua"[k % 2] for k in range(3000) if rnd.random() > 0.04]
    found = "".join(rnd.choice("." * 40 + "tbd") for _ in initials)
    cost, audit = align(initials, found)
    roles = [r[0] for r, _ in apply([({"u": "user", "a": "assistant"}[c], "x") for c in initials], audit)]
    assert "".join(roles) == "ua" * (len(roles) // 2) and roles
    assert cost == sum({"K": 0, "R": 2, "I": 2, "D": 3}[e] for e in audit) + sum(
        f == "t" for f, e in zip(found, audit.replace("I", "")) if e != "D")


@pytest.mark.parametrize("role,want", [("system", "D"), ("user", "KI"), ("assistant", "IK"), ("tool", "D")])
def test_single_turns(role, want):
    from stockline.llm.repair import align
    assert align([role[0]], ".")[1] == want
