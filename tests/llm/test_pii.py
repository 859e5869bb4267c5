"""op11: base spans against plain regular expressions, and the spans that the method adds."""

import hashlib
import re

import pytest

SF = "/root/testdata/sf0.01"


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)]


def by_hand(text):
    spans = sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(m[0]))
    return [f"{name}:{a}:{b}" for a, _, b, name in spans]


def scanned(spark, texts):
    from stockline.llm.pii import digest_columns, scan
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, spans string, m_email string")
    return {r.doc_id: r for r in digest_columns(scan(rows)).collect()}


def check(got, text):
    want = by_hand(text)
    assert got.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (text, got)
    assert [got[f"n_{k}"] for k, *_ in BASE] == [sum(w.startswith(k + ":") for w in want) for k, *_ in BASE]
    assert [s for s in got.spans.split(",") if s.split(":")[0] in {k for k, *_ in BASE}] == want


def test_query_equals_plain_expressions(spark):
    from stockline.llm.queries import op11_pii
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op11_pii(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        check(r, texts[r.doc_id])


def test_odd_texts(spark):
    texts = [None, "", "a@b", "a@b.c", "a@b.co_x@d.com", "a.b@c.d.e.f@g.h", "@@a@@b.c", "😀é a@b.c 😀 +49 (30) 1234567 😀", "1.2.3.4.5.6.7.8",
             "256.1.1.1", "0255.000.1.01", "1.2.3", "..1.2.3.4..", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111",
             "+1 (017) 555-7713", "++1 234 567 8901", "+1", "+12", "+1 2345678901234567", "12345678901234", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5",
             "79927398713 79927398713", "x" * 3000, "7" * 3000, "a" * 3000 + "@" + "b" * 3000, "+1" * 3000, "1." * 9000,
             "a@" + "b." * 9000 + "c", " ".join(f"u{i}@x{i}.org +1 202 555 {i:04d} 10.0.{i % 300}.1" for i in range(1500)), "a@b.c" * 3000]
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        check(got[i], t)


def test_long_runs_are_read_in_linear_time(spark):
    texts = ["x" * 2_000_000, "7" * 2_000_000, "a" * 1_000_000 + "@" + "b" * 1_000_000, "1." * 500_000, "a@" + "b." * 500_000 + "c",
             "10.0.0.1 " * 100_000]
    got = scanned(spark, texts)
    assert [got[i].spans[:20] for i in range(4)] == ["", "", "", "ip:0:7,ip:8:15,ip:16"]
    assert got[4].spans == "email:0:1000003"
    assert got[5].n_ip == 100_000 and got[5].spans.endswith("ip:899991:899999")


def test_base_spans_of_random_texts(spark):
    import random
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab1209.@+- ()_é") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rnd.choice("0123456789 -") for _ in range(rnd.randint(14, 30))) for _ in range(3000)]
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        check(got[i], t)


def mod97_valid(country, body):
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{body}"


@pytest.fixture(scope="module")
def extra(spark):
    good = mod97_valid("DE", "370400440532013000")
    spaced = " ".join(good[i:i + 4] for i in range(0, len(good), 4))
    wrong = good[:-1] + str((int(good[-1]) + 1) % 10)
    texts = {"iban": f"Konto {good}.", "iban spaced": f"IBAN: {spaced} now", "iban wrong": f"IBAN {wrong}", "gb": mod97_valid("GB", "NWBK60161331926819"),
             "ssn": "My SSN is 123-45-6789, ok", "ssn alone": "part 123-45-6789", "ssn area": "SSN 000-12-3456",
             "local": "call me: 202 555-0143 today", "local alone": "numbers 202 555-0143 today", "international": "call +1 (202) 555-0143 today"}
    got = scanned(spark, list(texts.values()))
    return {name: (text, got[i]) for i, (name, text) in enumerate(texts.items())}


def test_checksums_and_context_decide_added_spans(extra):
    kinds = {name: [s.split(":")[0] for s in r.spans.split(",") if s] for name, (_, r) in extra.items()}
    assert kinds == {"iban": ["iban"], "iban spaced": ["iban"], "iban wrong": [], "gb": ["iban"], "ssn": ["ssn"], "ssn alone": [], "ssn area": [],
                     "local": ["local"], "local alone": [], "international": ["phone"]}
    for text, r in extra.values():
        check(r, text)
    assert extra["iban"][1].spans == "iban:6:28"


def test_context_moves_the_score_of_base_spans_only(spark):
    got = scanned(spark, ["version 1.2.3.4", "server 1.2.3.4", "order 4111 1111 1111 1111", "visa 4111 1111 1111 1111"])
    assert [got[i].scores for i in range(4)] == ["0.20", "0.90", "0.40", "0.95"]


def test_plan_is_native_and_empty_table(spark):
    from stockline.llm.pii import digest_columns, scan
    rows = spark.createDataFrame([], "doc_id long, text string")
    out = digest_columns(scan(rows))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 0 and "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
