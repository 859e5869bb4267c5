"""First come, first served over two keys, against a replay; chains of rivals in few rounds."""
import random

from stockline.operators import snapshots as sn


def replay(rows):
    taken, lost = set(), {}
    for rid, *keys in sorted(rows):
        clash = next((n for n, k in enumerate(keys) if k is not None and (n, k) in taken), None)
        if clash is None:
            taken |= {(n, k) for n, k in enumerate(keys) if k is not None}
        else:
            lost[rid] = clash
    return lost


def lost(spark, rows, **kw):
    df = spark.createDataFrame(rows, "request_id long, sku string, barcode string")
    return {r.request_id: r._lost for r in sn._rivals(df, ["sku", "barcode"], **kw).collect()}


def test_random_rivals(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, *(f"s{k}" for k in range(60))]), rnd.choice([None, *(f"b{k}" for k in range(60))])) for i in range(400)]
    rnd.shuffle(rows)
    assert lost(spark, rows) == replay(rows)
    assert lost(spark, rows, slice_requests=3) == replay(rows)


def test_chain_of_rivals_ends_in_few_rounds(spark, monkeypatch):
    # Request i shares its sku with the one before it and its barcode with the one after it, by turns.
    rows = [(i, f"s{(i + 1) // 2}", f"b{i // 2}") for i in range(600)]
    calls = []
    first = sn._first_of_all
    monkeypatch.setattr(sn, "_first_of_all", lambda *a: calls.append(1) or first(*a))
    assert lost(spark, rows) == replay(rows)
    assert len(calls) <= 2
