"""C9 as flat pair, arrays and bounded parts; A5 / A8 pairs published together; counts of a hot sale."""
import os

import pytest
from conftest import items_df, sales_df

from stockline.operators import joins as jn
from stockline.operators import sales as sal
from stockline.sources import sinks


@pytest.fixture(scope="module")
def hot(spark):
    sales = sales_df(spark, [{"id": i} for i in (1, 2, 3)])
    items = items_df(spark, [{"sale_id": 1, "product_id": p % 7, "quantity": 1 + p % 3} for p in range(300)]
                     + [{"sale_id": 2, "product_id": 4, "quantity": 2}] * 3)
    return sales, items


def test_flat_pair(spark, hot):
    heads, lines = jn.sale_and_lines(*hot)
    assert {r.id: r.line_count for r in heads.collect()} == {1: 300, 2: 3, 3: 0}
    rows = sorted((r.sale_id, r.line_no, r.product_id, r.quantity) for r in lines.collect())
    assert [r[1] for r in rows] == [*range(1, 301), 1, 2, 3]
    first = [r[2:] for r in rows if r[0] == 1]
    assert first == sorted(first)


def test_arrays_and_parts(hot):
    whole = {r.id: r.items for r in jn.sale_item_arrays(*hot).collect()}
    assert {k: len(v) for k, v in whole.items()} == {1: 300, 2: 3, 3: 0}
    parts = jn.sale_with_items(*hot, chunk_lines=64).collect()
    assert sorted((r.id, r.part, len(r.items)) for r in parts) == [(1, 0, 64), (1, 1, 64), (1, 2, 64), (1, 3, 64), (1, 4, 44), (2, 0, 3), (3, 0, 0)]
    joined = [i for r in sorted(parts, key=lambda r: (r.id, r.part)) if r.id == 1 for i in r.items]
    assert joined == whole[1]


def test_equal_lines_beyond_a_part_stay_bounded(spark):
    sales = sales_df(spark, [{"id": 1}])
    items = items_df(spark, [{"sale_id": 1, "product_id": 1, "quantity": 1}] * 50)
    assert sorted((r.part, len(r.items)) for r in jn.sale_with_items(sales, items, chunk_lines=20).collect()) == [(0, 20), (1, 20), (2, 10)]


def test_no_task_reads_the_lines_of_a_hot_sale(spark, hot):
    """Lines are combined before the only shuffle on their sale: no join reads them."""
    import datetime as dt
    plan = sal.sales_by_period(*hot, dt.date(2001, 1, 1), dt.date(2001, 8, 1), "day")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = {k: len(line) - len(line.lstrip(" :+-")) for k, line in enumerate(lines)}
    count = next(k for k, line in enumerate(lines) if "Aggregate [sale_id" in line)
    below = [line for k, line in enumerate(lines) if k > count and depth[k] > depth[count]]
    assert below and not any("Join" in line for line in below)


def test_pair_appears_whole_or_not_at_all(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2.5,)], "total double")
    path = f"{tmp_path}/report"
    sinks.export_pair(a, b, path)
    rows = sinks.read_pair(spark, path, a.schema, b.schema).collect()
    assert sorted((r.part, r.i, r.s, r.total) for r in rows) == [("data", 1, "x", None), ("summary", None, None, 2.5)]
    with pytest.raises(FileExistsError):
        sinks.export_pair(a, b, path)
    bad = b.selectExpr("raise_error('no summary') AS total")
    with pytest.raises(Exception, match="no summary"):
        sinks.export_pair(a, bad, f"{tmp_path}/failed")
    assert not os.path.exists(f"{tmp_path}/failed")
    sinks.export_pair(a.union(a), b, path, mode="overwrite")
    assert sinks.read_pair(spark, path, a.schema, b.schema).count() == 3
    with pytest.raises(ValueError):
        sinks.export_pair(a, b, path, mode="append")
