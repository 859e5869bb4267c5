"""Plan checks: pushdown, pruning, no Python in the report plans, one scan per summary."""
import os

from stockline.plans.registry import all_queries

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_registry_matches_oracle_keys():
    import __spark_entry__ as E
    from oracle_queries import SQL
    from stockline.plans.registry import all_queries
    assert set(SQL) == set(all_queries())          # every query of the reports has a DuckDB oracle
    assert set(E.oracle_sql()) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


def test_filter_pushdown_and_pruning(spark):
    if not os.path.isdir(SF):
        return
    plan = _plan(all_queries()["daily_sales"](spark, SF))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line and "orders" in line]
    assert len(scan) == 1
    # only the three columns the report needs are read, and the date window reaches the scan
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>" in scan[0]
    assert "GreaterThanOrEqual(o_orderdate,2001-07-02T00:00)" in scan[0]
    assert "customer" not in plan


def test_no_python_in_reports(spark):
    if not os.path.isdir(SF):
        return
    q = all_queries()
    for name in ("sales_by_day", "sales_by_product", "inventory_report", "product_report_summary",
                 "sale_list", "category_performance", "dq_sales"):
        plan = _plan(q[name](spark, SF))
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name


def test_customer_lookup_removed_when_unused(spark):
    if not os.path.isdir(SF):
        return
    plan = _plan(all_queries()["sales_by_day"](spark, SF))
    assert "customer" not in plan                 # the lookup join is pruned by the optimizer
    plan = _plan(all_queries()["inventory_summary"](spark, SF))
    assert plan.count("FileScan parquet") == 1     # one scan for a one-pass summary


def test_no_single_partition_windows(spark):
    """Per-day numbering and new ids use the range-partitioned running
    totals: no Window operator and no exchange into a single partition."""
    if not os.path.isdir(SF):
        return
    q = all_queries()
    for name in ("sale_numbers", "add_products_new", "merge_dimension_rows"):
        lines = _plan(q[name](spark, SF)).splitlines()
        assert not any("Window" in line for line in lines), name
        # a single-partition exchange only ever carries per-task partial aggregates (one row each)
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert "partial_" in lines[i + 1], (name, lines[i + 1])


def test_item_arrays_never_broadcast(spark):
    if not os.path.isdir(SF):
        return
    plan = _plan(all_queries()["sale_with_items"](spark, SF))
    collect_side = [line for line in plan.splitlines() if "collect_list" in line]
    assert collect_side and "SortMergeJoin" in plan
