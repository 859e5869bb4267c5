"""The driver contract runs and keeps a stable schema."""
import os


def test_entry(spark):
    import __spark_entry__ as E
    if not os.path.isdir(E.SMOKE_DIR):
        return
    df = E.entry(spark)
    assert df.columns == ["period", "sales_count", "total_revenue", "avg_order_value", "total_items"]
    assert df.count() > 0
