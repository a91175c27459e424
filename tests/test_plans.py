"""Physical-plan properties that matter at scale."""

import pytest

import __spark_entry__ as entry
from martlet.plans import rfm as RFM
from martlet.sources.mart import tpch_mart


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


# The training-data operators choose their style each; their tests are in tests/llm.
@pytest.mark.parametrize("key", sorted(entry.REGISTRY))
def test_no_python_udf_in_any_plan(spark, sf_dir, key):
    plan = _plan(entry.queries()[key](spark, sf_dir))
    for marker in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                   "MapInPandas", "PythonUDF"):
        assert marker not in plan


@pytest.mark.parametrize("key", ["top_products", "top_customers", "top_sellers",
                                 "loss_products", "customer_spending"])
def test_top_k_is_take_ordered(spark, sf_dir, key):
    df = entry.queries()[key](spark, sf_dir)
    df.collect()
    assert "TakeOrderedAndProject" in _plan(df)


def test_invoice_filter_reaches_both_scans(spark, sf_dir):
    df = entry.queries()["order_invoice"](spark, sf_dir)
    text = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan parquet" in line]
    orders = [s for s in scans if "o_orderkey" in s and "o_orderdate" in s]
    lines = [s for s in scans if "l_orderkey" in s]
    assert orders and all("EqualTo(o_orderkey,3)" in s for s in orders)
    # every lineitem scan (the lines and the ship-date aggregate) reads one order
    assert len(lines) >= 2 and all("EqualTo(l_orderkey,3)" in s for s in lines)


def test_segment_report_has_no_expand(spark, sf_dir):
    assert "Expand" not in _plan(entry.queries()["sales_by_segment"](spark, sf_dir))


def test_column_pruning_reaches_the_fact_scan(spark, sf_dir):
    plan = _plan(entry.queries()["sales_by_category"](spark, sf_dir))
    fact = [s for s in plan.splitlines() if "FileScan parquet" in s and "lineitem" in s]
    assert fact
    for unused in ("l_shipdate", "l_returnflag", "l_linestatus", "l_tax", "l_linenumber"):
        assert all(unused not in s for s in fact)


def test_unused_mart_parts_prune_away(spark, sf_dir):
    m = tpch_mart(spark, sf_dir)
    opt = _optimized(m.order_details.select("order_id", "sales"))
    assert "Window" not in opt and "Join" not in opt
    opt = _optimized(m.orders.select("order_id", "customer_id"))
    assert "Join" not in opt and "lineitem" not in opt


def test_rfm_has_no_single_partition_exchange(spark, sf_dir):
    m = tpch_mart(spark, sf_dir)
    df = RFM.rfm_scores(m, as_of="2001-12-31")
    plan = _plan(df)  # the scores are comparisons with literals over the stored metrics
    assert "Exchange" not in plan and "Window" not in plan
    assert df.count() == RFM.customer_metrics(m).count()


def test_ytd_reads_the_fact_once(spark, sf_dir):
    plan = _plan(entry.queries()["ytd_comparison"](spark, sf_dir))
    scans = [s for s in plan.splitlines() if "FileScan parquet" in s and "lineitem" in s]
    assert len(scans) == 1


@pytest.mark.parametrize("key", ["search_orders_all", "order_summary"])
def test_newest_orders_are_taken_before_lines_are_summed(spark, sf_dir, key):
    plan = _optimized(entry.queries()[key](spark, sf_dir))
    assert plan.index("sum(sales") < plan.rindex("GlobalLimit"), plan


def _children(node):
    kids = node.children()
    return [kids.apply(i) for i in range(kids.size())]


def _walk(node):
    yield node
    for child in _children(node):
        yield from _walk(child)


def _physical(df):
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    return plan


def _reads_fact(node) -> bool:
    return any(n.nodeName().startswith("Scan") and "lineitem" in n.simpleString(1000)
               for n in _walk(node))


@pytest.mark.parametrize("key", sorted(entry.REGISTRY))
def test_fact_rows_never_pass_one_partition(spark, sf_dir, key):
    """A single-partition exchange may only carry aggregated rows, or input
    that does not come from the fact table."""
    plan = _physical(entry.queries()[key](spark, sf_dir))
    for node in _walk(plan):
        if (node.nodeName() == "Exchange"
                and node.outputPartitioning().toString() == "SinglePartition"):
            child = _children(node)[0]
            assert "Aggregate" in child.nodeName() or not _reads_fact(child), key


def test_detector_catches_a_global_window_over_the_fact(spark, sf_dir):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    bad = li.withColumn("rn", F.row_number().over(Window.orderBy("l_orderkey")))
    hits = [n for n in _walk(_physical(bad))
            if n.nodeName() == "Exchange"
            and n.outputPartitioning().toString() == "SinglePartition"
            and not ("Aggregate" in _children(n)[0].nodeName())
            and _reads_fact(_children(n)[0])]
    assert hits


def test_chunked_line_numbering_matches_and_keeps_pushdown(spark, sf_dir):
    """Forced into several chunks per order range, the line ids are the same as
    one window per order, and the invoice filter still reaches the scan."""
    from martlet.operators.ranking import CONF_ROWS_PER_BUCKET
    from martlet.plans import reports as R
    from martlet.sources.mart import _build_tpch_mart

    plain = tpch_mart(spark, sf_dir)
    spark.conf.set(CONF_ROWS_PER_BUCKET, "500")
    try:
        chunked = _build_tpch_mart(spark, sf_dir)
    finally:
        spark.conf.unset(CONF_ROWS_PER_BUCKET)
    cols = ["id", "order_id", "product_id", "seller_id", "sales", "quantity"]
    a, b = plain.order_details.select(*cols), chunked.order_details.select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    plan = _plan(R.order_invoice(chunked, 3))
    lines = [s for s in plan.splitlines() if "FileScan parquet" in s and "l_extendedprice" in s]
    assert lines and all("EqualTo(l_orderkey,3)" in s for s in lines)
    assert "_chunk" in _optimized(chunked.order_details)


def test_date_range_reaches_the_orders_scan(spark, sf_dir):
    plan = _plan(entry.queries()["filter_date_range"](spark, sf_dir))
    scans = [s for s in plan.splitlines() if "FileScan parquet" in s and "o_orderdate" in s]
    assert scans and all("GreaterThanOrEqual(o_orderdate" in s for s in scans)
