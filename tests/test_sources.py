"""Sources and sinks: stored marts, sheet scans, the persisted dashboard frame,
and the streamed sheet store."""

import tempfile


from martlet.operators import ingest as I
from pyspark.sql import functions as F

from martlet.plans import dashboard as Dsh
from martlet.plans.loads import noisy_sheet
from martlet.schema import FLAT_COLUMNS, TABLES
from martlet.sources.flat import read_flat, sample_rows
from martlet.sources.mart import tpch_mart
from martlet.sources.store import read_mart, write_mart
from martlet.streaming import refresh_from_store, stage_sheet_stream


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_write_and_read_mart_roundtrip(spark, sf_dir):
    m = tpch_mart(spark, sf_dir)
    path = tempfile.mkdtemp(prefix="mart-")
    write_mart(m, path)
    back = read_mart(spark, path)
    for name in TABLES:
        assert _same(m.table(name), back.table(name)), name
    # full refresh: writing again replaces, never appends
    write_mart(m, path)
    assert read_mart(spark, path).order_details.count() == m.order_details.count()


def test_flat_csv_scan_trims_headers(spark, sf_dir):
    sheet = noisy_sheet(tpch_mart(spark, sf_dir)).limit(50)
    padded = sheet.toDF("row_id", *[f" {c} " for c in FLAT_COLUMNS])
    path = tempfile.mkdtemp(prefix="sheet-") + "/csv"
    padded.write.option("header", True).csv(path)
    back = read_flat(spark, path, fmt="csv")
    assert back.columns == ["row_id", *FLAT_COLUMNS]
    assert back.count() == 50


def test_sample_rows_is_the_first_rows_by_input_order(spark, sf_dir):
    sheet = noisy_sheet(tpch_mart(spark, sf_dir))
    first = [r.row_id for r in sample_rows(sheet, 25).collect()]
    assert first == [r.row_id for r in sheet.orderBy("row_id").limit(25).collect()]
    assert sample_rows(sheet, None).count() == sheet.count()


def test_persisted_dashboard_frame_gives_same_reports(spark, sf_dir):
    m = tpch_mart(spark, sf_dir)
    frame, reports = Dsh.dashboard_reports(m)
    try:
        assert _same(reports["kpi_overview"], Dsh.kpi_overview(m))
        assert _same(reports["customer_spending"], Dsh.customer_spending(m))
        assert _same(reports["yearly_sales"], Dsh.yearly_sales(m))
    finally:
        frame.unpersist()


def test_streamed_sheet_equals_batch_load(spark, sf_dir):
    sheet = noisy_sheet(tpch_mart(spark, sf_dir))
    src = tempfile.mkdtemp(prefix="src-") + "/sheets"
    store = tempfile.mkdtemp(prefix="store-") + "/sheet"
    ckpt = tempfile.mkdtemp(prefix="ckpt-")
    # Every file has its columns in an order of its own.
    for i, names in enumerate((sheet.columns, sheet.columns[::-1], sorted(sheet.columns))):
        (sheet.where(F.pmod("row_id", F.lit(3)) == i).select(*[F.col(f"`{c}`") for c in names]).coalesce(1)
         .write.mode("append").option("header", True).csv(src))
    q = stage_sheet_stream(spark, src, store, ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    epochs = spark.read.parquet(store).select("epoch").distinct().count()
    assert epochs >= 2
    streamed = refresh_from_store(spark, store)
    batch = I.ingest(sheet)
    assert _same(streamed.customers, batch.customers)
    assert _same(streamed.order_details, batch.order_details)
    assert _same(streamed.rejects, batch.rejects)


def test_bucketed_mart_joins_orders_without_shuffle(spark, sf_dir):
    from martlet.sources.mart import read_mart_tables, write_mart_tables
    m = tpch_mart(spark, sf_dir)
    path = tempfile.mkdtemp(prefix="bucketed-")
    write_mart_tables(m, path, "martlet_test_db", buckets=4)
    stored = read_mart_tables(spark, "martlet_test_db")
    for name in TABLES:
        assert _same(m.table(name), stored.table(name)), name
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = stored.order_details.join(stored.orders, "order_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_sql_over_registered_views_matches_report(spark, sf_dir):
    from martlet.plans import reports as R
    from martlet.sources.mart import register_views
    m = tpch_mart(spark, sf_dir)
    register_views(m, prefix="mv_")
    via_sql = spark.sql("""
        SELECT c.category_name AS category, COUNT(*) AS total_orders,
               SUM(d.quantity) AS total_quantity,
               CAST(SUM(d.sales) AS DOUBLE) AS total_sales,
               CAST(SUM(d.profit) AS DOUBLE) AS total_profit,
               CAST(SUM(d.sales) AS DOUBLE) / COUNT(d.sales) AS avg_sales
        FROM mv_order_details d
        JOIN mv_products p ON p.product_id = d.product_id
        JOIN mv_categories c ON c.category_id = p.category_id
        GROUP BY c.category_name""")
    assert _same(via_sql, R.sales_by_category(m))
