"""Invariants over whole driver tables."""

from pyspark.sql import functions as F

from martlet.operators.dedup import insert_if_absent
from martlet.operators.sellers import assign_sellers
from martlet.plans import loads as L
from martlet.plans import reports as R
from martlet.plans import rfm as RFM
from martlet.sources.mart import tpch_mart


def test_gains_plus_losses_is_total(spark, sf_dir):
    for r in R.profit_by_category(tpch_mart(spark, sf_dir)).collect():
        assert abs(r.positive_profit + r.negative_profit - r.total_profit) < 1e-6


def test_rfm_labels_cover_every_customer(spark, sf_dir):
    m = tpch_mart(spark, sf_dir)
    summary = RFM.rfm_segment_summary(m, as_of="2001-12-31")
    assert sum(r.customer_count for r in summary.collect()) == \
        RFM.customer_metrics(m).count()


def test_rejects_plus_accepted_is_every_line(spark, sf_dir):
    m = tpch_mart(spark, sf_dir)
    sheet = L.noisy_sheet(m)
    accepted = L.load_from_sheet(m, "order_details").count()
    rejected = L.load_from_sheet(m, "rejects").filter(
        F.col("table_name") == "order_details").count()
    assert accepted + rejected == sheet.count()


def test_ingest_recovers_customers(spark, sf_dir):
    """The noise (padding, case) is undone: ingested customers equal the mart's."""
    m = tpch_mart(spark, sf_dir)
    got = L.load_from_sheet(m, "customers").select("customer_id", "segment", "region")
    want = (m.customers.join(m.orders.select("customer_id").distinct(), "customer_id")
            .select(F.col("customer_id").cast("string"), "segment", "region"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_upsert_is_idempotent(spark, sf_dir):
    sellers = tpch_mart(spark, sf_dir).sellers
    once = insert_if_absent(sellers, sellers, "seller_id")
    assert once.exceptAll(sellers).count() == 0 and sellers.exceptAll(once).count() == 0


def test_assigned_seller_is_in_customer_region(spark, sf_dir):
    m = tpch_mart(spark, sf_dir)
    assigned = assign_sellers(m)
    region = (m.orders.join(m.customers, "customer_id")
              .select("order_id", F.col("region").alias("c_region")))
    check = (assigned.join(region, "order_id")
             .join(m.sellers.select("seller_id", "seller_region"), "seller_id", "left"))
    assert check.filter(~F.col("seller_region").eqNullSafe(F.col("c_region"))).count() == 0


def test_ingest_twice_is_ingest_once(spark, sf_dir):
    """A clean sheet's rejects are the orders shipped before they were placed, and their
    lines, as counted on the mart itself.  A sheet rebuilt from the accepted tables has no
    rejects, and loads into the same six tables."""
    from martlet.operators import ingest as I
    from martlet.session import materialize
    from martlet.sources.flat import flat_from_mart
    from martlet.sources.mart import Mart

    names = ("categories", "subcategories", "customers", "products", "orders", "order_details")
    m = tpch_mart(spark, sf_dir)
    sheet = materialize(flat_from_mart(m, noisy=False), "sheet1")
    first = I.ingest(sheet, L.TPCH_DOMAINS)
    early = m.orders.filter("ship_date < order_date").select("order_id")
    early_lines = m.order_details.join(early, "order_id")
    sold = m.order_details.select("order_id").distinct()
    rejects = {(r.table_name, r.reason): r["count"]
               for r in first.rejects.groupBy("table_name", "reason").count().collect()}
    assert rejects == {k: n for k, n in {
        ("orders", "shipped before ordered"): early.join(sold, "order_id", "left_semi").count(),
        ("order_details", "order rejected"): early_lines.count()}.items() if n}
    assert first.order_details.count() + early_lines.count() == sheet.count()

    stored = {name: materialize(getattr(first, name), name) for name in names}
    # Customers, products and names that only rejected lines held do not come back.
    loaded = Mart(sellers=m.sellers.limit(0), **stored)
    second = I.ingest(materialize(flat_from_mart(loaded, noisy=False), "sheet2"), L.TPCH_DOMAINS)
    assert second.rejects.count() == 0
    lines, orders = stored["order_details"], stored["orders"]
    left = {"customers": stored["customers"].join(orders.select("customer_id"), "customer_id", "left_semi"),
            "products": stored["products"].join(lines.select("product_id"), "product_id", "left_semi")}
    for name in ("customers", "products", "orders", "order_details"):
        a, b = left.get(name, stored[name]), getattr(second, name).select(*stored[name].columns)
        if name == "products":  # surrogate ids follow the names that are left
            a, b = (x.select("product_id", "product_name") for x in (a, b))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


def test_load_sheet_writes_every_table_once(spark, sf_dir):
    import tempfile

    from martlet.sources.store import read_stored

    m = tpch_mart(spark, sf_dir)
    sheet = L.noisy_sheet(m)
    path = tempfile.mkdtemp(prefix="load-")
    stored = L.load_sheet(sheet, m.sellers, path, L.TPCH_DOMAINS)
    assert stored.order_details.count() == L.load_from_sheet(m, "order_details").count()
    assert stored.order_details.filter(F.col("seller_id").isNull()).count() == 0
    region = (stored.orders.join(stored.customers, "customer_id")
              .select("order_id", F.col("region").alias("c_region")))
    check = (stored.order_details.join(region, "order_id")
             .join(stored.sellers.select("seller_id", "seller_region"), "seller_id"))
    assert check.filter(~F.col("seller_region").eqNullSafe(F.col("c_region"))).count() == 0
    assert read_stored(spark, path, "rejects").count() > 0
