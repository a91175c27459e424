"""Hand-made edge rows (FIXTURES.md section 4) with exact expected results."""

import datetime as dt
import itertools

from pyspark.sql import functions as F

from helpers import D, as_set, basic_mart, day, rows_of
from martlet.functions.scalar import lenient_date, money_text, norm_enum
from martlet.operators import ingest as I
from martlet.operators.quality import check_ranges
from martlet.operators.sellers import add_missing_column, assign_sellers, update_column
from martlet.plans import dashboard as Dsh
from martlet.plans import reports as R
from martlet.plans import rfm as RFM
from martlet.plans import ytd as Y
from martlet.plans.frames import wide_fact
from martlet.schema import FLAT_COLUMNS, FLAT_SCHEMA, REGIONS, SEGMENTS, SHIP_MODES

# ----------------------------------------------------------------- functions


def test_enum_text(spark):
    df = spark.createDataFrame([(" east ",), ("EAST",), ("Nord",), (None,)], "r string")
    got = [r[0] for r in df.select(norm_enum("r", REGIONS)).collect()]
    assert got == ["East", "East", None, None]


def test_date_text(spark):
    df = spark.createDataFrame([("2017-03-15",), ("not a date",), (None,)], "d string")
    got = [r[0] for r in df.select(lenient_date("d")).collect()]
    assert got == [dt.date(2017, 3, 15), None, None]


def test_money_text(spark):
    df = spark.createDataFrame([(1234.5,), (-1234.5,), (0.0,)], "x double")
    assert [r[0] for r in df.select(money_text("x")).collect()] == [
        "$1,234.50", "$-1,234.50", "$0.00"]


def test_month_truncation(spark):
    m = basic_mart(spark)
    months = {r.month for r in R.sales_trend_monthly(m).collect()}
    assert dt.date(2017, 3, 1) in months and dt.date(2017, 3, 15) not in months


# -------------------------------------------------------------------- ingest

def _flat(spark, rows):
    base = {c: None for c in FLAT_COLUMNS}
    full = []
    for i, r in enumerate(rows, start=1):
        row = dict(base)
        row.update(r)
        full.append(tuple([D(row.get("row_id", i))] + [row[c] for c in FLAT_COLUMNS]))
    return spark.createDataFrame(full, FLAT_SCHEMA)


def _sheet_row(**kw):
    row = {"Order ID": "O1", "Order Date": "2017-03-15", "Ship Date": "2017-03-18",
           "Ship Mode": "Same Day", "Customer ID": "C1", "Customer Name": "Ann",
           "Segment": "Consumer", "Country": "US", "City": "Austin", "State": "TX",
           "Postal Code": "78701", "Region": "South", "Product ID": "P1",
           "Category": "Furniture", "Sub-Category": "Chairs", "Product Name": "Chair",
           "Sales": 10.0, "Quantity": 1.0, "Discount": 0.0, "Profit": 1.0}
    row.update(kw)
    return row


def test_keep_first_customer(spark):
    flat = _flat(spark, [_sheet_row(City="Austin"), _sheet_row(City="Dallas"),
                         _sheet_row(**{"Customer ID": " C1 "}, City="Waco")])
    got = rows_of(I.ingest(flat).customers, "customer_id", "city")
    assert got == [("C1", "Austin")]


def test_keep_first_follows_row_id_not_position(spark):
    flat = _flat(spark, [dict(_sheet_row(City="Late"), row_id=9),
                         dict(_sheet_row(City="Early"), row_id=2)])
    assert rows_of(I.ingest(flat).customers, "city") == [("Early",)]


def test_enum_normalised_on_ingest(spark):
    flat = _flat(spark, [_sheet_row(Segment="  home office ", Region="NORTH")])
    got = rows_of(I.ingest(flat).customers, "segment", "region")
    assert got == [("Home Office", None)]


def test_trailing_blank_pair_is_one_subcategory(spark):
    flat = _flat(spark, [_sheet_row(**{"Sub-Category": "Chairs"}),
                         _sheet_row(**{"Sub-Category": "Chairs ", "Product ID": "P2"})])
    pairs = I.named_pairs(flat)
    cats = I.ingest_categories(pairs)
    subs = I.ingest_subcategories(pairs, cats)
    assert rows_of(subs, "subcategory_id", "category_id", "subcategory_name") == [(1, 1, "Chairs")]


def test_product_rejects_and_their_lines(spark):
    flat = _flat(spark, [
        _sheet_row(),
        _sheet_row(**{"Product ID": "P2", "Category": None}),
        _sheet_row(**{"Product ID": "P3", "Sub-Category": None}),
        _sheet_row(**{"Product ID": "P3"}),
    ])
    res = I.ingest(flat)
    assert as_set(res.products, "product_id") == {("P1",)}
    reasons = as_set(res.rejects.filter(F.col("table_name") == "products"), "key", "reason")
    assert reasons == {("P2", "unknown category"), ("P3", "no subcategory")}
    assert as_set(res.order_details, "id") == {(1,)}
    lines = as_set(res.rejects.filter(F.col("table_name") == "order_details"), "row_id")
    assert lines == {(2,), (3,), (4,)}
    # rejected + accepted lines = every input line
    assert res.order_details.count() + len(lines) == flat.count()


def test_subcategory_found_by_name_alone(spark):
    flat = _flat(spark, [_sheet_row()])
    cats = I.ingest_categories(I.named_pairs(flat))
    subs = spark.createDataFrame([(7, 2, "Chairs")], "subcategory_id int, category_id int, "
                                                     "subcategory_name string")
    got = rows_of(I._resolved_products(flat, cats, subs), "product_id", "subcategory_id", "reason")
    assert got == [("P1", 7, None)]


def test_null_money_becomes_zero_and_null_quantity_is_rejected(spark):
    flat = _flat(spark, [_sheet_row(Sales=None, Discount=None, Profit=None),
                         _sheet_row(Quantity=None)])
    res = I.ingest(flat)
    assert rows_of(res.order_details, "id", "sales", "quantity", "discount", "profit") == [
        (1, D("0.00"), 1, D("0.00"), D("0.00"))]
    assert as_set(res.rejects, "table_name", "row_id", "reason") == {
        ("order_details", 2, "quantity not above 0")}


def test_quantity_check_counts_zero(spark):
    m = basic_mart(spark, order_details=[(1, 1, 1, None, D("0.00"), 0, D("0.00"), D("0.00"))])
    v = {r.constraint_name: r.violations for r in check_ranges(m).collect()}
    assert v["chk_quantity"] == 1 and v["chk_sales"] == 0


def test_orders_dates_and_ship_mode(spark):
    flat = _flat(spark, [_sheet_row(**{"Ship Date": "not a date", "Ship Mode": " same day"})])
    got = rows_of(I.ingest(flat).orders, "order_id", "order_date", "ship_date", "ship_mode")
    assert got == [("O1", dt.date(2017, 3, 15), None, "Same Day")]


def test_order_and_line_rules_and_their_children(spark):
    flat = _flat(spark, [
        _sheet_row(),
        _sheet_row(**{"Order ID": "O2", "Order Date": "not a date"}),
        _sheet_row(**{"Order ID": "O3", "Customer ID": None}),
        _sheet_row(**{"Order ID": "O4", "Ship Date": "2017-03-01"}),
        _sheet_row(**{"Order ID": "O5", "Customer ID": "C9", "Customer Name": None}),
        _sheet_row(**{"Order ID": None}),
        _sheet_row(**{"Product ID": None}),
        _sheet_row(Sales=-1.0),
        _sheet_row(Discount=1.5),
        _sheet_row(Sales=1e15),
        _sheet_row(**{"Order ID": "O2"}),
        _sheet_row(**{"Product ID": "P7", "Product Name": None}),
    ])
    res = I.ingest(flat)
    assert as_set(res.orders, "order_id") == {("O1",)}
    assert as_set(res.customers, "customer_id") == {("C1",)}
    assert rows_of(res.order_details, "id") == [(1,)]
    assert as_set(res.rejects, "table_name", "key", "reason") == {
        ("customers", "C9", "no customer name"), ("products", "P7", "no product name"),
        ("orders", "O2", "no order date"), ("orders", "O3", "no customer id"),
        ("orders", "O4", "shipped before ordered"), ("orders", "O5", "customer rejected"),
        ("order_details", "2", "order rejected"), ("order_details", "3", "order rejected"),
        ("order_details", "4", "order rejected"), ("order_details", "5", "order rejected"),
        ("order_details", "6", "no order id"), ("order_details", "7", "no product id"),
        ("order_details", "8", "negative sales"),
        ("order_details", "9", "discount outside 0 to 1"),
        ("order_details", "10", "amount out of range"),
        ("order_details", "11", "order rejected"), ("order_details", "12", "product rejected")}


# ------------------------------------------------------------------- sellers

def _lines(ids, order_id=100, seller=None):
    return [(i, order_id, 10, seller, D("1.00"), 1, D("0.00"), D("0.00")) for i in ids]


def test_region_without_sellers_falls_back_to_all(spark):
    m = basic_mart(spark,
                   customers=[(1, "Ann", "Consumer", "US", None, None, None, "South")],
                   orders=[(100, day("2017-01-01"), None, None, 1)],
                   order_details=_lines([1, 2, 3, 4]))
    got = dict(rows_of(assign_sellers(m), "id", "seller_id"))
    # all sellers ordered by id: [1, 2]; index = id mod 2
    assert got == {1: 2, 2: 1, 3: 2, 4: 1}


def test_sellers_in_customer_region(spark):
    m = basic_mart(spark,
                   sellers=[(1, "A", "a@x", None, "East", None, None),
                            (5, "B", "b@x", None, "West", None, None),
                            (9, "C", "c@x", None, "East", None, None)],
                   customers=[(1, "Ann", "Consumer", "US", None, None, None, "East")],
                   orders=[(100, day("2017-01-01"), None, None, 1)],
                   order_details=_lines([1, 2, 3]))
    got = dict(rows_of(assign_sellers(m), "id", "seller_id"))
    assert got == {1: 9, 2: 1, 3: 9}


def test_no_sellers_keeps_line_seller(spark):
    m = basic_mart(spark, sellers=[], order_details=_lines([1, 2], seller=None))
    assert rows_of(assign_sellers(m), "seller_id") == [(None,), (None,)]


def test_line_without_customer_is_not_assigned(spark):
    m = basic_mart(spark, order_details=_lines([1], order_id=999, seller=2))
    assert rows_of(assign_sellers(m), "seller_id") == [(2,)]


def test_add_column_and_update(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    with_col = add_missing_column(df, "seller_id", "long")
    assert with_col.columns == ["id", "seller_id"]
    assert add_missing_column(with_col, "seller_id").columns == ["id", "seller_id"]
    upd = spark.createDataFrame([(2, 7)], "id long, seller_id long")
    assert sorted(rows_of(update_column(with_col, upd, "id", "seller_id"))) == [(1, None), (2, 7)]


# ------------------------------------------------------------------- reports

def test_null_seller_line_absent_from_seller_joins(spark):
    base = basic_mart(spark)
    extra = basic_mart(spark, order_details=rows_of(base.order_details) + [
        (5, 101, 10, None, D("999.00"), 1, D("0.00"), D("1.00"))])
    assert as_set(R.top_sellers(extra)) == as_set(R.top_sellers(base))
    assert wide_fact(extra).count() == wide_fact(base).count() == 4


def test_two_customers_one_name(spark):
    m = basic_mart(spark, customers=[(1, "Ann", "Consumer", "US", None, None, None, "East"),
                                     (2, "Ann", "Corporate", "US", None, None, None, "West")])
    spend = rows_of(Dsh.customer_spending(m), "Customer Name", "Total Orders")
    assert spend == [("Ann", 4)]
    assert R.top_customers(m).count() == 2


def test_null_profit_is_not_a_loss(spark):
    m = basic_mart(spark, order_details=[
        (1, 100, 10, 1, D("10.00"), 1, D("0.00"), None),
        (2, 100, 11, 1, D("10.00"), 5, D("0.00"), D("-3.00"))])
    got = rows_of(R.profit_by_category(m), "category", "total_profit", "positive_profit",
                  "negative_profit", "order_count")
    assert got == [("Furniture", -3.0, 0.0, -3.0, 2)]
    assert rows_of(Dsh.loss_products(m), "product_name") == [("Chair B",)]


def test_null_rating_sorts_first(spark):
    m = basic_mart(spark, sellers=[(1, "S One", "one@x", None, "East", None, None),
                                   (2, "S Two", "two@x", None, "West", D("4.90"), None)])
    got = [r.seller_name for r in R.seller_performance(m).collect()]
    assert got == ["S One", "S Two"]


def test_zero_sales_category_margin_is_null(spark):
    m = basic_mart(spark, order_details=[
        (1, 100, 10, 1, D("0.00"), 1, D("0.00"), D("0.00")),
        (2, 100, 20, 1, D("10.00"), 1, D("0.00"), D("2.50"))])
    got = dict(rows_of(Dsh.category_sales_margin(m), "Category", "Profit Margin %"))
    assert got == {"Furniture": None, "Technology": 25.0}


def test_margin_rounds_half_even_on_the_binary_value(spark):
    m = basic_mart(spark, order_details=[(1, 100, 10, 1, D("1000.00"), 1, D("0.00"), D("10.15"))])
    got = dict(rows_of(Dsh.category_sales_margin(m), "Category", "Profit Margin %"))
    x = 10.15 / 1000.0 * 100.0
    assert got["Furniture"] == round(x * 100.0) / 100.0


def test_negative_last_year_profit_gives_zero_growth(spark):
    m = basic_mart(spark, order_details=[
        (1, 100, 10, 1, D("100.00"), 1, D("0.00"), D("-20.00")),   # 2016-03
        (2, 102, 10, 1, D("50.00"), 1, D("0.00"), D("5.00"))])     # 2017-03
    r = Y.ytd_comparison(m).collect()[0]
    assert r.current_year == 2017
    assert r.profit_last == -20.0 and r.profit_growth == 0.0
    assert r.sales_growth == (50.0 - 100.0) / 100.0 * 100.0


def test_only_one_year(spark):
    m = basic_mart(spark, orders=[(100, day("2017-01-05"), None, None, 1),
                                  (101, day("2017-02-10"), None, None, 2),
                                  (102, day("2017-03-15"), None, None, 1)])
    r = Y.ytd_comparison(m).collect()[0]
    assert (r.sales_last, r.profit_last, r.margin_last, r.sales_growth, r.profit_growth) == (
        0.0, 0.0, 0.0, 0.0, 0.0)
    table = {row.metric: row for row in Y.ytd_metric_table(m).collect()}
    assert set(table) == {"Sales", "Profit", "Margin %"}


def test_ytd_months_limited_to_current_month(spark):
    m = basic_mart(spark, orders=[(100, day("2016-05-15"), None, None, 1),
                                  (101, day("2017-02-10"), None, None, 2),
                                  (102, day("2017-03-15"), None, None, 1)])
    r = Y.ytd_comparison(m).collect()[0]
    assert r.sales_last == 0.0  # May 2016 is after March


def test_tied_quantity_in_loss_products(spark):
    m = basic_mart(spark, products=[(10, 1, 1, "Zed"), (11, 1, 1, "Alpha"), (20, 2, 2, "Alpha")],
                   order_details=[(1, 100, 10, 1, D("1.00"), 3, D("0.00"), D("-1.00")),
                                  (2, 100, 11, 1, D("1.00"), 3, D("0.00"), D("-1.00")),
                                  (3, 100, 20, 1, D("1.00"), 3, D("0.00"), D("-1.00"))])
    got = rows_of(Dsh.loss_products(m, top_n=2), "product_name", "category")
    assert got == [("Alpha", "Furniture"), ("Alpha", "Technology")]


def test_loss_summary_lists_every_category(spark):
    m = basic_mart(spark)
    got = dict((r.category, (r.quantity, r.profit))
               for r in Dsh.loss_summary_by_category(m, categories=["Furniture", "Technology",
                                                                    "Toys"]).collect())
    assert got["Toys"] == (0, 0.0)
    assert got["Technology"] == (1, -5.0) and got["Furniture"] == (4, -10.0)


def test_search_empty_term_and_wildcard(spark):
    m = basic_mart(spark, orders=[(100, day("2016-03-15"), None, None, 1),
                                  (101, day("2017-02-10"), None, None, 2),
                                  (102, day("2017-03-15"), None, None, 1),
                                  (103, day("2017-04-01"), None, None, 2)])
    assert as_set(R.search_orders(m, ""), "order_id") == {(100,), (101,), (102,)}
    assert as_set(R.search_orders(m, "_"), "order_id") == {(100,), (101,), (102,)}
    assert as_set(R.search_orders(m, "bo"), "order_id") == {(101,)}
    assert as_set(R.search_orders(m, "102"), "order_id") == {(102,)}


def test_invoice_is_one_order_by_line(spark):
    m = basic_mart(spark)
    got = R.order_invoice(m, 100).collect()
    assert [r.product_id for r in got] == [10, 20] and len(got[0]) == 22


def test_fewer_than_five_customers_tiles(spark):
    m = basic_mart(spark,
                   customers=[(1, "A", None, None, None, None, None, None),
                              (2, "B", None, None, None, None, None, None),
                              (3, "C", None, None, None, None, None, None)],
                   orders=[(100, day("2017-01-01"), None, None, 1),
                           (101, day("2017-02-01"), None, None, 2),
                           (102, day("2017-03-01"), None, None, 3)],
                   order_details=[(1, 100, 10, 1, D("1.00"), 1, D("0.00"), D("0.00")),
                                  (2, 101, 10, 1, D("2.00"), 1, D("0.00"), D("0.00")),
                                  (3, 102, 10, 1, D("3.00"), 1, D("0.00"), D("0.00"))])
    got = {r.customer_id: (r.r_score, r.f_score, r.m_score)
           for r in RFM.rfm_analysis(m, as_of="2017-12-31").collect()}
    # recency DESC: customer 1 is oldest -> 1; frequency ties broken by id; money ascending
    assert got == {1: (1, 1, 1), 2: (2, 2, 2), 3: (3, 3, 3)}


def test_all_125_score_triples(spark):
    triples = list(itertools.product(range(1, 6), repeat=3))
    df = spark.createDataFrame(triples, "r int, f int, m int")
    labels = df.select(RFM.rfm_label(F.col("r"), F.col("f"), F.col("m")).alias("l"))
    counts = dict(labels.groupBy("l").count().collect())
    assert counts == {"Champions": 8, "Loyal Customers": 19, "New Customers": 20,
                      "At Risk": 30, "Lost Customers": 20, "Potential Loyalists": 6,
                      "Regular Customers": 22}
    assert "Big Spenders" not in counts


def test_domains_are_declared_in_order():
    assert SEGMENTS == ["Consumer", "Corporate", "Home Office"]
    assert REGIONS == ["East", "West", "Central", "South"]
    assert SHIP_MODES == ["First Class", "Second Class", "Standard Class", "Same Day"]


def test_row_rules_read_each_table_once(spark):
    from martlet.operators.quality import check_enum_domains, check_rows
    m = basic_mart(spark, customers=[(1, None, "consumer", "US", None, None, "x" * 21, "East"),
                                     (2, "Bob", "Corporate", "US", None, None, None, "Nowhere")],
                   order_details=[(1, 100, 10, 1, None, 0, D("1.10"), None)])
    broken = {(r.table_name, r.rule, r.subject) for r in check_rows(m).collect() if r.violations}
    assert broken == {("customers", "not null", "customer_name"), ("customers", "domain", "segment"),
                      ("customers", "domain", "region"), ("customers", "length", "postal_code"),
                      ("order_details", "not null", "sales"), ("order_details", "range", "chk_quantity"),
                      ("order_details", "range", "chk_discount")}
    stored = {t: m.table(t) for t in ("sellers", "customers", "orders", "order_details")}
    plan = check_rows(m)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 7
    found = {(r.table_name, r.column_name): r.violations for r in check_enum_domains(
        m.replace(**stored), {("customers", "segment"): ["Corporate"], ("orders", "ship_mode"): ["Same Day"]}).collect()}
    assert found == {("customers", "segment"): 1, ("orders", "ship_mode"): 1}
