"""Dashboard reports: aggregates over the dashboard frame with dataframe-library
semantics (the reference computes these in pandas after loading the wide
fact):

* group keys that are NULL are dropped before grouping;
* a sum over no values is 0, not NULL;
* ``nlargest`` keeps ties in ascending group-key order, so every top-k breaks
  ties on the group keys;
* ``.round(2)`` rounds half to even on the binary value.

Plans never build the wide join for these reports: the dimensions a report
does not read only filter lines (left semi joins on their keys), lines are
summed per key of the dimension it groups by, and only those sums meet that
dimension.  At scale the largest join then sees one row per product, order or
seller instead of one per line.  ``dashboard_reports`` instead shares one
persisted dashboard frame across all reports.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.functions.scalar import half_even_round, money_text, safe_ratio
from martlet.plans.frames import dashboard_frame, order_dim, product_dim
from martlet.plans.reports import top_sellers
from martlet.sources.mart import Mart


def _sum0(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _money(c: str) -> Column:
    """Exact sum of a money column as DOUBLE, 0 when there is nothing to add."""
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def _lines(c: str = "_n") -> Column:
    """Number of order lines behind the grouped rows."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def _keys_present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.filter(cond)


# --------------------------------------------------------------------------
# Sources.  A report aggregates rows that carry the dashboard frame's column
# names plus ``_n`` (order lines behind the row) and ``_named`` (lines with a
# product name).  Given a persisted frame, each line is one row.  Otherwise the
# lines that survive the 7-table inner join are found with semi-joins on the
# dimensions the report does not read, summed per key of the one it groups by,
# and only those sums meet that dimension: the wide join is never built.
# --------------------------------------------------------------------------

MEASURES = ("sales", "profit", "quantity")


def _from_frame(frame: DataFrame) -> DataFrame:
    return frame.withColumns({"_n": F.lit(1),
                              "_named": F.col("product_name").isNotNull().cast("int")})


def _surviving_lines(m: Mart, joined: set[str]) -> DataFrame:
    """Lines kept by the wide inner join; dimensions not in ``joined`` are only
    checked for a matching key (keys are unique, so this equals the join).  A stored mart
    knows the few keys without a parent, and their size: lines are compared with those."""
    d = m.order_details.select("order_id", "product_id", "seller_id", *MEASURES)
    if m.orphans is not None:
        for name in sorted({"order", "product", "seller"} - joined):
            key = f"{name}_id"
            d = d.where(F.col(key).isNotNull()).join(m.orphans[key], key, "left_anti")
        return d
    if "order" not in joined:
        d = d.join(order_dim(m).select("order_id"), "order_id", "left_semi")
    if "product" not in joined:
        d = d.join(product_dim(m).select("product_id"), "product_id", "left_semi")
    if "seller" not in joined:
        d = d.join(m.sellers.select("seller_id"), "seller_id", "left_semi")
    return d


def _sums(df: DataFrame, key: str, extra=()) -> DataFrame:
    return df.groupBy(key).agg(*[F.sum(c).alias(c) for c in MEASURES],
                               F.count(F.lit(1)).alias("_n"), *extra)


def _by_product(m: Mart, line_filter: Column | None = None) -> DataFrame:
    lines = _surviving_lines(m, {"product"})
    if line_filter is not None:
        lines = lines.filter(line_filter)
    return _sums(lines, "product_id").join(
        product_dim(m).select("product_id", "product_name", "category"), "product_id")


def _by_order(m: Mart) -> DataFrame:
    named = product_dim(m).select("product_id",
                                  F.col("product_name").isNotNull().cast("int").alias("_pn"))
    lines = _surviving_lines(m, {"order", "product"}).join(named, "product_id")
    per = _sums(lines, "order_id", [F.sum("_pn").alias("_named")])
    return (per.join(order_dim(m).select("order_id", "customer_name", "order_date"), "order_id")
            .withColumns({"year": F.year("order_date"), "month": F.month("order_date")}))


def _by_seller(m: Mart) -> DataFrame:
    return _sums(_surviving_lines(m, {"seller"}), "seller_id").join(
        m.sellers.select("seller_id", "seller_name", "seller_region", "seller_rating"),
        "seller_id")


def _source(m: Mart, frame: DataFrame | None, level: str,
            line_filter: Column | None = None) -> DataFrame:
    if frame is not None:
        f = frame if line_filter is None else frame.filter(line_filter)
        return _from_frame(f)
    if level == "product":
        return _by_product(m, line_filter)
    if level == "order":
        return _by_order(m)
    return _by_seller(m)


# --------------------------------------------------------------------------
# Reports
# --------------------------------------------------------------------------

def _top_losses(m: Mart, top_n: int, frame: DataFrame | None) -> DataFrame:
    src = _source(m, frame, "product", F.col("profit") < 0)
    losses = _keys_present(src, ["product_name", "category"])
    return (losses.groupBy("product_name", "category")
            .agg(_sum0("quantity").alias("quantity"), F.sum("profit").alias("profit"))
            .orderBy(F.col("quantity").desc(), "product_name", "category")
            .limit(top_n))


def loss_products(m: Mart, top_n: int = 15, frame: DataFrame | None = None) -> DataFrame:
    """Products with the highest quantity sold at a loss: loss lines grouped by
    (product name, category), quantity and profit summed, top ``top_n`` by quantity."""
    return _top_losses(m, top_n, frame).withColumn("profit", F.col("profit").cast("double"))


def loss_summary_by_category(m: Mart, categories: Sequence[str] | None = None,
                             top_n: int = 15, frame: DataFrame | None = None) -> DataFrame:
    """Quantity and loss per listed category over the top loss products; a
    category with none of them shows 0.  The list defaults to every category
    of the mart."""
    top = _top_losses(m, top_n, frame)
    if categories is None:
        listed = m.categories.select(F.col("category_name").alias("category"))
    else:
        spark = m.categories.sparkSession
        listed = spark.createDataFrame([(c,) for c in categories], "category string")
    per_cat = top.groupBy("category").agg(F.sum("quantity").alias("q"), F.sum("profit").alias("p"))
    return (listed.join(per_cat, "category", "left")
            .select("category", F.coalesce("q", F.lit(0)).cast("long").alias("quantity"),
                    F.coalesce(F.col("p").cast("double"), F.lit(0.0)).alias("profit")))


SELLER_STATS_COLUMNS = ["Seller", "Region", "Rating", "Total Sales", "Total Profit",
                        "Total Orders", "Total Quantity"]


def seller_stats(m: Mart, top_n: int = 10) -> DataFrame:
    """Top sellers (database form) under display names, reordered."""
    t = top_sellers(m, limit=top_n)
    return t.select(F.col("seller_name").alias("Seller"), F.col("seller_region").alias("Region"),
                    F.col("seller_rating").alias("Rating"),
                    F.col("total_sales").alias("Total Sales"),
                    F.col("total_profit").alias("Total Profit"),
                    F.col("total_orders").alias("Total Orders"),
                    F.col("total_quantity").alias("Total Quantity"))


def seller_rating_profit(m: Mart, top_n: int = 10) -> DataFrame:
    """Input of the rating-against-profit scatter: rating, profit, line count
    (marker size), region (colour), seller and sales (hover)."""
    return seller_stats(m, top_n).select("Rating", "Total Profit", "Total Orders", "Region",
                                         "Seller", "Total Sales")


def seller_stats_flat(m: Mart, top_n: int = 10, frame: DataFrame | None = None) -> DataFrame:
    """Seller stats from the flat frame: grouped by (name, region, rating)."""
    keys = ["seller_name", "seller_region", "seller_rating"]
    g = (_keys_present(_source(m, frame, "seller"), keys).groupBy(*keys)
         .agg(_money("sales").alias("Total Sales"), _money("profit").alias("Total Profit"),
              _lines().alias("Total Orders"), _sum0("quantity").alias("Total Quantity")))
    return (g.orderBy(F.col("Total Sales").desc(), *keys).limit(top_n)
            .select(F.col("seller_name").alias("Seller"), F.col("seller_region").alias("Region"),
                    F.col("seller_rating").cast("double").alias("Rating"), "Total Sales",
                    "Total Profit", "Total Orders", "Total Quantity"))


def kpi_overview(m: Mart, frame: DataFrame | None = None) -> DataFrame:
    """Headline numbers: rows, sales, profit, distinct customer names."""
    return _source(m, frame, "order").agg(
        _lines().alias("total_records"), _money("sales").alias("total_sales"),
        _money("profit").alias("total_profit"),
        F.count_distinct("customer_name").alias("total_customers"))


def data_range(m: Mart, frame: DataFrame | None = None) -> DataFrame:
    """Rows and the first and last order year."""
    return _source(m, frame, "order").agg(
        _lines().alias("total_records"), F.min("year").cast("int").alias("min_year"),
        F.max("year").cast("int").alias("max_year"))


def customer_spending(m: Mart, top_n: int = 20, frame: DataFrame | None = None,
                      as_text: bool = False) -> DataFrame:
    """Spending per customer name (two customers sharing a name merge); the
    line count is shown as orders.  Top ``top_n`` by sales."""
    g = (_keys_present(_source(m, frame, "order"), ["customer_name"]).groupBy("customer_name")
         .agg(_lines().alias("Total Orders"), _money("sales").alias("Total Sales"),
              _money("profit").alias("Total Profit")))
    top = (g.orderBy(F.col("Total Sales").desc(), "customer_name").limit(top_n)
           .select(F.col("customer_name").alias("Customer Name"), "Total Orders", "Total Sales",
                   "Total Profit"))
    return _as_money_text(top, ["Total Sales", "Total Profit"]) if as_text else top


def product_sales(m: Mart, top_n: int = 20, frame: DataFrame | None = None,
                  as_text: bool = False) -> DataFrame:
    """Quantity, sales and profit per (product name, category), top by quantity."""
    src = _keys_present(_source(m, frame, "product"), ["product_name", "category"])
    g = (src.groupBy("product_name", "category")
         .agg(_sum0("quantity").alias("Total Quantity Sold"), _money("sales").alias("Total Sales"),
              _money("profit").alias("Total Profit")))
    top = (g.orderBy(F.col("Total Quantity Sold").desc(), "product_name", "category")
           .limit(top_n)
           .select(F.col("product_name").alias("Product Name"), F.col("category").alias("Category"),
                   "Total Quantity Sold", "Total Sales", "Total Profit"))
    return _as_money_text(top, ["Total Sales", "Total Profit"]) if as_text else top


def order_summary(m: Mart, top_n: int = 20, frame: DataFrame | None = None,
                  as_text: bool = False) -> DataFrame:
    """Per order: customer, date (as text), sales, profit, item count; newest first.

    Customer and date are attributes of the order, so each order carries one
    value of each: the customer name joins the group key (same groups, and the
    aggregate stays a hash aggregate), the date is its ``max``.  Without a frame the
    newest orders are found from keys alone and only their lines are summed."""
    if frame is None:
        m = m.replace(order_details=_lines_of_newest(m, top_n))
    g = (_keys_present(_source(m, frame, "order"), ["order_id"])
         .groupBy("order_id", F.col("customer_name").alias("Customer"))
         .agg(F.max("order_date").alias("_date"),
              _money("sales").alias("Total Sales"), _money("profit").alias("Total Profit"),
              _lines("_named").alias("Items Count")))
    top = (g.orderBy(F.col("_date").desc_nulls_last(), "order_id").limit(top_n)
           .select(F.col("order_id").alias("Order ID"), "Customer",
                   F.date_format("_date", "yyyy-MM-dd").alias("Order Date"), "Total Sales",
                   "Total Profit", "Items Count"))
    return _as_money_text(top, ["Total Sales", "Total Profit"]) if as_text else top


def _lines_of_newest(m: Mart, top_n: int) -> DataFrame:
    """The lines of the ``top_n`` newest orders among those with a line in the wide join."""
    kept = _surviving_lines(m, set()).select("order_id")
    newest = (m.orders.select("order_id", "order_date").join(kept, "order_id", "left_semi")
              .orderBy(F.col("order_date").desc_nulls_last(), "order_id").limit(top_n))
    return m.order_details.join(newest.select("order_id"), "order_id", "left_semi")


def category_sales_margin(m: Mart, frame: DataFrame | None = None,
                          as_text: bool = False) -> DataFrame:
    """Sales, profit, quantity, lines and margin % (half-even, 2 places) per
    category.  A category with zero sales gets a NULL margin."""
    g = (_keys_present(_source(m, frame, "product"), ["category"]).groupBy("category")
         .agg(_money("sales").alias("Total Sales"), _money("profit").alias("Total Profit"),
              _sum0("quantity").alias("Total Quantity"), _lines().alias("Total Orders")))
    margin = half_even_round(safe_ratio(F.col("Total Profit"), F.col("Total Sales"))
                             * F.lit(100.0), 2)
    out = (g.withColumn("Profit Margin %", margin)
           .orderBy(F.col("Total Sales").desc(), "category")
           .select(F.col("category").alias("Category"), "Total Sales", "Total Profit",
                   "Total Quantity", "Total Orders", "Profit Margin %"))
    return _as_money_text(out, ["Total Sales", "Total Profit"]) if as_text else out


def yearly_sales(m: Mart, frame: DataFrame | None = None) -> DataFrame:
    """Sales per order year."""
    src = _keys_present(_source(m, frame, "order"), ["year"])
    return (src.groupBy(F.col("year").cast("int").alias("year"))
            .agg(_money("sales").alias("sales")).orderBy("year"))


def order_source(m: Mart, frame: DataFrame | None = None) -> DataFrame:
    """Per-order sums with the order's date, year and month (or the frame's
    lines), for reports grouped by attributes of the order."""
    return _source(m, frame, "order")


def _as_money_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: money_text(c) for c in cols})


def dashboard_reports(m: Mart) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Every dashboard report over one persisted dashboard frame (the frame is
    built once and reused by all of them).  Returns the frame, so the caller
    can ``unpersist()`` it when done, and the reports by name."""
    frame = dashboard_frame(m).persist()
    reports = {
        "loss_products": loss_products(m, frame=frame),
        "loss_summary_by_category": loss_summary_by_category(m, frame=frame),
        "seller_stats_flat": seller_stats_flat(m, frame=frame),
        "kpi_overview": kpi_overview(m, frame=frame),
        "data_range": data_range(m, frame=frame),
        "customer_spending": customer_spending(m, frame=frame),
        "product_sales": product_sales(m, frame=frame),
        "order_summary": order_summary(m, frame=frame),
        "category_sales_margin": category_sales_margin(m, frame=frame),
        "yearly_sales": yearly_sales(m, frame=frame),
    }
    return frame, reports
