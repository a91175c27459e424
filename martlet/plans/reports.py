"""The database-side reports: listings, filters and the SQL aggregate reports.

Aggregates are pushed below the dimension joins wherever the group key is a
function of the joined key: lines are first summed per product / order /
seller (partial aggregation on the map side, then one row per key crosses the
shuffle), and only those sums meet the dimension tables.  Distinct order and
customer counts become plain counts at the right level, with no Expand.

Money sums stay DECIMAL (exact, so independent of partitioning) and are cast
to DOUBLE at the end; averages are exact sum / count in DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.functions.scalar import exact_avg_round
from martlet.plans.frames import newest_first, order_dim, product_dim, wide_fact, wide_join
from martlet.sources.mart import Mart


def _dbl(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _desc(c: str) -> Column:
    # Descending with NULLs first, the database's default for DESC.
    return F.col(c).desc_nulls_first()


# --------------------------------------------------------------------------
# Listings (one table each, ordered as the reference lists them)
# --------------------------------------------------------------------------

def list_categories(m: Mart) -> DataFrame:
    return m.categories.select("category_id", "category_name", "description") \
        .orderBy("category_id")


def list_subcategories(m: Mart) -> DataFrame:
    return m.subcategories.select("subcategory_id", "category_id", "subcategory_name") \
        .orderBy("subcategory_id")


def list_sellers(m: Mart) -> DataFrame:
    return (m.sellers.select("seller_id", "seller_name", "seller_email", "seller_phone",
                             "seller_region", _dbl("seller_rating").alias("seller_rating"),
                             "join_date")
            .orderBy("seller_id"))


def list_customers(m: Mart) -> DataFrame:
    return m.customers.select("customer_id", "customer_name", "segment", "country", "city",
                              "state", "postal_code", "region").orderBy("customer_id")


def list_products(m: Mart) -> DataFrame:
    return m.products.select("product_id", "category_id", "subcategory_id", "product_name") \
        .orderBy("product_id")


def list_orders(m: Mart) -> DataFrame:
    return (m.orders.select("order_id", "order_date", "ship_date", "ship_mode", "customer_id")
            .orderBy(_desc("order_date"), "order_id"))


def list_order_details(m: Mart) -> DataFrame:
    """In the order of the line ids, which are shown as text: they may exceed 64 bits."""
    return (m.order_details.orderBy("id")
            .select(F.col("id").cast("string").alias("id"), "order_id", "product_id", "seller_id",
                    _dbl("sales").alias("sales"), "quantity", _dbl("discount").alias("discount"),
                    _dbl("profit").alias("profit")))


# --------------------------------------------------------------------------
# Attribute and range filters over the wide fact
# --------------------------------------------------------------------------

def filter_category(m: Mart, category: str) -> DataFrame:
    return newest_first(wide_join(m)).filter(F.col("category") == F.lit(category))


def filter_region(m: Mart, region: str) -> DataFrame:
    return newest_first(wide_join(m)).filter(F.col("region") == F.lit(region))


def filter_date_range(m: Mart, start: str, end: str) -> DataFrame:
    """Inclusive ``order_date BETWEEN start AND end``; a stored mart reads those years only."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return newest_first(wide_join(m.in_years(F.year(first), F.year(last)))).filter(
        F.col("order_date").between(first, last))


# --------------------------------------------------------------------------
# Aggregate reports
# --------------------------------------------------------------------------

def _lines_per(m: Mart, key: str) -> DataFrame:
    """Per-key sums over order lines (the pre-aggregation every report starts from)."""
    d = m.order_details
    return d.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count("sales").alias("n_sales"),
        F.count("profit").alias("n_profit"),
        F.sum("quantity").alias("qty"),
        F.sum("sales").alias("s"),
        F.sum("profit").alias("p"),
        F.sum(F.when(F.col("profit") > 0, F.col("profit")).otherwise(F.lit(0))).alias("p_pos"),
        F.sum(F.when(F.col("profit") < 0, F.col("profit")).otherwise(F.lit(0))).alias("p_neg"),
    )


def sales_by_category(m: Mart) -> DataFrame:
    """Lines, quantity, sales, profit and mean line sales per category."""
    per_cat = (_lines_per(m, "product_id")
               .join(m.products.select("product_id", "category_id"), "product_id")
               .join(m.categories.select("category_id", "category_name"), "category_id")
               .groupBy(F.col("category_name").alias("category"))
               .agg(F.sum("n_lines").alias("total_orders"), F.sum("qty").alias("total_quantity"),
                    F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("n_sales").alias("ns")))
    return (per_cat.select("category", "total_orders", "total_quantity",
                           _dbl("s").alias("total_sales"), _dbl("p").alias("total_profit"),
                           (_dbl("s") / F.col("ns")).alias("avg_sales"))
            .orderBy(_desc("total_sales"), "category"))


def _orders_with_customer(m: Mart) -> DataFrame:
    return m.orders.select("order_id", "customer_id", "order_date")


def sales_by_segment(m: Mart) -> DataFrame:
    """Distinct orders, distinct customers, sales and profit per segment.

    Three-level grouping instead of two COUNT(DISTINCT): lines -> orders ->
    (segment, customer) -> segment.  Exact because an order has one customer
    and a customer one segment.
    """
    per_cust = (_lines_per(m, "order_id")
                .join(_orders_with_customer(m), "order_id")
                .join(m.customers.select("customer_id", "segment"), "customer_id")
                .groupBy("segment", "customer_id")
                .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("s").alias("s"),
                     F.sum("p").alias("p")))
    return (per_cust.groupBy("segment")
            .agg(F.sum("n_orders").alias("total_orders"),
                 F.count(F.lit(1)).alias("total_customers"),
                 _dbl(F.sum("s")).alias("total_sales"), _dbl(F.sum("p")).alias("total_profit"))
            .orderBy(_desc("total_sales"), "segment"))


def top_products(m: Mart, limit: int = 10) -> DataFrame:
    """Best-selling products by sales (grouped by product id), top ``limit``."""
    ranked = (_lines_per(m, "product_id").join(product_dim(m), "product_id")
              .select("product_id", "product_name", "category", "sub_category",
                      F.col("n_lines").alias("order_count"), F.col("qty").alias("total_quantity"),
                      _dbl("s").alias("total_sales"), _dbl("p").alias("total_profit"))
              .orderBy(_desc("total_sales"), "product_id").limit(limit))
    return ranked.drop("product_id")


def _customer_totals(m: Mart) -> DataFrame:
    return (_lines_per(m, "order_id").join(_orders_with_customer(m), "order_id")
            .groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("s").alias("s"),
                 F.sum("p").alias("p"), F.sum("n_sales").alias("ns")))


def top_customers(m: Mart, limit: int = 10) -> DataFrame:
    """Top customers by sales; ``avg_order_value`` is the mean line value."""
    ranked = (_customer_totals(m)
              .join(m.customers.select("customer_id", "customer_name", "segment", "region"),
                    "customer_id")
              .select("customer_id", "customer_name", "segment", "region",
                      F.col("n_orders").alias("total_orders"), _dbl("s").alias("total_sales"),
                      _dbl("p").alias("total_profit"),
                      (_dbl("s") / F.col("ns")).alias("avg_order_value"))
              .orderBy(_desc("total_sales"), "customer_id").limit(limit))
    return ranked.drop("customer_id")


def sales_trend_monthly(m: Mart) -> DataFrame:
    """Distinct orders, sales, profit and mean line sales per calendar month."""
    per_month = (_lines_per(m, "order_id").join(_orders_with_customer(m), "order_id")
                 .groupBy(F.trunc("order_date", "month").alias("month"))
                 .agg(F.count(F.lit(1)).alias("total_orders"), F.sum("s").alias("s"),
                      F.sum("p").alias("p"), F.sum("n_sales").alias("ns")))
    return (per_month.select("month", "total_orders", _dbl("s").alias("total_sales"),
                             _dbl("p").alias("total_profit"),
                             (_dbl("s") / F.col("ns")).alias("avg_sales"))
            .orderBy("month"))


def _seller_totals(m: Mart) -> DataFrame:
    return _lines_per(m, "seller_id").join(
        m.sellers.select("seller_id", "seller_name", "seller_region", "seller_rating"),
        "seller_id")


def top_sellers(m: Mart, limit: int = 10) -> DataFrame:
    """Top sellers by sales; ``total_orders`` counts lines."""
    ranked = (_seller_totals(m)
              .select("seller_id", "seller_name", "seller_region",
                      _dbl("seller_rating").alias("seller_rating"),
                      F.col("n_lines").alias("total_orders"), F.col("qty").alias("total_quantity"),
                      _dbl("s").alias("total_sales"), _dbl("p").alias("total_profit"),
                      exact_avg_round(F.col("p"), F.col("n_profit"), 2)
                      .alias("avg_profit_per_order"))
              .orderBy(_desc("total_sales"), "seller_id").limit(limit))
    return ranked.drop("seller_id")


def seller_performance(m: Mart) -> DataFrame:
    """Every seller's sales, profit and line count, best rating first."""
    return (_seller_totals(m)
            .select("seller_id", "seller_name", _dbl("seller_rating").alias("seller_rating"),
                    _dbl("s").alias("total_sales"), _dbl("p").alias("total_profit"),
                    F.col("n_lines").alias("total_orders"))
            .orderBy(_desc("seller_rating"), "seller_id")
            .drop("seller_id"))


def profit_by_category(m: Mart) -> DataFrame:
    """Profit per category split into gains and losses (NULL profit adds 0 to both)."""
    per_cat = (_lines_per(m, "product_id")
               .join(m.products.select("product_id", "category_id"), "product_id")
               .join(m.categories.select("category_id", "category_name"), "category_id")
               .groupBy(F.col("category_name").alias("category"))
               .agg(F.sum("p").alias("p"), F.sum("p_pos").alias("pp"),
                    F.sum("p_neg").alias("pn"), F.sum("n_lines").alias("order_count")))
    return (per_cat.select("category", _dbl("p").alias("total_profit"),
                           _dbl("pp").alias("positive_profit"), _dbl("pn").alias("negative_profit"),
                           "order_count")
            .orderBy(_desc("total_profit"), "category"))


INVOICE_COLUMNS = [
    "order_id", "order_date", "ship_date", "ship_mode", "customer_id", "customer_name",
    "segment", "country", "city", "state", "postal_code", "region", "product_id",
    "product_name", "category_name", "subcategory_name", "seller_name", "seller_region",
    "quantity", "sales", "discount", "profit",
]


def order_invoice(m: Mart, order_id) -> DataFrame:
    """Every line of one order with all its attributes, by line id.  The order
    filter is bound as a literal and reaches both the order and the line scans."""
    # The order table is filtered too (the lines already are): filter
    # inference runs once, so without it the order's ship-date aggregate would
    # not learn the key and would aggregate every line of the fact.
    one = F.col("order_id") == F.lit(order_id)
    m = m.replace(orders=m.orders.filter(one))
    d = m.order_details.filter(one)
    return (wide_join(m, d)
            .select("id", *[c for c in INVOICE_COLUMNS if c not in ("category_name",
                                                                      "subcategory_name")],
                    F.col("category").alias("category_name"),
                    F.col("sub_category").alias("subcategory_name"))
            .withColumns({c: _dbl(c) for c in ("sales", "discount", "profit")})
            .orderBy("id")
            .select(*INVOICE_COLUMNS))


def search_orders(m: Mart, term: str = "", limit: int = 50) -> DataFrame:
    """Orders whose id or customer name contains ``term`` (case-insensitive,
    ``%`` and ``_`` act as wildcards), with item count, sales and profit;
    newest first.  The date is the order's own, so the newest ``limit`` matching orders
    that have lines are taken first (the fact gives only its order ids for that), and
    only their lines are summed."""
    pattern = f"%{term}%"
    lines = m.order_details.select("order_id", "sales", "profit")
    newest = (order_dim(m)
              .filter(F.col("order_id").cast("string").ilike(pattern)
                      | F.col("customer_name").ilike(pattern))
              .select("order_id", "order_date", "customer_name", "city", "state")
              .join(lines.select("order_id"), "order_id", "left_semi")
              .orderBy(_desc("order_date"), "order_id").limit(limit))
    per_order = (newest.join(lines, "order_id")
                 .groupBy("order_id", "order_date", "customer_name", "city", "state")
                 .agg(F.count(F.lit(1)).alias("total_items"),
                      _dbl(F.sum("sales")).alias("total_sales"),
                      _dbl(F.sum("profit")).alias("total_profit")))
    return per_order.orderBy(_desc("order_date"), "order_id")
