"""Ingest: a flat sales sheet (one row per order line, 20 columns plus a
``row_id`` giving input order) becomes the normalised tables.

The reference loads row by row into a database.  Here :func:`stage` judges the sheet's
categories, customers, products and orders once and stores them, each row with the reason
that rejects it; every table and the rejects read that stage, and the order lines are one
pass over the sheet that meets only the (stored, so known to be small or not) keys of
rejected orders and products:

* categories: distinct trimmed names, ids by name order;
* subcategories: distinct trimmed (category, sub-category) pairs whose
  category is known, ids by pair order;
* customers / products / orders: the first row (by ``row_id``) per trimmed
  key, attributes normalised (text trimmed, enum text mapped onto its domain,
  dates parsed leniently);
* order lines: every row, missing money and quantity as 0;
* rejects: every customer, product, order and line that breaks a rule of its table
  or points at a rejected parent, with the first reason; accepted and rejected
  lines together are the whole sheet.

Name lookups are equi-joins on the trimmed names; keep-first is a partial
aggregate, never a sort of the sheet.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.functions.scalar import lenient_date, norm_enum, norm_text
from martlet.operators.dedup import keep_first
from martlet.operators.ranking import dense_rank_ids
from martlet.schema import DISCOUNT, MONEY, REGIONS, SEGMENTS, SHIP_MODES
from martlet.session import freed_shuffles, materialize


@dataclass
class Domains:
    segments: Sequence[str] = tuple(SEGMENTS)
    regions: Sequence[str] = tuple(REGIONS)
    ship_modes: Sequence[str] = tuple(SHIP_MODES)


def named_pairs(flat: DataFrame) -> DataFrame:
    """The distinct (category_name, subcategory_name) of a sheet, trimmed; all that the two
    tables below need, in one pass over the sheet."""
    return flat.select(norm_text("Category").alias("category_name"),
                       norm_text("Sub-Category").alias("subcategory_name")).distinct()


def ingest_categories(pairs: DataFrame) -> DataFrame:
    names = pairs.select("category_name").filter(F.col("category_name").isNotNull()).distinct()
    return (dense_rank_ids(names, ["category_name"], "category_id")
            .select("category_id", "category_name",
                    F.lit(None).cast("string").alias("description")))


def ingest_subcategories(pairs: DataFrame, categories: DataFrame) -> DataFrame:
    """Pairs with either side missing are dropped; a pair whose category is
    unknown is skipped."""
    known = (pairs.filter(F.col("category_name").isNotNull() & F.col("subcategory_name").isNotNull())
             .join(categories.select("category_id", "category_name"), "category_name"))
    return (dense_rank_ids(known, ["category_name", "subcategory_name"], "subcategory_id")
            .select("subcategory_id", "category_id", "subcategory_name"))


def _first_per_key(flat: DataFrame, key_col: str, cols: Sequence[str]) -> DataFrame:
    keyed = flat.withColumn("_key", norm_text(key_col))
    return keep_first(keyed.filter(F.col("_key").isNotNull()), "_key", "row_id", cols)


# The rules of each table as (reason, condition that breaks it); the first broken rule
# names the reject.
def _customer_rules() -> list[tuple[str, Column]]:
    return [("no customer name", F.col("customer_name").isNull())]


def _product_rules() -> list[tuple[str, Column]]:
    return [("unknown category", F.col("category_id").isNull()),
            ("no subcategory", F.col("subcategory_id").isNull()),
            ("no product name", F.col("product_name").isNull())]


def _order_rules() -> list[tuple[str, Column]]:
    return [("no order date", F.col("order_date").isNull()),
            ("no customer id", F.col("customer_id").isNull()),
            ("shipped before ordered", F.col("ship_date") < F.col("order_date"))]


def _line_rules() -> list[tuple[str, Column]]:
    # An amount is null only where the cell does not fit its type: missing ones are 0.
    amounts = [F.col(c).isNull() for c in ("sales", "discount", "profit")]
    return [("no order id", F.col("order_id").isNull()),
            ("no product id", F.col("product_id").isNull()),
            ("amount out of range", amounts[0] | amounts[1] | amounts[2]),
            ("quantity not above 0", ~F.coalesce(F.col("quantity") > 0, F.lit(False))),
            ("negative sales", F.col("sales") < 0),
            ("discount outside 0 to 1", ~F.col("discount").between(0, 1))]


def _judge(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    return df.withColumn("reason", F.coalesce(*[F.when(broken, F.lit(reason))
                                                for reason, broken in rules]))


def _accepted(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNull())


def _rejected(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNotNull())


def _judged_customers(flat: DataFrame, domains: Domains = Domains()) -> DataFrame:
    first = _first_per_key(flat, "Customer ID", ["Customer Name", "Segment", "Country", "City",
                                                 "State", "Postal Code", "Region"])
    return _judge(first.select(
        "row_id", F.col("_key").alias("customer_id"),
        norm_text("Customer Name").alias("customer_name"),
        norm_enum("Segment", domains.segments).alias("segment"),
        norm_text("Country").alias("country"),
        norm_text("City").alias("city"),
        norm_text("State").alias("state"),
        norm_text("Postal Code").alias("postal_code"),
        norm_enum("Region", domains.regions).alias("region")), _customer_rules())


def _resolved_products(flat: DataFrame, categories: DataFrame,
                       subcategories: DataFrame) -> DataFrame:
    """First row per product with its category id, subcategory id and reject reason.  The
    subcategory is matched on (category, name), else on the name alone (lowest
    id with that name)."""
    first = _first_per_key(flat, "Product ID", ["Category", "Sub-Category", "Product Name"])
    named_subs = subcategories.join(categories.select("category_id", "category_name"),
                                    "category_id")
    by_pair = named_subs.select("category_name", "subcategory_name",
                                F.col("subcategory_id").alias("_sub_pair"))
    by_name = (subcategories.groupBy("subcategory_name")
               .agg(F.min("subcategory_id").alias("_sub_name")))
    found = (first.select(F.col("_key").alias("product_id"), "row_id",
                         norm_text("Category").alias("category_name"),
                         norm_text("Sub-Category").alias("subcategory_name"),
                         norm_text("Product Name").alias("product_name"))
            .join(categories.select("category_id", "category_name"), "category_name", "left")
            .join(by_pair, ["category_name", "subcategory_name"], "left")
            .join(by_name, "subcategory_name", "left")
            .withColumn("subcategory_id", F.coalesce("_sub_pair", "_sub_name")))
    return _judge(found, _product_rules())


def _judged_orders(flat: DataFrame, bad_customers: DataFrame,
                   domains: Domains = Domains()) -> DataFrame:
    """First row per order; orders have a date and an accepted customer, and are not shipped
    before they were placed."""
    first = _first_per_key(flat, "Order ID", ["Order Date", "Ship Date", "Ship Mode",
                                              "Customer ID"])
    types = {f.name: f.dataType for f in flat.schema.fields}
    own = _judge(first.select(
        "row_id", F.col("_key").alias("order_id"),
        lenient_date("Order Date", types["Order Date"]).alias("order_date"),
        lenient_date("Ship Date", types["Ship Date"]).alias("ship_date"),
        norm_enum("Ship Mode", domains.ship_modes).alias("ship_mode"),
        norm_text("Customer ID").alias("customer_id")), _order_rules())
    parents = bad_customers.select("customer_id", F.lit("customer rejected").alias("_parent"))
    return (own.join(parents, "customer_id", "left")
            .withColumn("reason", F.coalesce("reason", "_parent")).drop("_parent"))


def _judged_lines(flat: DataFrame) -> DataFrame:
    """Every line with the reason of its own rules (parents are not looked at)."""
    def amount(c: str, dtype):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0)).try_cast(dtype)

    return _judge(flat.select(
        F.col("row_id").alias("id"),
        norm_text("Order ID").alias("order_id"),
        norm_text("Product ID").alias("product_id"),
        F.lit(None).cast("string").alias("seller_id"),
        amount("Sales", MONEY).alias("sales"),
        amount("Quantity", "int").alias("quantity"),
        amount("Discount", DISCOUNT).alias("discount"),
        amount("Profit", MONEY).alias("profit")), _line_rules())


@dataclass
class Stage:
    """A judged sheet.  Categories and subcategories are final; customers, products and
    orders hold every key's first row with ``reason`` (null: accepted); the ``bad_...``
    tables hold the rejected keys alone.  All but the sheet are stored tables."""
    flat: DataFrame
    categories: DataFrame
    subcategories: DataFrame
    customers: DataFrame
    products: DataFrame
    orders: DataFrame
    bad_orders: DataFrame
    bad_products: DataFrame


def stage(flat: DataFrame, domains: Domains = Domains()) -> Stage:
    """Judge a sheet: one aggregate of it per table, each written once.  ``flat`` should be
    a stored table or file, for it is read once per table.  Categories and orders do not need each
    other and run side by side; products, whose aggregate is the largest (a sheet has few lines of a product
    in one task), run alone.  A table's shuffles go when it is written."""
    def bad(judged: DataFrame, key: str, label: str) -> DataFrame:
        return materialize(_rejected(judged).select(key), label)

    def of_categories():
        pairs = materialize(named_pairs(flat), "category-pairs")
        categories = materialize(ingest_categories(pairs), "categories")
        return categories, materialize(ingest_subcategories(pairs, categories), "subcategories")

    def of_orders():
        customers = materialize(_judged_customers(flat, domains), "judged-customers")
        orders = materialize(_judged_orders(flat, _rejected(customers), domains), "judged-orders")
        return customers, orders, bad(orders, "order_id", "bad-orders")

    with freed_shuffles(flat.sparkSession), ThreadPoolExecutor(2) as pool:
        chains = [pool.submit(inheritable_thread_target(flat.sparkSession)(f)) for f in (of_categories, of_orders)]
        (categories, subcategories), (customers, orders, bad_orders) = [c.result() for c in chains]
        products = materialize(_resolved_products(flat, categories, subcategories), "judged-products")
        bad_products = bad(products, "product_id", "bad-products")
    return Stage(flat, categories, subcategories, customers, products, orders, bad_orders, bad_products)


def customers_of(st: Stage) -> DataFrame:
    return _accepted(st.customers).drop("row_id", "reason")


def products_of(st: Stage) -> DataFrame:
    """Products with a name whose category and subcategory resolve."""
    return _accepted(st.products).select("product_id", "category_id", "subcategory_id", "product_name")


def orders_of(st: Stage) -> DataFrame:
    return _accepted(st.orders).select("order_id", "order_date", "ship_date", "ship_mode", "customer_id")


def order_details_of(st: Stage) -> DataFrame:
    """Every line that keeps its rules and whose order and product were accepted; ``id``
    is the input order."""
    return (_accepted(_judged_lines(st.flat))
            .join(st.bad_orders, "order_id", "left_anti")
            .join(st.bad_products, "product_id", "left_anti")
            .select("id", "order_id", "product_id", "seller_id", "sales", "quantity", "discount",
                    "profit"))


def rejects_of(st: Stage) -> DataFrame:
    """(table_name, key, row_id, reason) of everything the tables leave out.  A line's own
    rules come first, then its order, then its product."""
    def listed(rows: DataFrame, table: str, key: str, row_id: str = "row_id") -> DataFrame:
        return rows.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("key"),
                           F.col(row_id).alias("row_id"), "reason")

    lines = (_judged_lines(st.flat)
             .join(st.bad_orders.select("order_id", F.lit("order rejected").alias("_order")),
                   "order_id", "left")
             .join(st.bad_products.select("product_id", F.lit("product rejected").alias("_product")),
                   "product_id", "left")
             .withColumn("reason", F.coalesce("reason", "_order", "_product")))
    return (listed(_rejected(st.customers), "customers", "customer_id")
            .unionByName(listed(_rejected(st.products), "products", "product_id"))
            .unionByName(listed(_rejected(st.orders), "orders", "order_id"))
            .unionByName(listed(_rejected(lines), "order_details", "id", "id")))


@dataclass
class IngestResult:
    categories: DataFrame
    subcategories: DataFrame
    customers: DataFrame
    products: DataFrame
    orders: DataFrame
    order_details: DataFrame
    rejects: DataFrame


def ingest(flat: DataFrame, domains: Domains = Domains()) -> IngestResult:
    """All six tables and the rejects from one sheet (the stage is stored, the rest lazy)."""
    st = stage(flat, domains)
    return IngestResult(
        categories=st.categories, subcategories=st.subcategories, customers=customers_of(st),
        products=products_of(st), orders=orders_of(st), order_details=order_details_of(st),
        rejects=rejects_of(st))
