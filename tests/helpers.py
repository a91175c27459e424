"""Hand-made marts for edge-case tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from martlet.sources.mart import Mart

SCHEMAS = {
    "categories": "category_id int, category_name string, description string",
    "subcategories": "subcategory_id int, category_id int, subcategory_name string",
    "sellers": ("seller_id long, seller_name string, seller_email string, seller_phone string, "
                "seller_region string, seller_rating decimal(3,2), join_date date"),
    "customers": ("customer_id long, customer_name string, segment string, country string, "
                  "city string, state string, postal_code string, region string"),
    "products": "product_id long, category_id int, subcategory_id int, product_name string",
    "orders": "order_id long, order_date date, ship_date date, ship_mode string, customer_id long",
    "order_details": ("id long, order_id long, product_id long, seller_id long, "
                      "sales decimal(12,2), quantity int, discount decimal(5,2), "
                      "profit decimal(12,2)"),
}


def D(x) -> Decimal | None:
    return None if x is None else Decimal(str(x))


def day(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def mart_from_rows(spark, **rows) -> Mart:
    tables = {name: spark.createDataFrame(rows.get(name, []), schema)
              for name, schema in SCHEMAS.items()}
    return Mart(**tables)


def basic_mart(spark, **overrides) -> Mart:
    """Two categories, three products, two customers, two sellers, a few orders."""
    rows = dict(
        categories=[(1, "Furniture", None), (2, "Technology", None)],
        subcategories=[(1, 1, "Chairs"), (2, 2, "Phones")],
        sellers=[(1, "S One", "one@x", None, "East", D("4.50"), None),
                 (2, "S Two", "two@x", None, "West", D("3.75"), None)],
        customers=[(1, "Ann", "Consumer", "US", None, None, None, "East"),
                   (2, "Bob", "Corporate", "US", None, None, None, "West")],
        products=[(10, 1, 1, "Chair A"), (11, 1, 1, "Chair B"), (20, 2, 2, "Phone X")],
        orders=[(100, day("2016-03-15"), day("2016-03-20"), "First Class", 1),
                (101, day("2017-02-10"), day("2017-02-12"), "Same Day", 2),
                (102, day("2017-03-15"), day("2017-03-16"), "Same Day", 1)],
        order_details=[(1, 100, 10, 1, D("100.00"), 2, D("0.10"), D("20.00")),
                       (2, 100, 20, 2, D("50.00"), 1, D("0.00"), D("-5.00")),
                       (3, 101, 11, 2, D("80.00"), 4, D("0.20"), D("-10.00")),
                       (4, 102, 20, 1, D("30.00"), 3, D("0.00"), D("6.00"))],
    )
    rows.update(overrides)
    return mart_from_rows(spark, **rows)


def rows_of(df, *cols):
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]


def as_set(df, *cols):
    return set(rows_of(df, *cols))


__all__ = ["D", "day", "mart_from_rows", "basic_mart", "rows_of", "as_set", "T"]
