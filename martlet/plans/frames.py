"""The two frames most reports hang on: the wide fact (7-table inner join) and
the dashboard frame (wide fact plus year and month).

The joins are written dimension-first: orders with their customer form one
order-level dimension, products with category and subcategory one
product-level dimension, so the fact meets three keyed sides (order, product,
seller).  Small sides become broadcasts through the static size estimate or,
at runtime, through AQE's measured shuffle sizes; large ones stay shuffle
joins.  Nothing is hinted blindly.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from martlet.functions.scalar import to_number
from martlet.operators.ranking import bucket_of, rows_per_bucket
from martlet.session import freed_shuffles, materialize, owned_tables, tables_folder
from martlet.sources.mart import Mart

WIDE_COLUMNS = [
    "order_id", "order_date", "ship_date", "ship_mode", "customer_id", "customer_name",
    "segment", "country", "city", "state", "postal_code", "region", "product_id", "category",
    "sub_category", "product_name", "seller_id", "seller_name", "seller_region", "seller_rating",
    "quantity", "sales", "discount", "profit",
]


def order_dim(m: Mart) -> DataFrame:
    """Orders joined to their customer (inner: an order without one drops)."""
    return m.orders.join(m.customers, "customer_id")


def product_dim(m: Mart) -> DataFrame:
    """Products with category and subcategory names (inner joins)."""
    cats = m.categories.select("category_id", F.col("category_name").alias("category"))
    subs = m.subcategories.select("subcategory_id",
                                  F.col("subcategory_name").alias("sub_category"))
    return m.products.join(cats, "category_id").join(subs, "subcategory_id")


def wide_join(m: Mart, details: DataFrame | None = None) -> DataFrame:
    """The 7-table inner join with exact (decimal) money columns.  A line whose
    seller is NULL drops out, as in any inner join.  Products come first: lines that meet
    their price by product are dealt by it already, and a filter on products leaves fewer
    lines to be dealt by order."""
    d = m.order_details if details is None else details
    return (d.join(product_dim(m), "product_id")
            .join(order_dim(m), "order_id")
            .join(m.sellers.drop("seller_email", "seller_phone", "join_date"), "seller_id"))


PARTS = 8           # parts, by order, in which the joins of a large fact are worked off at most,
PART_BUCKETS = 2    # each of so many times ``rows_per_bucket`` lines or more
SLICES = 512        # sorted slices of the wide rows at most; beyond, they get larger
SAMPLED = 16        # sampled lines for each slice
SLICE_KEY = ["_age", "order_id", "product_id", "seller_id"]


def order_parts(m: Mart, orders: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(lines, ``orders``) by hash of the order id, in up to ``PARTS`` parts.  Where each is written
    inside ``freed_shuffles``, the disk holds the shuffles of one part at a time; the filter reaches
    the scan of the lines."""
    part_rows = PART_BUCKETS * rows_per_bucket(m.orders.sparkSession)
    parts = max(1, min(PARTS, math.ceil(m.order_details.count() / part_rows)))
    for part in range(parts):
        mine = F.pmod(F.hash("order_id"), F.lit(parts)) == part
        yield (m.order_details, orders) if parts == 1 else (m.order_details.where(mine), orders.where(mine))


def _with_age(rows: DataFrame) -> DataFrame:
    """``_age`` ascends as the order date descends, rows without one first."""
    return rows.withColumn("_age", F.coalesce(-F.unix_date("order_date"), F.lit(-2**31)))


def _slice_cuts(m: Mart, orders: DataFrame, slices: int, n: int) -> tuple[list[Row], StructType]:
    """The keys that cut the wide rows' order into about ``slices`` equal ranges, from a
    sample of the lines (``SAMPLED`` for each)."""
    spark, keys = m.orders.sparkSession, m.order_details.select("order_id", "product_id", "seller_id")
    keys = keys.where(F.col("order_id").isNotNull() & F.col("product_id").isNotNull() & F.col("seller_id").isNotNull())
    picked = spark.createDataFrame(keys.where(F.rand(7) < min(1.0, SAMPLED * slices / n)).collect(), keys.schema)
    dated = _with_age(picked.join(orders.select("order_id", "order_date"), "order_id")).select(*SLICE_KEY)
    found = sorted(dated.collect(), key=tuple)
    return [found[i * len(found) // slices] for i in range(1, slices)] if found else [], dated.schema


def _wide_rows_in_slices(m: Mart, n: int) -> list[DataFrame]:
    """The rows of the wide join as stored tables, each a range of the order that
    ``wide_fact`` has.  One plan would keep the shuffles of all its joins and of the sort, wider with each,
    on disk until the last row is written; here the lines are joined part by part, and what
    remains on disk are the compressed slices.  Orders are joined last: rows of an order, which share the
    widest columns, then lie next to each other where they are dealt to their slices."""
    spark = m.orders.sparkSession
    path = f"{tables_folder(spark)}/wide-rows-{uuid.uuid4().hex}"
    slices = min(SLICES, math.ceil(n / rows_per_bucket(spark)))
    with owned_tables(spark), freed_shuffles(spark):
        orders = order_dim(m)
        orders = materialize(orders.select(*[c for c in WIDE_COLUMNS if c in orders.columns]), "order-dim")
        own = ["order_id", *[c for c in WIDE_COLUMNS if c not in orders.columns]]
        cuts, keys = _slice_cuts(m, orders, slices, n)
        for lines, mine in order_parts(m, orders):
            sold = lines.join(product_dim(m), "product_id").join(m.sellers, "seller_id").select(*own)
            rows = sold.join(mine, "order_id").select(*WIDE_COLUMNS)
            dealt = _with_age(rows).withColumn("_slice", bucket_of(SLICE_KEY, keys, cuts)).drop("_age")
            (dealt.repartitionById(len(cuts) + 1, "_slice").write.mode("append").partitionBy("_slice")
             .option("compression", "zstd").parquet(path))
        stored = spark.read.schema(dealt.schema).parquet(path).select("_slice").distinct().collect()
    return [spark.read.schema(rows.schema).parquet(f"{path}/_slice={k}") for k in sorted(r["_slice"] for r in stored)]


def _coerced(wide: DataFrame) -> DataFrame:
    return wide.select(*WIDE_COLUMNS).withColumns(
        {c: to_number(c) for c in ("sales", "discount", "profit", "seller_rating")})


def _sort_key() -> list[Column]:
    """Newest first; the extra keys only break ties, and they let the ranges of the sort split one
    very large order across tasks."""
    return [F.col("order_date").desc_nulls_first(), *map(F.col, ["order_id", "product_id", "seller_id"])]


def newest_first(wide: DataFrame) -> DataFrame:
    """Wide rows in order, numeric columns coerced to numbers."""
    return _coerced(wide).orderBy(*_sort_key())


def wide_fact(m: Mart) -> DataFrame:
    """The 24-column wide fact, numeric columns coerced to numbers, newest first.  Beyond
    ``rows_per_bucket`` lines it is stored in slices of the order first, and the result is the
    slices one after the other, each sorted by one task: no shuffle of all rows at their full width."""
    n = m.order_details.count()
    if n <= rows_per_bucket(m.orders.sparkSession):
        return newest_first(wide_join(m))
    slices = _wide_rows_in_slices(m, n)
    if not slices:
        return newest_first(wide_join(m).limit(0))
    # The first is sorted through a shuffle: a union of single partitions alone would be put
    # into one partition.
    frames = [newest_first(slices[0]),
              *[_coerced(s.coalesce(1)).sortWithinPartitions(*_sort_key()) for s in slices[1:]]]
    while len(frames) > 1:   # pairwise, so that the plan of many slices is not deep
        frames = [reduce(DataFrame.unionAll, frames[i:i + 2]) for i in range(0, len(frames), 2)]
    return frames[0]


def dashboard_frame(m: Mart) -> DataFrame:
    """Wide fact plus ``year`` and ``month`` of the order date, unsorted, money
    kept exact so every sum over it is order-independent."""
    return (wide_join(m).select(*WIDE_COLUMNS)
            .withColumns({"year": F.year("order_date"), "month": F.month("order_date")}))
