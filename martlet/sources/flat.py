"""Flat sales sheets: read one, or derive one from a mart.

The reference loads a 20-column sheet, one row per order line.  ``read_flat``
reads such a sheet from CSV or parquet with an explicit schema, trimming the
header names; ``flat_from_mart`` rebuilds the sheet from a mart, optionally
with the kinds of noise real exports carry (padded / re-cased enum text,
unparseable dates, missing sub-category, missing money), so that the ingest
can be tested on whole tables against a known answer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.operators.ranking import global_position
from martlet.plans.frames import order_dim, order_parts, product_dim
from martlet.schema import FLAT_COLUMNS, FLAT_SCHEMA, LINE_ID
from martlet.session import materialize
from martlet.sources.mart import Mart


def read_flat(spark: SparkSession, path: str, fmt: str = "csv",
              row_id: str | None = "row_id") -> DataFrame:
    """A flat sheet, its columns found by (trimmed) header name in any order.

    CSV cells are read as text and cast to the sheet's types; a cell that is no
    number becomes null, as the loader's coercion has it.  A sheet column that the
    header lacks is an error.  ``row_id`` names the column with the input order; a sheet
    without one (None) is numbered in the order of its files' names and lines.
    """
    if fmt == "csv":
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    names = [c.strip() for c in raw.columns]
    if row_id is None:
        raw, row_id = in_file_order(raw).toDF(*names, "row_id"), "row_id"
    else:
        raw = raw.toDF(*names)
    if fmt != "csv":
        return raw
    types = {f.name: f.dataType for f in FLAT_SCHEMA.fields}
    wanted = [c for c in types if c != "row_id"]
    missing = [c for c in [*wanted, row_id] if c not in raw.columns]
    if missing:
        raise ValueError(f"the sheet lacks the columns {missing}")
    cells = [F.col(f"`{c}`").try_cast(types[c]).alias(c) for c in wanted]
    return raw.select(F.col(f"`{row_id}`").try_cast(types["row_id"]).alias("row_id"), *cells)


SPLIT_ROWS = 1 << 33   # room for the rows of a split, as in Spark's own row numbers


def in_file_order(scan: DataFrame) -> DataFrame:
    """A file scan with ``row_id``, ascending with file name and line (not dense).

    Two passes and no sort of the rows: the first finds the splits (file, first byte) and
    Spark's number of each one's first row; splits are ranked, and the second pass adds a
    row's distance from its split's first row.  However the splits are dealt to tasks, the
    result is the same."""
    numbered = scan.select("*", F.col("_metadata.file_path").alias("_file"),
                           F.col("_metadata.file_block_start").alias("_start"),
                           F.monotonically_increasing_id().alias("_at"))
    found = materialize(numbered.groupBy("_file", "_start").agg(F.min("_at").alias("_first")), "splits")
    splits, _ = global_position(found, ["_file", "_start"], "_split")
    splits = materialize(splits.withColumnsRenamed({"_file": "_f", "_start": "_s"}), "ranked-splits")
    row_id = F.col("_split").cast(LINE_ID) * F.lit(SPLIT_ROWS).cast("decimal(12,0)") + (F.col("_at") - F.col("_first"))
    return (numbered.join(splits, (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
            .select(*[F.col(f"`{c}`") for c in scan.columns], row_id.cast(LINE_ID).alias("row_id")))


# Types of the dashboard export's columns; any other column stays text.
DASHBOARD_TYPES = {"order_id": "long", "customer_id": "long", "product_id": "long",
                   "seller_id": "long", "seller_rating": "double", "quantity": "int",
                   "sales": "double", "discount": "double", "profit": "double"}


def read_dashboard_csv(spark: SparkSession, path: str) -> DataFrame:
    """The dashboard's CSV export: header row, fixed types by column name (nothing is
    inferred, so no value depends on a sample), both dates parsed leniently, ``year``
    and ``month`` added."""
    df = spark.read.option("header", True).csv(path)
    out = df.withColumns({c: F.col(c).try_cast(t) for c, t in DASHBOARD_TYPES.items()
                          if c in df.columns})
    for c in ("order_date", "ship_date"):
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(F.try_to_timestamp(F.col(c)),
                                               F.col(c).try_cast("timestamp")))
    return out.withColumns({"year": F.year("order_date"), "month": F.month("order_date")})


def sample_rows(flat: DataFrame, n: int | None, order: str = "row_id") -> DataFrame:
    """The first ``n`` rows in input order (all rows when ``n`` is None): the
    sheet-sampling switch of the loader."""
    return flat if not n else flat.orderBy(order).limit(n)


def flat_from_mart(m: Mart, noisy: bool = True) -> DataFrame:
    """One row per order line with the 20 sheet columns plus ``row_id``."""
    return _sheet_rows(m, m.order_details, order_dim(m), noisy)


def flat_in_parts(m: Mart, noisy: bool = True) -> Iterator[DataFrame]:
    """The same rows part by part (``order_parts``).  The orders with their customers are stored once,
    for all parts."""
    for lines, orders in order_parts(m, materialize(order_dim(m), "order-dim")):
        yield _sheet_rows(m, lines, orders, noisy)


def _sheet_rows(m: Mart, d: DataFrame, orders: DataFrame, noisy: bool) -> DataFrame:
    # Products first, as in ``wide_join``; the sheet's rows then lie by order, so that each task
    # sees few orders and customers more than once when the ingest looks for first rows.
    lines = d.join(product_dim(m), "product_id").join(orders, "order_id")
    rid = F.col("id")

    def every(k: int):
        return (rid % k == 0) if noisy else F.lit(False)

    def enum_noise(c: str):
        return F.when(every(3), F.concat(F.lit("  "), F.lower(F.col(c)), F.lit(" "))) \
            .otherwise(F.col(c))

    def date_text(c: str):
        return F.when(every(97), F.lit("not a date")).otherwise(F.date_format(c, "yyyy-MM-dd"))

    def money(c):
        return F.when(every(89), F.lit(None).cast("double")).otherwise(c.cast("double"))

    return lines.select(
        rid.alias("row_id"),
        F.col("order_id").cast("string").alias("Order ID"),
        date_text("order_date").alias("Order Date"),
        date_text("ship_date").alias("Ship Date"),
        enum_noise("ship_mode").alias("Ship Mode"),
        F.col("customer_id").cast("string").alias("Customer ID"),
        F.col("customer_name").alias("Customer Name"),
        enum_noise("segment").alias("Segment"),
        F.col("country").alias("Country"),
        F.col("city").alias("City"),
        F.col("state").alias("State"),
        F.col("postal_code").alias("Postal Code"),
        enum_noise("region").alias("Region"),
        F.col("product_id").cast("string").alias("Product ID"),
        F.when(every(3), F.concat(F.col("category"), F.lit(" "))).otherwise(F.col("category"))
        .alias("Category"),
        F.when(every(101), F.lit(None).cast("string")).otherwise(F.col("sub_category"))
        .alias("Sub-Category"),
        F.col("product_name").alias("Product Name"),
        money(F.col("sales")).alias("Sales"),
        F.col("quantity").cast("double").alias("Quantity"),
        money(F.col("discount")).alias("Discount"),
        money(F.round(F.col("profit"), 2)).alias("Profit"),
    ).select("row_id", *FLAT_COLUMNS)
