"""Ingest and enrichment runs over a sheet derived from the mart.

The sheet is rebuilt from the whole mart with export-style noise
(``flat_from_mart``), then loaded back into tables; seller upsert and
assignment run over the mart itself.  Money leaves as DOUBLE and line ids as text, for
comparison.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.operators import ingest as I
from martlet.operators.sellers import (add_missing_column, assign_sellers, update_column,
                                       upsert_sellers)
from martlet.params import TPCH_REGIONS, TPCH_SEGMENTS, TPCH_SHIP_MODES
from martlet.plans.dashboard import yearly_sales
from martlet.plans.frames import dashboard_frame
from martlet.schema import TABLES
from martlet.session import freed_shuffles, materialize, owned_tables, tables_folder
from martlet.sources.flat import flat_in_parts, read_dashboard_csv, read_flat, sample_rows
from martlet.sources.mart import Mart
from martlet.sources.store import append_mart, read_mart, write_mart

TPCH_DOMAINS = I.Domains(segments=TPCH_SEGMENTS, regions=TPCH_REGIONS,
                         ship_modes=TPCH_SHIP_MODES)

UPSERT_HELD_BACK_REGION = "EUROPE"


def _comparable(df: DataFrame) -> DataFrame:
    """Money as DOUBLE, line ids (which may exceed 64 bits) as text."""
    types = {"sales": "double", "discount": "double", "profit": "double", "seller_rating": "double",
             "id": "string", "row_id": "string"}
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})


# The derived sheet plays the part of the input file: it is written once per
# mart as a table in the session's checkpoint folder (which cuts its lineage)
# and every ingest job reads that stored copy.
_SHEETS: dict[int, tuple[Mart, DataFrame]] = {}


def noisy_sheet(m: Mart) -> DataFrame:
    key = id(m)
    if key not in _SHEETS:
        spark, path = m.orders.sparkSession, _fresh_path(m, "sheet")
        with owned_tables(spark), freed_shuffles(spark):
            for rows in flat_in_parts(m):
                (rows.write.mode("append").option("parquet.block.size", 16 * 1024 * 1024)
                 .option("compression", "zstd").parquet(path))
        _SHEETS[key] = (m, spark.read.schema(rows.schema).parquet(path))
    return _SHEETS[key][1]


def load_from_sheet(m: Mart, table: str, flat: DataFrame | None = None) -> DataFrame:
    """One table (or ``rejects``) of the ingest of a sheet (default: the noisy one)."""
    flat = noisy_sheet(m) if flat is None else flat
    if table in ("categories", "subcategories"):
        pairs = materialize(I.named_pairs(flat), "category-pairs")
        categories = materialize(I.ingest_categories(pairs), "categories")
        return categories if table == "categories" else I.ingest_subcategories(pairs, categories)
    of = {"customers": I.customers_of, "products": I.products_of, "orders": I.orders_of,
          "order_details": I.order_details_of, "rejects": I.rejects_of}
    return _comparable(of[table](I.stage(flat, TPCH_DOMAINS)))


def ingest_sheet_csv(m: Mart) -> DataFrame:
    """The noisy sheet exported as CSV, its columns in another order under padded
    headers (compressed: it is text of many times the sheet's stored size), read back by header
    name; then the order lines of its ingest.  Where the sheet is not stored yet, its rows go straight
    into the CSV, which takes its place as the input file."""
    spark, path = m.orders.sparkSession, _fresh_path(m, "sheet-csv")
    with owned_tables(spark), freed_shuffles(spark):
        for rows in [noisy_sheet(m)] if id(m) in _SHEETS else flat_in_parts(m):
            names = sorted(rows.columns)
            (rows.select(*[F.col(f"`{c}`").alias(f" {c} ") for c in names])
             .write.mode("append").option("header", True).option("compression", "gzip").csv(path))
    return load_from_sheet(m, "order_details", read_flat(spark, path))


def staged_categories(m: Mart) -> DataFrame:
    """The sheet as a staging view, and its distinct (category, sub-category) pairs in SQL."""
    noisy_sheet(m).createOrReplaceTempView("staged_sheet")
    return m.orders.sparkSession.sql("""
        SELECT DISTINCT trim(Category) AS category, trim(`Sub-Category`) AS sub_category
        FROM staged_sheet WHERE Category IS NOT NULL""")


def stored_frame_yearly_sales(m: Mart) -> DataFrame:
    """The dashboard frame written once, and a report over the stored copy."""
    return yearly_sales(m, frame=materialize(dashboard_frame(m), "dashboard-frame"))


def _fresh_path(m: Mart, label: str) -> str:
    return f"{tables_folder(m.orders.sparkSession)}/{label}-{uuid.uuid4().hex}"


def upsert_sellers_demo(m: Mart) -> DataFrame:
    """Sellers of every region but one are already stored; the full seller list
    arrives again with new e-mail addresses.  Stored rows keep theirs; the
    held-back region's sellers are inserted with the new ones."""
    held_back = F.col("seller_region").eqNullSafe(F.lit(UPSERT_HELD_BACK_REGION))
    existing = m.sellers.filter(~held_back)
    incoming = m.sellers.withColumn(
        "seller_email",
        F.concat(F.lower(F.regexp_replace("seller_name", "#", ".")), F.lit("@sellers.example")))
    return _comparable(upsert_sellers(existing, incoming))


def assigned_order_details(m: Mart) -> DataFrame:
    return _comparable(assign_sellers(m))


def add_seller_column(m: Mart) -> DataFrame:
    """The order lines of a store without sellers, given the seller column."""
    bare = m.order_details.drop("seller_id")
    return _comparable(add_missing_column(bare, "seller_id", "long"))


def update_line_sellers(m: Mart) -> DataFrame:
    """The assignment of the lines with even ids, applied to the fact by key.  The lines
    are read twice, so they are numbered once and stored."""
    m = m.replace(order_details=materialize(m.order_details, "lines"))
    updates = assign_sellers(m).filter(F.col("id") % 2 == 0)
    return _comparable(update_column(m.order_details, updates, "id", "seller_id"))


def append_order_details(m: Mart) -> DataFrame:
    """A full refresh with the lines of even ids, then an append of the others, made twice as
    a retried job would; the stored fact holds every line once.  The lines are written three
    times over, so they are numbered once and stored."""
    path = _fresh_path(m, "append")
    m = m.replace(order_details=materialize(m.order_details, "lines"))
    even = F.col("id") % 2 == 0
    write_mart(m.replace(order_details=m.order_details.filter(even)), path)
    rest = {t: m.table(t).filter(F.lit(False)) for t in TABLES}
    rest["order_details"] = m.order_details.filter(~even)
    for _ in range(2):
        append_mart(Mart(**rest), path, "odd-lines")
    return _comparable(read_mart(m.orders.sparkSession, path).order_details)


SAMPLE_ROWS = 500


def sheet_head_sample(m: Mart, n: int = SAMPLE_ROWS) -> DataFrame:
    """The loader's sampling switch: the first ``n`` sheet rows in input order."""
    return sample_rows(noisy_sheet(m), n).withColumn("row_id", F.col("row_id").cast("string"))


def csv_data_range(m: Mart) -> DataFrame:
    """The dashboard frame exported as (compressed) CSV, read back with inferred types and
    lenient date parsing, then the data-range numbers over it."""
    spark = m.orders.sparkSession
    path = _fresh_path(m, "dashboard-csv")
    (dashboard_frame(m).drop("year", "month")
     .write.option("header", True).option("compression", "gzip").csv(path))
    frame = read_dashboard_csv(spark, path)
    return frame.agg(F.count(F.lit(1)).alias("total_records"),
                     F.min("year").cast("int").alias("min_year"),
                     F.max("year").cast("int").alias("max_year"))


def load_sheet(flat: DataFrame, sellers: DataFrame, path: str,
               domains: I.Domains = I.Domains()) -> Mart:
    """The whole load as one run: ingest the sheet, give every line a seller,
    and write each table once (full refresh) plus the rejects (``read_stored(...,
    "rejects")``); returns the stored mart.  The load's intermediates are deleted when the tables
    are stored.  Seller ids are kept as text, like the sheet's other ids."""
    spark = flat.sparkSession
    with owned_tables(spark):
        res = I.ingest(flat, domains)
        text_sellers = sellers.withColumn("seller_id", F.col("seller_id").cast("string"))
        mart = Mart(categories=res.categories, subcategories=res.subcategories,
                    sellers=text_sellers, customers=res.customers, products=res.products,
                    orders=res.orders, order_details=res.order_details)
        mart = mart.replace(order_details=assign_sellers(mart))
        write_mart(mart, path, rejects=res.rejects)
    return read_mart(spark, path)
