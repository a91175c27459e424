"""The stored mart: versions that are complete or absent, appends that can be repeated,
updates that rewrite only the folders they touch.

A full refresh writes every table into a folder of its own, and only then a line into the
log under ``_versions``.  Readers take the newest logged version, so a refresh that
fails half way, or one that reads the very folder it writes, leaves the old tables as they
are.  Each table is laid out by ``batch``: the refresh is batch ``0``, and an append replaces
the folder of its own batch id, so running it again changes nothing (an append that
fails half way is run again; until then its batch may be incomplete).

Orders and order lines are laid out by ``order_year`` inside a batch: the year of the order's
date.  A line's year is looked up among the orders of the refresh and of its own batch; where
they do not give one year it has none, and no reader leaves it out.  Reports over a range of dates
read the years they need (``Mart.in_years``).

With a refresh go the keys of order lines without a parent (``orphans``).  They are found once,
from distinct keys, and stored: reports over the mart then drop those lines by a join with
a side whose size is known before the fact is read, and need not shuffle the fact to
look for parents.  After an append or an update reports look for the parents again.
"""

from __future__ import annotations

import re
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.operators.sellers import update_column
from martlet.plans.frames import order_dim, product_dim
from martlet.schema import TABLES
from martlet.sources.mart import Mart

LOG = "version string, batch string, at double"
REFRESH = "0"
BY_YEAR = ("orders", "order_details")
LAYOUT = T.StructType([T.StructField("batch", T.StringType()), T.StructField("order_year", T.IntegerType())])


def _log(spark: SparkSession, base: str) -> list:
    """All log lines, oldest first (none for a folder without versions)."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(LOG).json(f"{base}/_versions").orderBy("at").collect()
    except AnalysisException:
        return []


def _note(spark: SparkSession, base: str, version: str, batch: str) -> None:
    line = spark.createDataFrame([(version, batch, time.time())], LOG).coalesce(1)
    line.write.mode("append").json(f"{base}/_versions")


def current_version(spark: SparkSession, path: str) -> str:
    """The folder of the newest complete version (``path`` itself if it holds plain tables)."""
    base = path.rstrip("/")
    refreshes = [r["version"] for r in _log(spark, base) if r["batch"] == REFRESH]
    return f"{base}/{refreshes[-1]}" if refreshes else base


def _folder_name(label: str) -> str:
    """``label`` where it can stand in a folder name as it is."""
    if not re.fullmatch(r"[A-Za-z0-9._ -]+", label):
        raise ValueError(f"{label!r}: use letters, digits, dots, dashes, underscores and blanks")
    return label


def _put(df: DataFrame, folder: str, name: str, batch: str) -> None:
    target = f"{folder}/{name}/batch={_folder_name(batch)}"
    writer = df.write
    if name in BY_YEAR:
        # Rows of a year are brought together, in tasks of even size: a year holding a third of
        # all rows is split, and no task writes a small file into every year.
        writer = df.hint("rebalance", "order_year").write.partitionBy("order_year")
    writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(target)


def _put_schema(df: DataFrame, folder: str, name: str) -> None:
    df.drop(*LAYOUT.names).limit(0).coalesce(1).write.parquet(f"{folder}/schemas/{name}")


def _laid_out(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a version with its layout columns."""
    own = spark.read.parquet(f"{folder}/schemas/{name}").schema
    layout = LAYOUT.fields if name in BY_YEAR else LAYOUT.fields[:1]
    return spark.read.schema(T.StructType(own.fields + layout)).parquet(f"{folder}/{name}")


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return _laid_out(spark, folder, name).drop(*LAYOUT.names)


def _with_years(orders: DataFrame, details: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """Orders and lines with ``order_year``; ``known`` are the orders that date the lines."""
    year = F.year("order_date")
    years = (known.where(F.col("order_id").isNotNull()).groupBy("order_id")
             .agg(F.min(year).alias("_low"), F.max(year).alias("_high"),
                  F.bool_and(F.col("order_date").isNotNull()).alias("_dated"))
             .select("order_id", F.when(F.col("_dated") & (F.col("_low") == F.col("_high")),
                                        F.col("_low")).alias("order_year")))
    return {"orders": orders.withColumn("order_year", year),
            "order_details": details.join(years, "order_id", "left").select(*details.columns, "order_year")}


def orphan_keys(m: Mart) -> dict[str, DataFrame]:
    """Per foreign key of the order lines, its values that no parent row answers to: distinct
    keys first, so that one row a key and task is shuffled, not the lines."""
    parents = {"order_id": order_dim(m), "product_id": product_dim(m), "seller_id": m.sellers}
    return {key: m.order_details.select(key).where(F.col(key).isNotNull()).distinct()
            .join(parent.select(key), key, "left_anti") for key, parent in parents.items()}


def write_mart(mart: Mart, path: str, **more: DataFrame) -> str:
    """Full refresh: store every table, and the frames in ``more`` beside them, as a new
    version; returns its folder."""
    base, version = path.rstrip("/"), f"v-{uuid.uuid4().hex}"
    spark, folder = mart.orders.sparkSession, f"{base}/{version}"
    tables = {**{name: mart.table(name) for name in TABLES}, **more,
              **_with_years(mart.orders, mart.order_details, mart.orders)}
    for name, df in tables.items():
        _put_schema(df, folder, name)
        _put(df, folder, name, REFRESH)
    for key, keys in orphan_keys(_tables(spark, folder)).items():
        keys.write.parquet(f"{folder}/orphans/{key}")
    _note(spark, base, version, REFRESH)
    return folder


def _open_version(spark: SparkSession, path: str) -> tuple[str, str]:
    base = path.rstrip("/")
    folder = current_version(spark, base)
    if folder == base:
        raise ValueError(f"{base} holds no stored version to change")
    return base, folder


def append_mart(mart: Mart, path: str, batch: str) -> None:
    """Add the rows of ``mart`` to the current version.  ``batch`` names them: the same batch
    written again takes the place of the first."""
    if _folder_name(batch) == REFRESH:
        raise ValueError(f"batch {REFRESH!r} is the refresh itself")
    spark = mart.orders.sparkSession
    base, folder = _open_version(spark, path)
    # Noted first: an append that fails half way must not leave old orphan keys in use.
    _note(spark, base, folder.rsplit("/", 1)[1], batch)
    # The refresh's orders do not change within a version, nor do the batch's without its lines.
    known = (_laid_out(spark, folder, "orders").where(F.col("batch") == REFRESH)
             .select("order_id", "order_date").unionByName(mart.orders.select("order_id", "order_date")))
    tables = {**{name: mart.table(name) for name in TABLES},
              **_with_years(mart.orders, mart.order_details, known)}
    for name, df in tables.items():
        _put(df, folder, name, batch)


def update_lines(spark: SparkSession, path: str, updates: DataFrame, key: str, col: str, update: str) -> int:
    """``UPDATE order_details SET col = u.col FROM updates u WHERE key matches`` in the current
    version: only the (batch, year) folders that hold a matching line are rewritten.  Returns how many.

    Lines without an update, or with a null one, keep their value; of several updates of one key
    the largest counts.  ``update`` names the run.  The folders' new rows are stored first, under
    that name: a run that died while it replaced the folders is finished by running it again."""
    if col == "order_id":
        raise ValueError("an order id decides a line's folder and cannot be updated")
    base, folder = _open_version(spark, path)
    version, staged = folder.rsplit("/", 1)[1], f"{folder}/updates/{_folder_name(update)}"
    lines, done = _laid_out(spark, folder, "order_details"), f"staged {update}"
    if not any(r["version"] == version and r["batch"] == done for r in _log(spark, base)):
        new = updates.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(col).alias(col))
        touched = (lines.join(new.where(F.col(col).isNotNull()).select(key), key, "left_semi")
                   .groupBy("batch").agg(F.collect_set(F.coalesce("order_year", F.lit(-1))).alias("years"))
                   .collect())  # one row a batch, one number a year
        held = reduce(lambda a, b: a | b, [
            (F.col("batch") == r["batch"]) & F.coalesce("order_year", F.lit(-1)).isin(*r["years"])
            for r in touched], F.lit(False))
        rows = update_column(lines.where(held), new, key, col)
        rows.write.mode("overwrite").parquet(staged)
        _note(spark, base, version, done)
    rows = spark.read.schema(lines.schema).parquet(staged)
    (rows.hint("rebalance", *LAYOUT.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*LAYOUT.names).parquet(f"{folder}/order_details"))
    return rows.select(*LAYOUT.names).distinct().count()


def _tables(spark: SparkSession, folder: str) -> Mart:
    return Mart(**{name: _read(spark, folder, name) for name in TABLES})


def read_mart(spark: SparkSession, path: str) -> Mart:
    """The current version of a stored mart (or plain Parquet tables, one folder each)."""
    base = path.rstrip("/")
    folder = current_version(spark, base)
    if folder == base:
        return Mart(**{name: spark.read.parquet(f"{base}/{name}") for name in TABLES})
    mart = _tables(spark, folder)
    mart.by_year = {name: _laid_out(spark, folder, name).drop("batch") for name in BY_YEAR}
    if not any(f"{base}/{r['version']}" == folder and r["batch"] != REFRESH for r in _log(spark, base)):
        mart.orphans = {key: spark.read.schema(mart.order_details.select(key).schema).parquet(
            f"{folder}/orphans/{key}") for key in ("order_id", "product_id", "seller_id")}
    return mart


def read_stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of the current version, such as the rejects of a load."""
    return _read(spark, current_version(spark, path), name)
