"""Line ids where there are more lines than one range holds: orders of ordinary size, an
order that is larger than a range, and lines without an order."""

import os

import pytest
from pyspark.sql import functions as F

from martlet.operators.ranking import CONF_ROWS_PER_BUCKET
from martlet.plans import reports as R
from martlet.plans.loads import csv_data_range, ingest_sheet_csv, update_line_sellers
from martlet.sources import mart as M

SF = "/root/testdata/sf0.001"


def _copy(spark, folder, line_keys):
    """The tables of sf0.001, with the order keys of the lines replaced."""
    for name in ("part", "nation", "region", "customer", "supplier", "orders"):
        os.symlink(f"{SF}/{name}.parquet", f"{folder}/{name}.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.withColumn("l_orderkey", line_keys).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def _chunked(spark, folder, rows="500"):
    spark.conf.set(CONF_ROWS_PER_BUCKET, rows)
    try:
        return M._build_tpch_mart(spark, folder)
    finally:
        spark.conf.unset(CONF_ROWS_PER_BUCKET)


def _final_plan(df):
    df.write.mode("overwrite").format("noop").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_ordinary_orders_are_shuffled_once_by_order(spark):
    m = _chunked(spark, SF)
    plan = _final_plan(m.order_details.select("id", "order_id"))
    assert "_chunk" not in plan and plan.count("Exchange hashpartitioning") == 1, plan


def test_reports_without_line_ids_number_nothing(spark):
    plan = _final_plan(R.filter_category(_chunked(spark, SF), "ECONOMY"))
    assert "l_linenumber" not in plan and "_chunk" not in plan


@pytest.mark.parametrize("share", [3, 1000])
def test_ids_with_a_large_order_and_lines_without_one(spark, tmp_path, share):
    key = F.col("l_orderkey")
    folder = _copy(spark, tmp_path, F.when(key % 7 == 0, F.lit(None).cast("long"))
                   .when(key % share == 1, F.lit(1).cast("long")).otherwise(key))
    plain, chunked = M._build_tpch_mart(spark, folder), _chunked(spark, folder)
    a, b = plain.order_details, chunked.order_details
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert b.where("order_id is null").count() > 0


def test_exports_are_compressed(spark, monkeypatch):
    from martlet.plans import loads as L
    paths, fresh = [], L._fresh_path
    monkeypatch.setattr(L, "_fresh_path", lambda m, label: paths.append(fresh(m, label)) or paths[-1])
    m = M._build_tpch_mart(spark, SF)
    assert csv_data_range(m).first()["total_records"] == R.wide_fact(m).count()
    assert ingest_sheet_csv(m).count() > 0
    for p in paths:
        names = [n for n in os.listdir(p) if n.startswith("part-")]
        assert names and all(n.endswith(".csv.gz") for n in names)


def test_lines_read_more_than_once_are_numbered_once(spark):
    plan = update_line_sellers(M._build_tpch_mart(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "_w0" not in plan and "l_linenumber" not in plan
