"""The stored mart: versions, repeatable appends, orphan keys; sheets without row numbers;
line ids of large order keys; the ingest's stored stage."""

import os
import tempfile
import uuid

import pytest
from helpers import D, basic_mart, rows_of
from pyspark.sql import functions as F

from martlet.operators import ingest as I
from martlet.operators.sellers import assign_sellers
from martlet.plans import dashboard as Dsh
from martlet.plans import loads as L
from martlet.plans.reports import list_order_details
from martlet.sources import store as S
from martlet.sources.flat import in_file_order, read_flat
from martlet.sources.mart import Mart, tpch_mart


@pytest.fixture
def path():
    return f"{tempfile.mkdtemp(prefix='store-')}/{uuid.uuid4().hex}"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(m):
    return sorted(rows_of(m.order_details, "id", "order_id", "product_id", "seller_id", "sales"))


def test_refresh_over_its_own_tables(spark, path):
    m = basic_mart(spark)
    S.write_mart(m, path)
    stored = S.read_mart(spark, path)
    S.write_mart(stored.replace(order_details=stored.order_details.filter("id > 1")), path)
    assert [r[0] for r in _lines(S.read_mart(spark, path))] == [2, 3, 4]
    assert _lines(stored) == _lines(m)  # a reader of the old version still has it


def test_a_refresh_that_fails_leaves_the_old_tables(spark, path):
    m = basic_mart(spark)
    S.write_mart(m, path)
    broken = m.order_details.withColumn("quantity", F.when(F.col("id") < 4, F.col("quantity")).otherwise(
        F.raise_error(F.lit("broken line")).cast("int")))
    with pytest.raises(Exception, match="broken line"):
        S.write_mart(m.replace(order_details=broken), path)
    assert _lines(S.read_mart(spark, path)) == _lines(m)


def test_an_append_made_twice_adds_its_rows_once(spark, path):
    m = basic_mart(spark)
    none = {t: m.table(t).limit(0) for t in ("categories", "subcategories", "sellers", "customers", "products")}
    S.write_mart(m, path)
    later = Mart(**none, orders=m.orders.limit(0), order_details=m.order_details.filter("id = 4").withColumn(
        "id", F.lit(9).cast("long")))
    for _ in range(2):
        S.append_mart(later, path, "2017-03")
    assert [r[0] for r in _lines(S.read_mart(spark, path))] == [1, 2, 3, 4, 9]
    S.append_mart(later.replace(order_details=later.order_details.withColumn("id", F.lit(10).cast("long"))),
                  path, "2017-04")
    assert [r[0] for r in _lines(S.read_mart(spark, path))] == [1, 2, 3, 4, 9, 10]
    with pytest.raises(ValueError):
        S.append_mart(later, path, S.REFRESH)
    with pytest.raises(ValueError):
        S.append_mart(later, f"{path}-none", "x")


ORPHANS = [(5, 999, 10, 1, D("7.00"), 1, D("0.00"), D("1.00")),
           (6, 100, 999, 1, D("7.00"), 1, D("0.00"), D("1.00")),
           (7, 100, 10, 999, D("7.00"), 1, D("0.00"), D("1.00")),
           (8, 100, 10, None, D("7.00"), 1, D("0.00"), D("1.00")),
           (9, None, 10, 1, D("7.00"), 1, D("0.00"), D("1.00"))]


@pytest.mark.parametrize("report", [Dsh.kpi_overview, Dsh.loss_products, Dsh.seller_stats, Dsh.product_sales,
                                    Dsh.customer_spending, Dsh.yearly_sales, Dsh.category_sales_margin])
def test_reports_over_a_mart_with_orphans(spark, path, report):
    m = basic_mart(spark)
    m = m.replace(order_details=m.order_details.unionByName(
        spark.createDataFrame(ORPHANS, m.order_details.schema)))
    S.write_mart(m, path)
    stored = S.read_mart(spark, path)
    assert {k: [r[0] for r in v.collect()] for k, v in stored.orphans.items()} == {
        "order_id": [999], "product_id": [999], "seller_id": [999]}
    assert sorted(map(str, rows_of(report(stored)))) == sorted(map(str, rows_of(report(m))))
    assert stored.replace(orders=m.orders).orphans is None  # they hold for these tables only


def test_parents_that_come_with_an_append_are_found(spark, path):
    m = basic_mart(spark)
    m = m.replace(order_details=m.order_details.unionByName(
        spark.createDataFrame(ORPHANS[:1], m.order_details.schema)))
    S.write_mart(m, path)
    before = Dsh.kpi_overview(S.read_mart(spark, path)).first()
    more = {t: m.table(t).limit(0) for t in ("categories", "subcategories", "sellers", "customers", "products",
                                            "order_details")}
    order = m.orders.limit(1).withColumn("order_id", F.lit(999).cast("long"))
    S.append_mart(Mart(**more, orders=order), path, "order 999")
    assert Dsh.kpi_overview(S.read_mart(spark, path)).first() != before


def test_stored_lines_are_not_shuffled_to_look_for_parents(spark, sf_dir, path):
    S.write_mart(tpch_mart(spark, sf_dir), path)
    stored = S.read_mart(spark, path)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for report in (Dsh.product_sales, Dsh.loss_products, Dsh.kpi_overview):
            plan = _plan(report(stored))
            assert "LeftSemi" not in plan
            anti = [line for line in plan.splitlines() if "LeftAnti" in line]
            assert anti and all("BroadcastHashJoin" in line for line in anti)
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_plain_parquet_tables_are_a_mart_too(spark, path):
    m = basic_mart(spark)
    for name in ("categories", "subcategories", "sellers", "customers", "products", "orders", "order_details"):
        m.table(name).write.parquet(f"{path}/{name}")
    back = S.read_mart(spark, path)
    assert _lines(back) == _lines(m) and back.orphans is None


def test_a_sheet_of_twenty_columns_is_loaded_in_file_order(spark, sf_dir, path):
    """No row number; columns in another order under padded headers; small splits."""
    m = tpch_mart(spark, sf_dir)
    sheet = L.noisy_sheet(m)
    names = sorted(c for c in sheet.columns if c != "row_id")
    (sheet.orderBy("row_id").coalesce(1).select(*[F.col(f"`{c}`").alias(f" {c} ") for c in names])
     .write.option("header", True).csv(f"{path}/csv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "90000")
    try:
        read = read_flat(spark, f"{path}/csv", row_id=None)
        assert read.rdd.getNumPartitions() > 3
        ours = [r[0] for r in read.orderBy("row_id").select("Product ID").collect()]
        mart = L.load_sheet(read, m.sellers, f"{path}/mart", L.TPCH_DOMAINS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert ours == [r[0] for r in sheet.orderBy("row_id").select("Product ID").collect()]
    want = L.load_from_sheet(m, "order_details").select("order_id", "product_id", "quantity", "sales")
    got = mart.order_details.select("order_id", "product_id", "quantity", F.col("sales").cast("double"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert S.read_stored(spark, f"{path}/mart", "rejects").count() == L.load_from_sheet(m, "rejects").count()


def test_file_order_is_by_name_then_line(spark, path):
    for name, rows in (("b", [1, 2, 3]), ("a", [4, 5]), ("c", [6])):
        spark.createDataFrame([(r,) for r in rows], "v int").coalesce(1).write.option("header", True).csv(f"{path}/{name}")
    read = in_file_order(spark.read.option("header", True).csv([f"{path}/{n}" for n in "bca"]))
    assert [r.v for r in read.orderBy("row_id").collect()] == ["4", "5", "1", "2", "3", "6"]


def test_line_ids_of_large_order_keys(spark, sf_dir, path):
    os.makedirs(path)
    for name in ("region", "nation", "customer", "supplier", "part"):
        os.symlink(f"{sf_dir}/{name}.parquet", f"{path}/{name}.parquet")
    shift = 10 ** 13
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumn(key, F.col(key) + F.lit(shift)).write.parquet(
            f"{path}/{name}.parquet")
    small, large = tpch_mart(spark, sf_dir), tpch_mart(spark, path)
    a = {(int(r.id), r.product_id) for r in list_order_details(small).collect()}
    b = {(int(r.id) - shift * 10 ** 9, r.product_id) for r in list_order_details(large).collect()}
    assert a == b and len(a) == small.order_details.count()
    assert assign_sellers(large).where("seller_id is null").count() == 0
    assert L.load_from_sheet(large, "order_details").where(f"cast(id as decimal(38,0)) < {shift}").count() == 0


def test_every_table_of_the_ingest_reads_the_stage(spark, sf_dir):
    m = tpch_mart(spark, sf_dir)
    res = I.ingest(L.noisy_sheet(m), L.TPCH_DOMAINS)
    for name in ("categories", "subcategories", "customers", "products", "orders"):
        plan = _plan(getattr(res, name))
        assert "Exchange" not in plan and "Order ID" not in plan, name
    lines = _plan(res.order_details)  # one pass over the sheet, nothing of it is shuffled
    assert "Exchange hash" not in lines and "Aggregate" not in lines
    assert sum("Order ID" in x for x in lines.splitlines() if "FileScan" in x) == 1
    rejects = _plan(res.rejects)
    assert sum("Order ID" in x for x in rejects.splitlines() if "FileScan" in x) == 1
    assert "Exchange hash" not in rejects


def _files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_range_of_dates_reads_its_years_only(spark, sf_dir, path):
    from martlet.plans.reports import filter_date_range
    m = tpch_mart(spark, sf_dir)
    S.write_mart(m, path)
    stored = S.read_mart(spark, path)
    got = filter_date_range(stored, "1995-03-01", "1995-08-31")
    scans = [x for x in _plan(got).splitlines() if "PartitionFilters" in x and "order_year" in x]
    assert len(scans) == 2 and all("1995" in x for x in scans)  # orders and lines
    want = filter_date_range(m, "1995-03-01", "1995-08-31")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 0
    lines = stored.in_years(F.lit(1995), F.lit(1995)).order_details
    assert all("order_year=1995" in f or "order_year=__HIVE" in f for f in
               (r[0] for r in lines.select(F.input_file_name()).distinct().collect()))


def test_lines_of_an_unknown_year_are_never_left_out(spark, path):
    """Lines without an order, of an undated order, of an order that comes later."""
    from martlet.plans.reports import filter_date_range
    m = basic_mart(spark)
    undated = m.orders.limit(1).withColumns({"order_id": F.lit(200).cast("long"), "order_date": F.lit(None).cast("date")})
    extra = [(5, 999, 10, 1, D("7.00"), 1, D("0.00"), D("1.00")), (6, 200, 10, 1, D("7.00"), 1, D("0.00"), D("1.00"))]
    m = m.replace(orders=m.orders.unionByName(undated),
                  order_details=m.order_details.unionByName(spark.createDataFrame(extra, m.order_details.schema)))
    S.write_mart(m, path)
    stored = S.read_mart(spark, path)
    ids = lambda mart: sorted(r[0] for r in mart.order_details.select("id").collect())
    assert ids(stored.in_years(F.lit(2016), F.lit(2016))) == [1, 2, 5, 6]
    whole, part = Dsh.kpi_overview(stored), Dsh.kpi_overview(stored.in_years(F.lit(1), F.lit(9999)))
    assert rows_of(whole) == rows_of(part)
    none = {t: m.table(t).limit(0) for t in ("categories", "subcategories", "sellers", "customers", "products",
                                            "order_details")}
    late = m.orders.limit(1).withColumns({"order_id": F.lit(999).cast("long"),
                                          "order_date": F.lit("2020-01-05").cast("date")})
    S.append_mart(Mart(**none, orders=late), path, "late")
    found = filter_date_range(S.read_mart(spark, path), "2020-01-01", "2020-12-31")
    assert [r["order_id"] for r in found.collect()] == [999]


def test_a_batch_appended_again_leaves_no_year_behind(spark, path):
    m = basic_mart(spark)
    S.write_mart(m.replace(order_details=m.order_details.limit(0)), path)
    none = {t: m.table(t).limit(0) for t in ("categories", "subcategories", "sellers", "customers", "products", "orders")}
    for ids, want in (("1, 2, 3, 4", [1, 2, 3, 4]), ("3, 4", [3, 4])):
        S.append_mart(Mart(**none, order_details=m.order_details.where(f"id in ({ids})")), path, "b")
        assert [r[0] for r in _lines(S.read_mart(spark, path))] == want
    with pytest.raises(ValueError):
        S.append_mart(Mart(**none, order_details=m.order_details), path, "a/b")


def test_an_update_rewrites_only_the_folders_it_touches(spark, sf_dir, path):
    from martlet.operators.sellers import update_column
    m = tpch_mart(spark, sf_dir)
    folder = S.write_mart(m, path)
    before, lines = _files(f"{folder}/order_details"), S.read_mart(spark, path).by_year["order_details"]
    new = (lines.where("order_year = 1996 and cast(id % 5 as int) = 0")
           .select("id", (F.col("seller_id") * 0 + 1).alias("seller_id")))
    gone = spark.createDataFrame([(None, 3)], "id decimal(38,0), seller_id long")  # null key: of no line
    want = update_column(m.order_details, new, "id", "seller_id").collect()
    assert S.update_lines(spark, path, new.unionByName(gone), "id", "seller_id", "u1") == 1
    after = _files(f"{folder}/order_details")
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert changed and all("order_year=1996" in f for f in changed)
    stored = S.read_mart(spark, path)
    assert stored.orphans is None
    got = stored.order_details.select(*m.order_details.columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    # The same run again finishes from what it stored: the folder is as it was meant to be.
    assert S.update_lines(spark, path, new.limit(0), "id", "seller_id", "u1") == 1
    got = S.read_mart(spark, path).order_details.select(*m.order_details.columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_updates_of_no_line_unknown_years_and_repeated_keys(spark, path):
    m = basic_mart(spark)
    m = m.replace(order_details=m.order_details.unionByName(
        spark.createDataFrame([ORPHANS[0]], m.order_details.schema)))
    S.write_mart(m, path)
    ups = lambda rows: spark.createDataFrame(rows, "id long, seller_id long")
    assert S.update_lines(spark, path, ups([(77, 2)]), "id", "seller_id", "none") == 0
    assert S.update_lines(spark, path, ups([(5, 1), (5, 2), (1, None)]), "id", "seller_id", "one") == 1
    sellers = {r.id: r.seller_id for r in S.read_mart(spark, path).order_details.collect()}
    assert sellers == {1: 1, 2: 2, 3: 2, 4: 1, 5: 2}
    with pytest.raises(ValueError):
        S.update_lines(spark, path, ups([]), "id", "order_id", "x")
    with pytest.raises(ValueError):
        S.update_lines(spark, f"{path}-none", ups([]), "id", "seller_id", "x")


def test_a_scope_deletes_what_was_written_in_it(spark, sf_dir, path):
    from martlet.session import materialize, owned_tables, tables_folder
    shared = tables_folder(spark)
    kept = materialize(spark.range(5), "kept")
    with pytest.raises(RuntimeError):
        with owned_tables(spark) as outer:
            assert tables_folder(spark) == outer
            materialize(spark.range(3), "a")
            with owned_tables(spark) as inner:
                assert materialize(spark.range(4), "b").count() == 4 and inner.startswith(outer)
            assert not os.path.exists(inner) and os.listdir(outer)
            raise RuntimeError("the load failed")
    assert not os.path.exists(outer) and tables_folder(spark) == shared and kept.count() == 5
    m = tpch_mart(spark, sf_dir)
    sheet = L.noisy_sheet(m)
    before = set(os.listdir(shared))
    stored = L.load_sheet(sheet, m.sellers, path, L.TPCH_DOMAINS)
    assert set(os.listdir(shared)) == before  # threads of the load write into its scope too
    assert stored.order_details.count() == L.load_from_sheet(m, "order_details").count()
