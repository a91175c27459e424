"""Recency / frequency / monetary scoring per customer.

Per customer: last order date, distinct orders, total sales (orders with at
least one line).  Each measure is cut into quintiles with an exact
NTILE(5) computed by ``ntiles`` from the first key of each tile (no window); ties
are broken on ``customer_id`` ascending.  Labels follow the fixed rule order
below, first match wins.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.functions.scalar import exact_avg_round
from martlet.operators.ranking import ntiles
from martlet.session import materialize
from martlet.sources.mart import Mart


def customer_metrics(m: Mart) -> DataFrame:
    """Lines are summed per order first, so only one row per order meets the
    order and customer tables."""
    per_order = m.order_details.groupBy("order_id").agg(F.sum("sales").alias("s"))
    per_customer = (per_order.join(m.orders.select("order_id", "customer_id", "order_date"),
                                   "order_id")
                    .groupBy("customer_id")
                    .agg(F.max("order_date").alias("last_order_date"),
                         F.count(F.lit(1)).alias("frequency"),
                         F.sum("s").alias("monetary")))
    return per_customer.join(
        m.customers.select("customer_id", "customer_name", "segment", "region"), "customer_id")


def rfm_label(r: Column, f: Column, m: Column) -> Column:
    """The customer label; branch order is part of the definition."""
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
            .when((r >= 3) & (f >= 3) & (m >= 3), "Loyal Customers")
            .when((r >= 4) & (f <= 2), "New Customers")
            .when((r <= 2) & (f >= 3), "At Risk")
            .when((r <= 2) & (f <= 2), "Lost Customers")
            .when((r >= 3) & (f <= 2) & (m >= 3), "Potential Loyalists")
            .when(m >= 4, "Big Spenders")
            .otherwise("Regular Customers"))


RFM_COLUMNS = ["customer_id", "customer_name", "segment", "region", "last_order_date",
               "recency_days", "frequency", "monetary", "r_score", "f_score", "m_score",
               "rfm_score", "customer_segment"]


def rfm_scores(m: Mart, as_of: str | _dt.date | None = None) -> DataFrame:
    """Scores and label per customer, money kept exact (DECIMAL) in ``monetary``.

    ``as_of`` stands for the current date (default: today).  The metrics are
    computed once and written as a table in the session's checkpoint folder:
    the search for the tiles' first keys and the result read that stored copy,
    the fact is aggregated once, and a lost executor cannot make them disagree.
    The three scorings share their passes, and no customer row is shuffled for them.
    """
    today = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    cm = customer_metrics(m).withColumn(
        "recency_days", F.datediff(today, F.col("last_order_date")).cast("int"))
    cm = materialize(cm.withColumn("_neg_recency", -F.col("recency_days")), "customer_metrics")
    scored = ntiles(cm, 5, {"r_score": ["_neg_recency", "customer_id"],
                            "f_score": ["frequency", "customer_id"],
                            "m_score": ["monetary", "customer_id"]})
    r, f, mm = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return (scored.withColumn("rfm_score", r + f + mm)
            .withColumn("customer_segment", rfm_label(r, f, mm))
            .select(*RFM_COLUMNS))


def rfm_analysis(m: Mart, as_of: str | _dt.date | None = None) -> DataFrame:
    """One row per customer, best score first (then larger spend, then id)."""
    return (rfm_scores(m, as_of)
            .withColumn("monetary", F.col("monetary").cast("double"))
            .orderBy(F.col("rfm_score").desc(), F.col("monetary").desc(), "customer_id"))


def rfm_segment_summary(m: Mart, as_of: str | _dt.date | None = None) -> DataFrame:
    """Per label: customers, mean recency (0 places), mean frequency (1 place),
    mean spend and total spend (2 places), largest revenue first."""
    s = rfm_scores(m, as_of)
    g = s.groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum("recency_days").alias("_r"), F.sum("frequency").alias("_f"),
        F.sum("monetary").alias("_m"))
    n = F.col("customer_count")
    return (g.select("customer_segment", "customer_count",
                     exact_avg_round(F.col("_r"), n, 0).alias("avg_recency_days"),
                     exact_avg_round(F.col("_f"), n, 1).alias("avg_frequency"),
                     exact_avg_round(F.col("_m"), n, 2).alias("avg_monetary"),
                     F.round(F.col("_m"), 2).cast("double").alias("total_revenue"))
            .orderBy(F.col("total_revenue").desc_nulls_first(), "customer_segment"))
