"""Year-to-date against last year.

"YTD" is months 1..m of the newest year in the data, m being the last month
with orders in that year; "last year" is the same months one year earlier.
The frame is first reduced to one row per (year, month) — at most twelve per
year of calendar, whatever the data size.  The newest (year, month) is then a
window maximum over that calendar-bounded set, so the fact is read once, with
no driver round trip, no subquery re-running the fact, and no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.functions.scalar import ratio_or_zero
from martlet.plans.dashboard import order_source
from martlet.sources.mart import Mart


def ytd_comparison(m: Mart, frame: DataFrame | None = None) -> DataFrame:
    f = order_source(m, frame)
    ym = (f.filter(F.col("year").isNotNull() & F.col("month").isNotNull())
          .groupBy("year", "month")
          .agg(F.sum("sales").alias("s"), F.sum("profit").alias("p")))
    # One window over the (year, month) rows: at most 12 per calendar year.
    newest = F.max(F.struct("year", "month")).over(Window.partitionBy())
    ym = ym.withColumn("_newest", newest)
    cy, cm = F.col("_newest.year"), F.col("_newest.month")
    in_current = (F.col("year") == cy) & (F.col("month") <= cm)
    in_last = (F.col("year") == cy - 1) & (F.col("month") <= cm)

    def total(cond, col):
        return F.coalesce(F.sum(F.when(cond, F.col(col))).cast("double"), F.lit(0.0))

    sums = ym.agg(F.max(cy).alias("_cy"),
                  total(in_current, "s").alias("sales_current"),
                  total(in_current, "p").alias("profit_current"),
                  total(in_last, "s").alias("sales_last"),
                  total(in_last, "p").alias("profit_last"))
    sc, pc = F.col("sales_current"), F.col("profit_current")
    sl, pl = F.col("sales_last"), F.col("profit_last")
    return (sums.select(F.col("_cy").cast("int").alias("current_year"), "sales_current",
                        "profit_current",
                        "sales_last", "profit_last",
                        ratio_or_zero(pc, sc).alias("margin_current"),
                        ratio_or_zero(pl, sl).alias("margin_last"),
                        ratio_or_zero(sc - sl, sl).alias("sales_growth"),
                        ratio_or_zero(pc - pl, pl).alias("profit_growth"))
            .withColumn("margin_growth", F.col("margin_current") - F.col("margin_last")))


def ytd_metric_table(m: Mart, frame: DataFrame | None = None) -> DataFrame:
    """The YTD numbers as three rows (Sales, Profit, Margin %) with one value
    column per year."""
    y = ytd_comparison(m, frame)
    return y.select(F.inline(F.array(
        F.struct(F.lit("Sales").alias("metric"), F.col("sales_current").alias("current_year"),
                 F.col("sales_last").alias("last_year")),
        F.struct(F.lit("Profit").alias("metric"), F.col("profit_current").alias("current_year"),
                 F.col("profit_last").alias("last_year")),
        F.struct(F.lit("Margin %").alias("metric"), F.col("margin_current").alias("current_year"),
                 F.col("margin_last").alias("last_year")),
    )))
