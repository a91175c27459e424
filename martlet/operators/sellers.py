"""Seller enrichment: add the seller column when missing, upsert sellers, and
assign one seller to every order line.

Assignment rule (a deterministic stand-in for the reference's random pick):
a line whose customer has region r gets, among the sellers of region r
ordered by ``seller_id``, the one at index ``pmod(line id, n_r)``; when region
r has no sellers it picks the same way among all sellers; with no sellers at
all the line keeps its seller.  A NULL customer region is a region of its own
(it matches sellers whose region is NULL), as in a dictionary lookup.

Plan: sellers get an index within their region and an overall index from the
distributed ranking (no per-region window, so one region holding a third of
the sellers is still split across tasks); customers meet the size of their region,
so lines get both through the join with their order and then meet the small seller
index through a second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.operators.dedup import insert_if_absent
from martlet.operators.ranking import global_position
from martlet.sources.mart import Mart


def add_missing_column(df: DataFrame, name: str,
                       dtype: T.DataType | str = T.StringType()) -> DataFrame:
    """The table with column ``name`` present (all NULL when it was absent)."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(None).cast(dtype))


def upsert_sellers(existing: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Insert sellers whose id is not there yet; existing rows win."""
    return insert_if_absent(existing, incoming, "seller_id", order)


def seller_index(sellers: DataFrame) -> tuple[DataFrame, int]:
    """Lookup rows (scope, region, idx, seller_id): scope 0 indexes sellers
    within their region, scope 1 over all sellers.  Returns the rows and the
    number of sellers."""
    s = sellers.select("seller_id", "seller_region").filter(F.col("seller_id").isNotNull())
    keyed = s.withColumns({"_rnull": F.col("seller_region").isNull(),
                           "_rkey": F.coalesce("seller_region", F.lit(""))})
    in_region, n = global_position(keyed, ["_rnull", "_rkey", "seller_id"], "_pos")
    starts = in_region.groupBy("_rnull", "_rkey").agg(F.min("_pos").alias("_start"))
    by_region = (in_region.join(starts, ["_rnull", "_rkey"])
                 .select(F.lit(0).alias("_scope"), F.col("seller_region").alias("_region"),
                         (F.col("_pos") - F.col("_start")).alias("_idx"), "seller_id"))
    overall, _ = global_position(s, ["seller_id"], "_idx", n=n)
    overall = overall.select(F.lit(1).alias("_scope"), F.lit(None).cast("string").alias("_region"),
                             "_idx", "seller_id")
    return by_region.unionByName(overall), n


def assign_sellers(m: Mart) -> DataFrame:
    """``order_details`` with ``seller_id`` re-assigned by the rule above."""
    details = add_missing_column(m.order_details, "seller_id", m.sellers.schema["seller_id"].dataType)
    lookup, n_all = seller_index(m.sellers)
    if n_all == 0:
        return details
    sizes = (m.sellers.filter(F.col("seller_id").isNotNull())
             .groupBy(F.col("seller_region").alias("_r")).agg(F.count(F.lit(1)).alias("_n_r")))
    customers = (m.customers.select("customer_id", "region")
                 .join(sizes, F.col("region").eqNullSafe(F.col("_r")), "left"))
    region_of_order = (m.orders.select("order_id", "customer_id")
                       .join(customers, "customer_id")
                       .select("order_id", "region", "_n_r", F.lit(True).alias("_has_region")))
    lines = details.join(region_of_order, "order_id", "left")
    use_region = F.col("_n_r").isNotNull()
    keyed = lines.withColumns({
        "_scope": F.when(use_region, F.lit(0)).otherwise(F.lit(1)),
        "_region": F.when(use_region, F.col("region")),
        "_idx": F.pmod(F.col("id"), F.when(use_region, F.col("_n_r")).otherwise(F.lit(n_all)))
                 .cast("long"),
    })
    picked = keyed.join(
        lookup.withColumnRenamed("seller_id", "_picked"),
        (keyed["_scope"] == lookup["_scope"]) & keyed["_region"].eqNullSafe(lookup["_region"])
        & (keyed["_idx"] == lookup["_idx"]), "left")
    new_seller = F.when(F.col("_has_region"), F.col("_picked")).otherwise(F.col("seller_id"))
    return picked.select(*[new_seller.alias(c) if c == "seller_id" else F.col(c)
                           for c in details.columns])


def update_column(target: DataFrame, updates: DataFrame, key: str, col: str) -> DataFrame:
    """``UPDATE target SET col = u.col FROM updates u WHERE key matches``: rows
    without an update keep their value."""
    u = updates.select(key, F.col(col).alias("_new"))
    joined = target.join(u, key, "left")
    return joined.select(*[F.coalesce("_new", F.col(c)).alias(c) if c == col else F.col(c)
                           for c in target.columns])
