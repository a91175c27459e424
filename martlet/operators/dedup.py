"""De-duplication and insert-if-absent.

``keep_first`` keeps, per key, the row that comes first in a given input
order.  It is an aggregate (``min_by`` over a struct of the kept columns), so
it combines partially on the map side: a key held by a third of all rows
still ships one row per task.  A struct buffer makes it a sort-based
aggregate: each task sorts its own rows locally (spilling if needed) and only
the per-task winners cross the shuffle, which costs less than the
alternative of a hash ``min(row_id)`` followed by a join that reshuffles the
whole input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str | Column, order: str, cols: Sequence[str],
               key_name: str = "_key") -> DataFrame:
    """One row per distinct ``key`` value: ``key_name`` plus ``cols`` taken from
    the row with the smallest ``order`` (a unique input-order column)."""
    k = F.col(key) if isinstance(key, str) else key
    kept = list(dict.fromkeys([order, *cols]))
    first = (df.groupBy(k.alias(key_name))
             .agg(F.min_by(F.struct(*[F.col(c) for c in kept]), F.col(order)).alias("_first")))
    return first.select(key_name, *[F.col("_first")[c].alias(c) for c in kept])


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str,
                     order: str | None = None) -> DataFrame:
    """``INSERT ... ON CONFLICT (key) DO NOTHING``: the incoming batch is first
    reduced to its first row per key (in ``order``, else in the order of its columns), rows whose key already exists are
    dropped, the rest are appended.  NULL keys are never inserted."""
    batch = incoming.filter(F.col(key).isNotNull())
    if order is not None:
        cols = [c for c in incoming.columns if c != key]
        batch = keep_first(batch, key, order, cols, key_name=key).select(*incoming.columns)
    else:
        cols = [c for c in incoming.columns if c != key]
        batch = batch.groupBy(key).agg(F.min(F.struct(*cols)).alias("_first")).select(
            key, *[F.col("_first")[c].alias(c) for c in cols])
    new_rows = batch.join(existing.select(key), key, "left_anti")
    return existing.unionByName(new_rows.select(*existing.columns))
