"""Table-constraint checks.

The database behind the reference enforces keys, ranges and domains on write;
parquet tables do not, so each constraint becomes a check that counts the
rows breaking it.  As in SQL, a CHECK passes on NULL and a NULL foreign key
references nothing.  Every check is a single aggregate pass (per table)
whose result has one row per table/column checked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.schema import (FOREIGN_KEYS, MAX_LENGTHS, NOT_NULL, PRIMARY_KEYS, REGIONS, SEGMENTS,
                            SHIP_MODES, TABLES, UNIQUE_COLUMNS)
from martlet.sources.mart import Mart


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _key_counts(df: DataFrame, col: str) -> DataFrame:
    """One row per distinct value with its multiplicity (partial aggregation
    first, so a value held by a third of the rows costs one row per task)."""
    return df.groupBy(F.col(col).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))


def check_primary_keys(m: Mart) -> DataFrame:
    """Per table: NULL keys and key values that occur more than once."""
    rows = []
    for table, key in PRIMARY_KEYS.items():
        kc = _key_counts(m.table(table), key)
        rows.append(kc.agg(
            F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col("_n"))), F.lit(0))
            .cast("long").alias("null_keys"),
            F.count_if(F.col("_k").isNotNull() & (F.col("_n") > 1)).alias("duplicate_keys"))
            .select(F.lit(table).alias("table_name"), F.lit(key).alias("column_name"),
                    "null_keys", "duplicate_keys"))
    return _union(rows)


def check_unique(m: Mart) -> DataFrame:
    """Per UNIQUE column: non-null values that occur more than once."""
    rows = []
    for table, col in UNIQUE_COLUMNS:
        kc = _key_counts(m.table(table), col)
        rows.append(kc.agg(F.count_if(F.col("_k").isNotNull() & (F.col("_n") > 1))
                           .alias("duplicate_values"))
                    .select(F.lit(table).alias("table_name"), F.lit(col).alias("column_name"),
                            "duplicate_values"))
    return _union(rows)


def check_foreign_keys(m: Mart) -> DataFrame:
    """Per foreign key: child rows whose non-null key has no parent row.

    Child keys are reduced to (value, count) before the anti join, so the join
    sees each value once however skewed the child column is."""
    rows = []
    for child, col, parent, pcol in FOREIGN_KEYS:
        kc = _key_counts(m.table(child).filter(F.col(col).isNotNull()), col)
        parents = m.table(parent).select(F.col(pcol).alias("_k")).filter(F.col("_k").isNotNull())
        orphans = kc.join(parents, "_k", "left_anti")
        rows.append(orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("violations"))
                    .select(F.lit(child).alias("table_name"), F.lit(col).alias("column_name"),
                            F.lit(parent).alias("parent_table"), "violations"))
    return _union(rows)


# A rule of single rows: (what kind, constraint or column, condition of a row that breaks it).
Rule = tuple[str, str, Column]


def _not_null_rules() -> dict[str, list[Rule]]:
    return {t: [("not null", c, F.col(c).isNull()) for c in cols] for t, cols in NOT_NULL.items()}


def _range_rules() -> dict[str, list[Rule]]:
    return {"sellers": [("range", "chk_seller_rating", ~F.col("seller_rating").between(0, 5))],
            "order_details": [("range", "chk_quantity", ~(F.col("quantity") > 0)),
                              ("range", "chk_discount", ~F.col("discount").between(0, 1)),
                              ("range", "chk_sales", ~(F.col("sales") >= 0))]}


def _ship_date_rules() -> dict[str, list[Rule]]:
    return {"orders": [("range", "chk_ship_date", ~(F.col("ship_date") >= F.col("order_date")))]}


DEFAULT_DOMAINS = {
    ("sellers", "seller_region"): REGIONS,
    ("customers", "segment"): SEGMENTS,
    ("customers", "region"): REGIONS,
    ("orders", "ship_mode"): SHIP_MODES,
}
Domains = Mapping[tuple[str, str], Sequence[str]]


def _domain_rules(domains: Domains | None) -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {}
    for (table, col), values in (domains or DEFAULT_DOMAINS).items():
        c = F.col(col)
        out.setdefault(table, []).append(("domain", col, c.isNotNull() & ~c.isin(list(values))))
    return out


def _length_rules() -> dict[str, list[Rule]]:
    return {t: [("length", c, F.length(F.col(c).cast("string")) > w) for c, w in widths.items()]
            for t, widths in MAX_LENGTHS.items()}


def _broken_rows(m: Mart, *rule_sets: Mapping[str, list[Rule]]) -> DataFrame:
    """(table_name, rule, subject, violations): one aggregate a table, whatever the rules."""
    rows = []
    for table in TABLES:
        rules = [r for rules in rule_sets for r in rules.get(table, [])]
        if rules:
            counts = m.table(table).agg(*[F.count_if(broken).alias(f"n{i}")
                                          for i, (_, _, broken) in enumerate(rules)])
            rows.append(counts.select(F.inline(F.array(*[
                F.struct(F.lit(table).alias("table_name"), F.lit(kind).alias("rule"),
                         F.lit(subject).alias("subject"), F.col(f"n{i}").alias("violations"))
                for i, (kind, subject, _) in enumerate(rules)]))))
    return _union(rows)


def check_rows(m: Mart, domains: Domains | None = None) -> DataFrame:
    """Every rule that single rows keep or break (not null, ranges, ship date, domains, text
    widths), each table read once for all of them."""
    return _broken_rows(m, _not_null_rules(), _range_rules(), _ship_date_rules(),
                        _domain_rules(domains), _length_rules())


def check_not_null(m: Mart) -> DataFrame:
    """Per NOT NULL column: rows holding NULL (one pass per table)."""
    return _broken_rows(m, _not_null_rules()).select(
        "table_name", F.col("subject").alias("column_name"), F.col("violations").alias("null_count"))


def _by_constraint(rows: DataFrame) -> DataFrame:
    return rows.select("table_name", F.col("subject").alias("constraint_name"), "violations")


def check_ranges(m: Mart) -> DataFrame:
    """Value ranges: rating within 0..5, discount within 0..1, quantity above 0,
    sales not negative."""
    return _by_constraint(_broken_rows(m, _range_rules()))


def check_ship_date(m: Mart) -> DataFrame:
    """Orders shipped before they were placed."""
    return _by_constraint(_broken_rows(m, _ship_date_rules()))


def check_enum_domains(m: Mart, domains: Domains | None = None) -> DataFrame:
    """Per enum column: non-null values outside the column's domain."""
    return _broken_rows(m, _domain_rules(domains)).select(
        "table_name", F.col("subject").alias("column_name"), "violations")


def check_lengths(m: Mart) -> DataFrame:
    """Per text column with a declared width: values longer than it."""
    widths = F.create_map(*[F.lit(x) for t, cols in MAX_LENGTHS.items() for c, w in cols.items()
                            for x in (f"{t}.{c}", w)])
    return _broken_rows(m, _length_rules()).select(
        "table_name", F.col("subject").alias("column_name"),
        F.element_at(widths, F.concat_ws(".", "table_name", "subject")).alias("max_length"), "violations")
