"""Scalar column functions.  All are built-in Spark expressions (codegen'd, no
Python per row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Date layouts tried, in order, by the lenient date parser.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy",
                "yyyyMMdd"]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The characters counted as surrounding blanks (ASCII whitespace).
BLANKS = " \t\n\r\x0b\x0c"


def norm_text(col: Column | str) -> Column:
    """Null stays null, anything else becomes text without surrounding blanks."""
    return F.btrim(_c(col).cast("string"), F.lit(BLANKS))


def norm_enum(col: Column | str, domain: Sequence[str]) -> Column:
    """Map free text onto an enum domain: exact match after trimming, else a
    case-insensitive match (first domain value wins), else null."""
    s = norm_text(col)
    by_lower: dict[str, str] = {}
    for value in domain:
        by_lower.setdefault(value.lower(), value)
    lookup = F.create_map(*[F.lit(x) for kv in by_lower.items() for x in kv])
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when(s.isin(list(domain)), s)
            .otherwise(F.element_at(lookup, F.lower(s))))


def lenient_date(col: Column | str, dtype: T.DataType | None = None,
                 formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Parse to DATE; anything unparseable becomes null instead of failing."""
    c = _c(col)
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    s = norm_text(c)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in formats])


def to_number(col: Column | str) -> Column:
    """Numeric coercion where a failure gives null (never an error)."""
    return _c(col).try_cast("double")


def half_even_round(col: Column | str, places: int = 2) -> Column:
    """Round half to even on the binary value, as a dataframe ``.round(n)`` does:
    scale, round to the nearest integer (ties to even), unscale."""
    scale = float(10 ** places)
    return F.rint(_c(col) * F.lit(scale)) / F.lit(scale)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 or null."""
    return F.try_divide(num, den)


def ratio_or_zero(num: Column, den: Column, scale: float = 100.0) -> Column:
    """num / den * scale when den > 0, else 0."""
    return F.when(den > 0, num / den * F.lit(scale)).otherwise(F.lit(0.0))


def exact_avg_round(total: Column, count: Column, places: int) -> Column:
    """ROUND(total / count, places) with half-up rounding of the exact quotient.

    ``total`` is an exact value (integer or decimal sum); the quotient is taken
    in decimal with at least 6 fractional digits, so a value that is not an
    exact tie can never be rounded the wrong way.  Result is DOUBLE.
    """
    q = total.cast(T.DecimalType(28, 4)) / count.cast(T.DecimalType(19, 0))
    return F.round(q, places).cast("double")


def money_text(col: Column | str) -> Column:
    """Money as text: ``$1,234.50``; a negative amount prints ``$-1,234.50``."""
    return F.concat(F.lit("$"), F.format_number(_c(col).cast("double"), 2))
