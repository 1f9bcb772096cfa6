"""Column expressions: parsing, normalising, comparing and guarding."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def normalise_ticker(c: Column) -> Column:
    return F.translate(F.trim(c), ".", "-")


def normalise_cik(c: Column) -> Column:
    """Ten digits with leading zeros; a trailing .0 goes, and longer values stay as they are."""
    plain = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(F.length(plain) < 10, F.lpad(plain, 10, "0")).otherwise(plain)


def lenient_date(c: Column) -> Column:
    return F.try_to_timestamp(c.cast("string")).cast("date")


def lenient_double(c: Column) -> Column:
    """A number, or null where it can't be read or isn't finite."""
    return finite(c.try_cast("double"))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def valid_price(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (c > 0) & (c != float("inf")), F.lit(False))


def close_to(a: Column, b: Column, rtol: float, atol: float) -> Column:
    """Tolerant equality, relative to b."""
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def clearly_below(a: Column, b: Column, rtol: float, atol: float) -> Column:
    return F.coalesce((a < b) & ~close_to(a, b, rtol, atol), F.lit(False))


def clearly_above(a: Column, b: Column, rtol: float, atol: float) -> Column:
    return F.coalesce((a > b) & ~close_to(a, b, rtol, atol), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def month(c: Column) -> Column:
    return F.trunc(c, "MM")


def pair_id(a: Column, b: Column) -> Column:
    return F.concat_ws("__", a, b)


def batch_number(order: Column, size: int) -> Column:
    """Zero-based number of the fixed-size batch of a row."""
    return F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).cast("long")


def direction_label(z: Column, dependent: Column, independent: Column) -> Column:
    return F.when(z > 0, F.concat(F.lit("short_"), dependent, F.lit("_long_"), independent)).otherwise(F.concat(F.lit("long_"), dependent, F.lit("_short_"), independent))
