"""Table schemas and input checks."""

from __future__ import annotations

from pyspark.sql import DataFrame

BARS = "ticker string, session date, open double, high double, low double, close double, volume double"
SECURITIES = "ticker string, company string, sector string, sub_industry string, cik string, date_added date, is_current_member boolean"
OVERRIDES = "ticker string, action string, start_date date, end_date date, field string, reason string, source string, position int"


class InputError(ValueError):
    """An input table misses columns or breaks a rule."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise InputError(f"columns missing: {', '.join(missing)}")
    return df


def require_none(bad: DataFrame, what: str) -> None:
    """Raise if the violation query finds a row; only one row is fetched."""
    found = bad.take(1)
    if found:
        raise InputError(f"{what}: {found[0].asDict()}")
