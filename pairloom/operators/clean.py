"""Cleaning of bars and documented repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.scalars import finite
from pairloom.schemas import require_columns, require_none

PRICES = ("open", "high", "low", "close")
ACTIONS = ("truncate_before", "repair_ohlc")


def clean(bars: DataFrame, order: str | None = None) -> DataFrame:
    """Prices at or below zero and numbers that aren't finite become null, rows without a price go, and of a session's
    rows the last by ``order`` (a column that says how rows came in) stays."""
    require_columns(bars, "ticker", "session", *PRICES, "volume")
    rows = bars.withColumns({c: finite(F.col(c)) for c in (*PRICES, "volume")}).where("close is not null")
    rows = rows.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in PRICES}).dropna(subset=list(PRICES))
    keys = [F.col(order).desc()] if order else []
    last = Window.partitionBy("ticker", "session").orderBy(*keys, *[F.col(c).desc() for c in (*PRICES, "volume")])
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def apply_overrides(bars: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patched bars and the log (ticker, action, session, field, old_value, new_value, rows_affected).

    truncate_before drops a security's rows before start_date; repair_ohlc sets one session's High to the row's largest
    price or its Low to the smallest, in file order. Unknown actions and missing dates raise.
    """
    require_none(overrides.where(~F.col("action").isin(*ACTIONS)), "unknown override action")
    require_none(overrides.where("start_date is null"), "override without a date")
    repairs = overrides.where("action = 'repair_ohlc'")
    require_none(repairs.where(~F.lower("field").isin("high", "low")), "override of an unknown field")
    require_none(repairs.join(bars, (repairs["ticker"] == bars["ticker"]) & (repairs["start_date"] == bars["session"]), "left_anti"), "override of a session without a bar")
    cuts = overrides.where("action = 'truncate_before'").groupBy("ticker").agg(F.max("start_date").alias("_cut"))
    # At most two repairs of a session matter: High and Low do not depend on each other beyond the row's own prices.
    fixes = repairs.groupBy(F.col("ticker"), F.col("start_date").alias("session")).agg(
        F.bool_or(F.lower("field") == "high").alias("_high"), F.bool_or(F.lower("field") == "low").alias("_low")
    )
    joined = bars.join(cuts, "ticker", "left").join(fixes, ["ticker", "session"], "left")
    top, bottom = F.greatest(*PRICES), F.least(*PRICES)
    marked = joined.withColumns({
        "_dropped": F.coalesce(F.col("session") < F.col("_cut"), F.lit(False)),
        "_new_high": F.when(F.coalesce("_high", F.lit(False)), top).otherwise(F.col("high")),
        "_new_low": F.when(F.coalesce("_low", F.lit(False)), bottom).otherwise(F.col("low")),
    })
    patched = marked.where(~F.col("_dropped")).withColumns({"high": F.col("_new_high"), "low": F.col("_new_low")}).select(bars.columns)
    dropped = marked.where("_dropped").groupBy("ticker").agg(F.count(F.lit(1)).alias("rows_affected"), F.max("_cut").alias("session"))
    none = F.lit(None).cast("double")
    log = dropped.select("ticker", F.lit("truncate_before").alias("action"), "session", F.lit(None).cast("string").alias("field"), none.alias("old_value"), none.alias("new_value"), "rows_affected")
    for field in ("high", "low"):
        log = log.unionByName(marked.where(F.col(f"_{field}")).select("ticker", F.lit("repair_ohlc").alias("action"), "session", F.lit(field).alias("field"), F.col(field).alias("old_value"), F.col(f"_new_{field}").alias("new_value"), F.lit(1).cast("long").alias("rows_affected")))
    return patched, log


def validate_cleaned(bars: DataFrame) -> DataFrame:
    """bars, after raising if a security has no rows, repeats a session or has a price at or below zero."""
    require_columns(bars, "ticker", "session", *PRICES, "volume")
    require_none(bars.groupBy("ticker", "session").count().where("count > 1"), "duplicate session")
    bad = F.lit(False)
    for c in PRICES:
        bad = bad | (F.col(c) <= 0)
    require_none(bars.where(bad), "price at or below zero")
    if bars.isEmpty():
        raise ValueError("no bars")
    return bars


def compare_universe(expected: DataFrame, found: DataFrame) -> DataFrame:
    """ticker, side: expected without bars (missing), or bars that nobody expects (unexpected)."""
    a, b = expected.select("ticker").distinct(), found.select("ticker").distinct()
    return a.join(b, "ticker", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "ticker", "left_anti").withColumn("side", F.lit("unexpected")))
