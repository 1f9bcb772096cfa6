"""The calendar-dense long panel, eligibility and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.scalars import month, ratio, valid_price
from pairloom.params import Params


def dense_panel(bars: DataFrame) -> DataFrame:
    """session, sidx (dense ordinal from 0), ticker, open, close, volume: a row for every session and security.

    Sessions and securities are dimensions, so their product is the panel itself; it is joined to the bars by shuffle.
    """
    sessions = bars.select("session").distinct().withColumn("sidx", (F.row_number().over(Window.orderBy("session")) - 1).cast("int"))
    tickers = bars.select("ticker").distinct()
    return sessions.crossJoin(tickers).join(bars.select("session", "ticker", "open", "close", "volume"), ["session", "ticker"], "left").select("session", "sidx", "ticker", "open", "close", "volume")


def eligibility(panel: DataFrame, p: Params = Params()) -> DataFrame:
    """panel with history, positive_days, median_dollar_volume and eligible; one window sort per security."""
    own = Window.partitionBy("ticker").orderBy("sidx")
    recent = own.rowsBetween(1 - p.liquidity_window, 0)
    traded = F.coalesce(F.col("volume") > 0, F.lit(False))
    dollars = F.when(traded & valid_price(F.col("close")), F.col("close") * F.col("volume"))
    rows = panel.withColumn("history", F.sum(valid_price(F.col("close")).cast("long")).over(own))
    rows = rows.withColumn("_d", dollars).withColumn("_n", F.row_number().over(own))
    rows = rows.withColumn("positive_days", F.when(F.col("_n") >= p.min_liquidity_days, F.sum(traded.cast("long")).over(recent)))
    rows = rows.withColumn("median_dollar_volume", F.when(F.count("_d").over(recent) >= p.min_liquidity_days, F.percentile("_d", 0.5).over(recent)))
    ok = (
        valid_price(F.col("close")) & valid_price(F.col("open")) & F.col("volume").isNotNull() & (F.col("history") >= p.min_history) & (F.col("close") >= p.min_price)
        & traded & (F.col("positive_days") >= p.min_liquidity_days) & (F.col("median_dollar_volume") >= p.min_median_dollar_volume)
    )
    return rows.withColumn("eligible", F.coalesce(ok, F.lit(False))).drop("_d", "_n")


def universe_coverage(panel: DataFrame) -> DataFrame:
    """Per session: available, eligible and ineligible securities and the eligible fraction."""
    rows = panel.groupBy("session").agg(F.count_if(valid_price(F.col("close"))).alias("available_securities"), F.count_if("eligible").alias("eligible_securities"))
    return rows.withColumn("ineligible_securities", F.col("available_securities") - F.col("eligible_securities")).withColumn("eligible_fraction", ratio(F.col("eligible_securities"), F.col("available_securities")))


def sessions(panel: DataFrame) -> DataFrame:
    return panel.select("session", "sidx").distinct()


def month_ends(panel: DataFrame, p: Params = Params()) -> DataFrame:
    """selection_date, sidx: the last session of each month; the last month goes unless it is said to be complete."""
    ends = sessions(panel).groupBy(month(F.col("session")).alias("m")).agg(F.max(F.struct("session", "sidx")).alias("s"))
    if not p.keep_last_month:
        ends = ends.where(F.col("m") < ends.select(F.max("m").alias("x")).select("x").scalar())
    return ends.select(F.col("s.session").alias("selection_date"), F.col("s.sidx").alias("sidx"))
