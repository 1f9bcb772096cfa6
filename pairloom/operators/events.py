"""Frozen-parameter z-scores and the out-of-sample event study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.scalars import direction_label, month, valid_price
from pairloom.operators.candidates import DECIMALS
from pairloom.operators.panel import sessions
from pairloom.params import Params

PAIR = ["selection_date", "pair_id"]


def evaluation_dates(pairs: DataFrame, panel: DataFrame) -> DataFrame:
    """selection_date, session, sidx: sessions of the month after the selection; the panel's last month is no such month."""
    days = sessions(panel).withColumn("m", month(F.col("session")))
    last = days.select(F.max("m").alias("x")).scalar()
    picks = pairs.select("selection_date").distinct().withColumn("m", F.add_months(month(F.col("selection_date")), 1).cast("date"))
    return picks.join(days.where(F.col("m") < last), "m").select("selection_date", "session", "sidx")


def signal_dates(pairs: DataFrame, panel: DataFrame) -> DataFrame:
    """evaluation_dates and the selection dates themselves, for selections that have evaluation dates."""
    days = evaluation_dates(pairs, panel)
    own = days.select("selection_date").distinct().join(sessions(panel), F.col("selection_date") == F.col("session")).select("selection_date", "session", "sidx")
    return days.unionByName(own)


def z_paths(pairs: DataFrame, panel: DataFrame, dates: DataFrame) -> DataFrame:
    """A row per pair snapshot and date: z (null without valid prices or a positive deviation), both_eligible, prices.

    ``dates`` has selection_date, session, sidx; the joins to the panel are equi-joins on (sidx, ticker).
    """
    cols = [*PAIR, "dependent_ticker", "independent_ticker", "alpha", "hedge_ratio", "spread_mean", "spread_std"]
    rows = pairs.select(cols).join(dates, "selection_date")
    for side, ticker in (("d", "dependent_ticker"), ("i", "independent_ticker")):
        rows = rows.join(panel.select("sidx", F.col("ticker").alias(ticker), *[F.col(c).alias(f"{side}_{c}") for c in ("open", "close", "eligible")]), ["sidx", ticker], "left")
    ok = valid_price(F.col("d_close")) & valid_price(F.col("i_close")) & (F.col("spread_std") > 0)
    z = (F.ln("d_close") - F.col("alpha") - F.col("hedge_ratio") * F.ln("i_close") - F.col("spread_mean")) / F.col("spread_std")
    both = F.coalesce(F.col("d_eligible") & F.col("i_eligible"), F.lit(False))
    return rows.withColumn("z", F.when(ok, F.round(z, DECIMALS))).withColumn("both_eligible", both)


def _first(when: Column, value: str) -> Column:
    return F.min(F.when(when, F.col(value)))


def spread_events(pairs: DataFrame, panel: DataFrame, p: Params = Params()) -> DataFrame:
    """One record per pair-month with evaluation dates: the first divergence, what followed, and how it ended.

    Without an actionable signal, or without a priced session after it, entry_triggered is false.
    """
    path = z_paths(pairs, panel, signal_dates(pairs, panel))
    every = Window.partitionBy(*PAIR)
    path = path.withColumn("last", F.max("sidx").over(every))
    actionable = (F.abs("z") >= p.event_entry_z) & F.col("both_eligible") & (F.col("sidx") < F.col("last"))
    path = path.withColumn("signal", F.min(F.when(actionable, F.struct("sidx", "session", "z"))).over(every))
    ahead = F.col("sidx") > F.col("signal.sidx")
    path = path.withColumn("k", F.when(ahead & F.col("z").isNotNull(), F.sum((ahead & F.col("z").isNotNull()).cast("long")).over(every.orderBy("sidx"))))
    sign = F.signum("signal.z")
    forward = F.col("k").isNotNull()
    out = path.groupBy(*PAIR, "signal").agg(
        F.count_if(F.col("session") > F.col("selection_date")).alias("evaluation_sessions"), F.max("k").alias("forward"),
        F.min(F.when(ahead, F.struct("sidx", "session"))).alias("entry"), F.max_by("z", "sidx").alias("raw_end"), F.max(F.when(forward, F.struct("sidx", "z"))).alias("end"),
        _first(forward & (F.abs("z") <= p.event_partial_z), "k").alias("to_1"), _first(forward & (F.abs("z") <= p.event_exit_z), "k").alias("to_05"),
        _first(forward & (sign * F.col("z") <= 0), "k").alias("to_mean"),
        F.max(F.when(forward, -sign * (F.col("z") - F.col("signal.z")))).alias("best"), F.min(F.when(forward, -sign * (F.col("z") - F.col("signal.z")))).alias("worst"),
    )
    entered = F.col("forward").isNotNull()
    out = out.select(
        *PAIR, F.add_months(month(F.col("selection_date")), 1).cast("date").alias("evaluation_month"), "evaluation_sessions", entered.alias("entry_triggered"),
        F.col("signal.session").alias("signal_date"), F.when(entered, F.col("entry.session")).alias("entry_evaluation_date"), F.col("signal.z").alias("entry_z_score"),
        F.coalesce("forward", F.lit(0)).alias("forward_sessions"), F.col("to_1").isNotNull().alias("touched_abs_z_1"), F.col("to_05").isNotNull().alias("touched_abs_z_0_5"),
        F.col("to_mean").isNotNull().alias("crossed_mean"), F.col("to_1").alias("sessions_to_abs_z_1"), F.col("to_05").alias("sessions_to_abs_z_0_5"), F.col("to_mean").alias("sessions_to_mean_crossing"),
        F.col("best").alias("maximum_favourable_excursion_z"), F.col("worst").alias("maximum_adverse_excursion_z"),
        F.when(entered, F.col("end.z")).when(F.col("signal").isNull(), F.col("raw_end")).alias("end_z_score"),
    )
    about = ["ticker_1", "ticker_2", "dependent_ticker", "independent_ticker", "sector", "same_sub_industry", "return_correlation", "hedge_ratio"]
    out = out.join(pairs.select(*PAIR, *about, F.col("baseline_fdr_pvalue").alias("fdr_pvalue"), F.col("half_life").alias("formation_half_life")), PAIR)
    return out.withColumn("entry_direction", F.when(F.col("entry_triggered"), direction_label(F.col("entry_z_score"), F.col("dependent_ticker"), F.col("independent_ticker"))).otherwise(""))


def _outcomes() -> list[Column]:
    entered = F.col("entry_triggered")
    rate = lambda c: F.avg(F.when(entered, F.col(c).cast("double")))
    median = lambda c: F.median(F.when(entered, F.col(c)))
    return [
        F.count_if(entered).alias("entry_events"), F.avg(entered.cast("double")).alias("entry_frequency"), rate("touched_abs_z_1").alias("touched_abs_z_1_rate"),
        rate("touched_abs_z_0_5").alias("touched_abs_z_0_5_rate"), rate("crossed_mean").alias("mean_crossing_rate"), median("sessions_to_abs_z_0_5").alias("median_sessions_to_abs_z_0_5"),
        median("maximum_favourable_excursion_z").alias("median_favourable_excursion_z"), median("maximum_adverse_excursion_z").alias("median_adverse_excursion_z"),
    ]


def event_summary(events: DataFrame) -> DataFrame:
    """metric, value."""
    entered = F.col("entry_triggered")
    row = events.agg(
        F.count(F.lit(1)).alias("pair_months_evaluated"), *_outcomes(), F.median(F.when(entered, F.abs("entry_z_score"))).alias("median_entry_abs_z"),
        F.median(F.when(entered, F.col("sessions_to_abs_z_1"))).alias("median_sessions_to_abs_z_1"), F.median(F.when(entered, F.col("sessions_to_mean_crossing"))).alias("median_sessions_to_mean_crossing"),
    )
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])).alias("r")).select("r.*")


def event_by_sector(events: DataFrame) -> DataFrame:
    return events.groupBy("sector").agg(F.count(F.lit(1)).alias("pair_months"), *_outcomes())


