"""Validation of bars: calendar, coverage, price rules, anomalies and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.scalars import clearly_above, clearly_below, ratio
from pairloom.params import Params

PRICES = ("open", "high", "low", "close")


def reference_calendar(bars: DataFrame, p: Params = Params()) -> DataFrame:
    """session, observed, active, coverage: sessions that enough of the then listed securities traded.

    The active count is a running sum of listings and delistings, not a join of sessions to spans.
    """
    spans = bars.groupBy("ticker").agg(F.min("session").alias("first"), F.max("session").alias("last"))
    changes = spans.select(F.col("first").alias("session"), F.lit(1).alias("change")).unionByName(spans.select(F.date_add("last", 1).alias("session"), F.lit(-1).alias("change")))
    changes = changes.groupBy("session").agg(F.sum("change").alias("change"))
    seen = bars.select("session", "ticker").distinct().groupBy("session").agg(F.count(F.lit(1)).alias("observed"))
    days = seen.join(changes, "session", "full").withColumn("active", F.sum("change").over(Window.orderBy("session")))
    days = days.where("observed is not null").withColumn("coverage", ratio(F.col("observed"), F.col("active")))
    return days.where(F.col("coverage") >= p.calendar_coverage).select("session", "observed", "active", "coverage")


def rule_masks(p: Params = Params()) -> dict[str, Column]:
    """Violations of the day's range: high below low, high below open or close, low above open or close."""
    high, low = F.col("high"), F.col("low")
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return {
        "high_below_low": clearly_below(high, low, p.rtol, p.atol),
        "high_below_open_close": clearly_below(high, top, p.rtol, p.atol),
        "low_above_open_close": clearly_above(low, bottom, p.rtol, p.atol),
    }


def ordinals(calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """session, n: how many calendar sessions lie at or before each of the dates (one column, session).

    One running count over the distinct dates and the calendar, a row a day of history whatever the number of securities.
    """
    days = calendar.select("session", F.lit(1).alias("on")).unionByName(dates.select("session").distinct().select("session", F.lit(0).alias("on")))
    days = days.groupBy("session").agg(F.max("on").alias("on"))
    return days.select("session", F.sum("on").over(Window.orderBy("session")).alias("n"), (F.col("on") == 1).alias("on"))


def missing_runs(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """ticker, start, end, length of every run of calendar sessions without a bar between a security's first and last.

    A run is a hole between neighbouring points on the calendar's ordinals: no grid of tickers and sessions is built.
    Calendar ordinals just outside the first and the last bar bound a span whose ends lie off the calendar.
    """
    rows = bars.select("ticker", "session").distinct()
    spans = rows.groupBy("ticker").agg(F.min("session").alias("first"), F.max("session").alias("last"))
    known = ordinals(calendar, rows)
    days = known.where("on").select("session", "n")
    on = rows.join(days, "session").select("ticker", "n")
    low = spans.join(known, F.col("session") == F.col("first")).select("ticker", (F.col("n") - F.col("on").cast("int")).alias("n"))
    high = spans.join(known, F.col("session") == F.col("last")).select("ticker", (F.col("n") + 1).alias("n"))
    ahead = Window.partitionBy("ticker").orderBy("n")
    holes = on.unionByName(low).unionByName(high).withColumn("next", F.lead("n").over(ahead)).where("next > n + 1")
    start, end = days.select(F.col("n").alias("a"), F.col("session").alias("start")), days.select(F.col("n").alias("b"), F.col("session").alias("end"))
    out = holes.select("ticker", (F.col("n") + 1).alias("a"), (F.col("next") - 1).alias("b")).join(start, "a").join(end, "b")
    return out.select("ticker", "start", "end", (F.col("b") - F.col("a") + 1).cast("long").alias("length"))


def returns(bars: DataFrame) -> DataFrame:
    """bars with ret: change from the security's own previous bar."""
    own = Window.partitionBy("ticker").orderBy("session")
    return bars.withColumn("ret", ratio(F.col("close"), F.lag("close").over(own)) - 1)


def security_quality(bars: DataFrame, calendar: DataFrame, p: Params = Params()) -> DataFrame:
    """One quality record per security: counts, coverage, recent medians, flags and status."""
    count = lambda c: F.count_if(c).cast("long")
    recent = Window.partitionBy("ticker").orderBy(F.col("session").desc())
    again = F.row_number().over(Window.partitionBy("ticker", "session").orderBy(F.lit(1))) > 1
    rows = returns(bars).withColumn("recent", F.row_number().over(recent) <= 252).withColumn("again", again)
    rows = rows.withColumns(rule_masks(p))
    base = rows.groupBy("ticker").agg(
        F.min("session").alias("first_date"), F.max("session").alias("last_date"), F.count(F.lit(1)).alias("observations"),
        count(F.col("again")).alias("duplicate_dates"),
        sum((count(F.col(c).isNull()) for c in (*PRICES, "volume")), F.lit(0)).cast("long").alias("missing_ohlcv_values"),
        *[count(F.col(c) <= 0).alias(f"nonpositive_{c}") for c in PRICES],
        count(F.col("volume") < 0).alias("negative_volume"), count(F.col("volume") == 0).alias("zero_volume"),
        *[count(F.col(c)).alias(c) for c in rule_masks(p)],
        count(F.abs("ret") > p.extreme_return).alias("extreme_return_count"), F.max(F.abs("ret")).alias("maximum_absolute_return"),
        F.median(F.when(F.col("recent"), F.col("close"))).alias("median_price_recent"),
        F.median(F.when(F.col("recent"), F.col("close") * F.col("volume"))).alias("median_dollar_volume_recent"),
    )
    present = bars.select("ticker", "session").distinct().join(calendar.select("session"), "session").groupBy("ticker").agg(F.count(F.lit(1)).alias("present"))
    ends = base.select("ticker", "first_date", "last_date")
    known = ordinals(calendar, bars)
    first = known.select(F.col("session").alias("first_date"), (F.col("n") - F.col("on").cast("int")).alias("before"))
    last = known.select(F.col("session").alias("last_date"), F.col("n").alias("upto"))
    expected = ends.join(first, "first_date").join(last, "last_date").select("ticker", (F.col("upto") - F.col("before")).cast("long").alias("expected_observations"))
    gaps = missing_runs(bars, calendar).groupBy("ticker").agg(F.max("length").alias("maximum_missing_run"))
    out = base.join(expected, "ticker", "left").join(present, "ticker", "left").join(gaps, "ticker", "left")
    out = out.withColumn("expected_observations", F.coalesce("expected_observations", F.lit(0)).cast("long"))
    out = out.withColumn("missing_observations", F.col("expected_observations") - F.coalesce("present", F.lit(0)))
    out = out.withColumn("missing_fraction", ratio(F.col("missing_observations"), F.col("expected_observations")))
    out = out.withColumn("maximum_missing_run", F.coalesce("maximum_missing_run", F.lit(0)).cast("long"))
    out = out.withColumn("sufficient_history", F.col("observations") >= p.min_history)
    broken = ["duplicate_dates", "missing_ohlcv_values", *[f"nonpositive_{c}" for c in PRICES], "negative_volume", *rule_masks(p)]
    error = F.greatest(*[F.col(c) for c in broken]) > 0
    warning = (F.col("extreme_return_count") > 0) | (F.col("zero_volume") > 0) | F.coalesce(F.col("missing_fraction") > p.max_missing_fraction, F.lit(False))
    return out.withColumn("status", F.when(error, "error").when(warning, "warning").otherwise("pass")).drop("present")


def quality_summary(quality: DataFrame, calendar: DataFrame) -> DataFrame:
    """metric, value (numbers) and day (dates) of the whole data set."""
    count = lambda c: F.count_if(c).cast("double")
    q = quality.agg(
        F.count(F.lit(1)).cast("double").alias("files_checked"), *[count(F.col("status") == s).alias(s) for s in ("pass", "warning", "error")],
        count(F.col("sufficient_history")).alias("securities_with_252_observations"), count(F.col("status") == "error").alias("securities_with_structural_errors"),
        count(F.col("extreme_return_count") > 0).alias("securities_with_extreme_returns"), count(F.col("zero_volume") > 0).alias("securities_with_zero_volume"),
        F.min("first_date").alias("earliest_security_date"), F.max("last_date").alias("latest_security_date"),
    )
    c = calendar.agg(F.count(F.lit(1)).cast("double").alias("reference_trading_days"), F.min("session").alias("reference_start"), F.max("session").alias("reference_end"))
    row = q.join(c, F.lit(True))  # two single rows
    numbers = [n for n, t in row.dtypes if t == "double"]
    dates = [n for n, t in row.dtypes if t == "date"]
    values = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.lit(None).cast("date").alias("day")) for n in numbers], *[F.struct(F.lit(n).alias("metric"), F.lit(None).cast("double").alias("value"), F.col(n).alias("day")) for n in dates])).alias("r"))
    return values.select("r.*")


def extreme_returns(bars: DataFrame, p: Params = Params()) -> DataFrame:
    """ticker, session, previous_session, previous_close, close, ret of moves beyond the limit."""
    own = Window.partitionBy("ticker").orderBy("session")
    rows = bars.withColumns({"previous_session": F.lag("session").over(own), "previous_close": F.lag("close").over(own)})
    rows = rows.withColumn("ret", ratio(F.col("close"), F.col("previous_close")) - 1)
    return rows.where(F.abs("ret") > p.extreme_return).select("ticker", "session", "previous_session", "previous_close", "close", "ret")


def ohlc_violations(bars: DataFrame, p: Params = Params()) -> DataFrame:
    """A row per violated rule with the difference between the two sides."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    gap = {"high_below_low": F.col("low") - F.col("high"), "high_below_open_close": top - F.col("high"), "low_above_open_close": F.col("low") - bottom}
    found = [F.when(mask, F.struct(F.lit(name).alias("rule"), gap[name].alias("difference"))) for name, mask in rule_masks(p).items()]
    rows = bars.withColumn("r", F.explode(F.array_compact(F.array(*found))))
    return rows.select("ticker", "session", "r.rule", "r.difference")


def zero_volume_runs(bars: DataFrame) -> DataFrame:
    """ticker, start_date, end_date, length, start_close, end_close, unique_closes; a missing volume counts as zero."""
    own = Window.partitionBy("ticker").orderBy("session")
    rows = bars.withColumn("zero", F.coalesce(F.col("volume"), F.lit(0.0)) == 0)
    rows = rows.withColumn("run", F.sum(F.when(F.col("zero"), 0).otherwise(1)).over(own)).where("zero")
    return rows.groupBy("ticker", "run").agg(
        F.min("session").alias("start_date"), F.max("session").alias("end_date"), F.count(F.lit(1)).alias("length"),
        F.min_by("close", "session").alias("start_close"), F.max_by("close", "session").alias("end_close"), F.countDistinct("close").alias("unique_closes"),
    ).drop("run")


def anomaly_events(bars: DataFrame, quality: DataFrame, p: Params = Params()) -> DataFrame:
    """ticker, session, anomaly_type, value: extreme returns and broken rules of the securities that validation flagged.

    Only bars of flagged securities are looked at; those that pass take no part.
    """
    flagged = bars.join(quality.where("status <> 'pass'").select("ticker"), "ticker", "left_semi")
    moves = extreme_returns(flagged, p).select("ticker", "session", F.lit("extreme_return").alias("anomaly_type"), F.col("ret").alias("value"))
    return moves.unionByName(ohlc_violations(flagged, p).select("ticker", "session", F.col("rule").alias("anomaly_type"), F.col("difference").alias("value")))


def download_log(bars: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """ticker, status, first_date, last_date, observations, missing_fraction (the mean of the columns' missing shares)."""
    missing = sum((F.avg(F.col(c).isNull().cast("double")) for c in (*PRICES, "volume")), F.lit(0.0)) / 5
    log = bars.groupBy("ticker").agg(F.min("session").alias("first_date"), F.max("session").alias("last_date"), F.count(F.lit(1)).alias("observations"), missing.alias("missing_fraction"))
    log = log.withColumn("status", F.lit("success"))
    if expected is not None:
        log = expected.select("ticker").distinct().join(log, "ticker", "left").withColumn("status", F.coalesce("status", F.lit("failed")))
        log = log.withColumn("observations", F.coalesce("observations", F.lit(0)))
    return log.select("ticker", "status", "first_date", "last_date", "observations", "missing_fraction")


def latest_log(log: DataFrame) -> DataFrame:
    """One row per ticker, successes before failures."""
    order = Window.partitionBy("ticker").orderBy(F.when(F.col("status") == "success", 0).otherwise(1), F.col("last_date").desc_nulls_last(), F.col("observations").desc())
    return log.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
