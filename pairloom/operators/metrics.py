"""Performance metrics, validation and report tables over trades and equity curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.scalars import ratio
from pairloom.params import Params
from pairloom.schemas import InputError


def daily_returns(equity: DataFrame, value: str = "net_equity", keys: tuple[str, ...] = ()) -> DataFrame:
    """equity with ret, the change from the previous date."""
    own = Window.partitionBy(*keys).orderBy("date")
    return equity.withColumn("ret", ratio(F.col(value), F.lag(value).over(own)) - 1)


def drawdown(equity: DataFrame, value: str = "net_equity", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, date, value, peak and drawdown from the running peak."""
    own = Window.partitionBy(*keys).orderBy("date")
    rows = equity.withColumn("peak", F.max(value).over(own))
    return rows.select(*keys, "date", value, "peak", (ratio(F.col(value), F.col("peak")) - 1).alias("drawdown"))


def yearly_returns(equity: DataFrame, value: str = "net_equity", keys: tuple[str, ...] = (), initial: float | None = None) -> DataFrame:
    """keys, year, annual_return: the product of daily changes; a first day counts from ``initial``, if given."""
    rows = daily_returns(equity, value, keys)
    if initial is not None:
        rows = rows.withColumn("ret", F.coalesce("ret", F.col(value) / initial - 1))
    return rows.where("ret is not null").groupBy(*keys, F.year("date").alias("year")).agg((F.product(1 + F.col("ret")) - 1).alias("annual_return"), F.count(F.lit(1)).alias("sessions"))


def performance(equity: DataFrame, trades: DataFrame, p: Params = Params()) -> DataFrame:
    """One row of metrics; what can't be computed is null."""
    days = float(p.trading_days)
    fall = drawdown(equity).agg(F.min("drawdown").alias("maximum_drawdown"))
    base = daily_returns(equity).agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("dev"),
        F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("down"), (F.max_by("net_equity", "date") / F.min_by("net_equity", "date") - 1).alias("total_return"),
        F.avg("gross_exposure").alias("average_gross_exposure"), F.max("gross_exposure").alias("maximum_gross_exposure"), F.avg("net_exposure").alias("average_net_exposure"),
        F.avg((F.col("active_pairs") > 0).cast("double")).alias("fraction_days_invested"), F.max_by("active_pairs", "date").alias("open_positions_at_end"),
    )
    won, lost = F.sum(F.when(F.col("net_pnl") > 0, F.col("net_pnl"))), F.sum(F.when(F.col("net_pnl") < 0, -F.col("net_pnl")))
    deals = trades.agg(
        F.count(F.lit(1)).alias("trade_count"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate"), ratio(F.coalesce(won, F.lit(0.0)), lost).alias("profit_factor"),
        F.median("holding_sessions").alias("median_holding_sessions"), F.coalesce(F.sum("execution_cost"), F.lit(0.0)).alias("total_execution_cost"), F.coalesce(F.sum("borrow_cost"), F.lit(0.0)).alias("total_borrow_cost"),
    )
    row = base.join(deals, F.lit(True)).join(fall, F.lit(True))  # single rows
    root = F.sqrt(F.lit(days))
    row = row.withColumn("annualized_return", F.when((F.col("n") > 0) & (F.col("total_return") > -1), F.pow(1 + F.col("total_return"), F.try_divide(F.lit(days), F.col("n"))) - 1))
    row = row.withColumns({
        "annualized_volatility": F.col("dev") * root, "sharpe_ratio": F.when(F.col("dev") > 0, F.col("mean") / F.col("dev") * root), "sortino_ratio": F.when(F.col("down") > 0, F.col("mean") / F.col("down") * root),
        "calmar_ratio": F.when(F.col("maximum_drawdown") < 0, F.col("annualized_return") / F.abs("maximum_drawdown")),
    })
    return row.drop("n", "mean", "dev", "down")


def validation(trades: DataFrame, equity: DataFrame, p: Params = Params()) -> DataFrame:
    """check, passed, detail: money adds up, orders follow signals, limits hold."""
    pnl = trades.agg(F.coalesce(F.sum("gross_pnl"), F.lit(0.0)).alias("g"), F.coalesce(F.sum("execution_cost"), F.lit(0.0)).alias("e"), F.coalesce(F.sum("borrow_cost"), F.lit(0.0)).alias("b"), F.coalesce(F.sum("net_pnl"), F.lit(0.0)).alias("n"))
    sums = pnl.select(F.lit("trade_pnl_reconciles").alias("check"), F.abs(F.col("g") - F.col("e") - F.col("b") - F.col("n")).alias("detail"), F.lit(1e-10).alias("limit"))
    legs = trades.select("entry_date", "exit_date", F.explode(F.array("ticker_a", "ticker_b")).alias("ticker"))
    own = Window.partitionBy("ticker").orderBy("entry_date", "exit_date").rowsBetween(Window.unboundedPreceding, -1)
    # A leg that is opened before all earlier ones of its ticker are closed: a running maximum instead of a self-join.
    clash = legs.withColumn("busy", F.max("exit_date").over(own)).agg(F.count_if(F.col("entry_date") < F.col("busy")).cast("double").alias("detail"))
    counts = trades.agg(
        F.count_if(F.col("entry_date") <= F.col("signal_date")).cast("double").alias("entry_after_signal"), F.count_if(F.col("exit_date") <= F.col("exit_signal_date")).cast("double").alias("exit_after_signal"),
        F.count_if(F.abs("entry_z_score") >= p.stop_z).cast("double").alias("entry_inside_stop"),
    )
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("detail"), F.lit(0.0).alias("limit")) for c in counts.columns])).alias("r")).select("r.*")
    most = equity.select(F.lit("maximum_pairs").alias("check"), F.col("active_pairs").cast("double").alias("detail")).groupBy("check").agg(F.max("detail").alias("detail")).withColumn("limit", F.lit(float(p.max_pairs)))
    out = sums.unionByName(rows).unionByName(clash.select(F.lit("no_concurrent_ticker").alias("check"), "detail", F.lit(0.0).alias("limit"))).unionByName(most)
    return out.select("check", (F.col("detail") <= F.col("limit")).alias("passed"), "detail")


def require_valid(checks: DataFrame) -> None:
    failed = checks.where("not passed").collect()  # six rows at most
    if failed:
        raise InputError("; ".join(f"{r['check']}: {r['detail']}" for r in failed))


def outcomes(trades: DataFrame, *keys: str) -> DataFrame:
    """Per group: trades, win rate, sums and means of results."""
    win = lambda c: F.avg((F.col(c) > 0).cast("double"))
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), win("net_pnl").alias("win_rate"), F.sum("net_pnl").alias("net_pnl"), F.avg("net_return").alias("mean_net_return"), F.median("holding_sessions").alias("median_holding_sessions"),
    )


def best_and_worst(trades: DataFrame, by: str, key: list[str], k: int = 10) -> DataFrame:
    """The k largest and k smallest, with side and place."""
    out = None
    for side, order in (("best", F.col(by).desc()), ("worst", F.col(by).asc())):
        place = F.row_number().over(Window.orderBy(order, *key)).cast("long")
        rows = trades.orderBy(order, *key).limit(k).withColumn("place", place).withColumn("side", F.lit(side))
        out = rows if out is None else out.unionByName(rows)
    return out


def histogram(rows: DataFrame, value: str, bins: int = 24) -> DataFrame:
    """bin (0-based), low, high, n over the range of the values; what the figures draw."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    wide = rows.where(F.col(value).isNotNull()).join(F.broadcast(ends), F.lit(True))  # one row
    place: Column = F.least(F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("long")
    out = wide.groupBy(place.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return out.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def equity_figure(equity: DataFrame) -> DataFrame:
    """date, net_equity and drawdown: the lines of the equity and drawdown figures."""
    return drawdown(equity).select("date", "net_equity", "drawdown")


def attribution(trades: DataFrame, *keys: str) -> DataFrame:
    """Per group: gross result, costs and what is left; the bars of the attribution figures."""
    return trades.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("gross_pnl", "execution_cost", "borrow_cost", "net_pnl")])


def scatter(trades: DataFrame, x: str) -> DataFrame:
    """pair_id, entry_date, x and net_return: the points of a scatter figure, one for each trade."""
    return trades.select("pair_id", "entry_date", x, "net_return")


def relative(equity: DataFrame, market: DataFrame, p: Params = Params(), keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, beta, correlation and alpha of daily returns against a market series (date, close)."""
    own = daily_returns(equity, keys=keys).select(*keys, "date", "ret")
    both = own.join(daily_returns(market, "close").select("date", F.col("ret").alias("m")), "date")
    return both.groupBy(*keys).agg(F.regr_slope("ret", "m").alias("beta"), F.corr("ret", "m").alias("correlation"), (F.regr_intercept("ret", "m") * p.trading_days).alias("annual_alpha"))


def turnover(orders: DataFrame, equity: DataFrame, p: Params = Params()) -> DataFrame:
    """Yearly traded value over mean equity."""
    traded = orders.groupBy(F.year("date").alias("year")).agg(F.sum(F.col("shares") * F.col("price")).alias("traded"))
    held = equity.groupBy(F.year("date").alias("year")).agg(F.avg("net_equity").alias("mean_equity"))
    return held.join(traded, "year", "left").select("year", F.coalesce(ratio(F.col("traded"), F.col("mean_equity")), F.lit(0.0)).alias("turnover"))


def tail_losses(trades: DataFrame, shares: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """share, limit (that percentile of net returns) and mean_beyond (the mean at or below it)."""
    limits = trades.agg(F.percentile("net_return", F.array(*[F.lit(s) for s in shares])).alias("q"))
    rows = limits.select(F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in shares]).alias("share"), F.col("q").alias("limit"))).alias("r")).select("r.*")
    rows = rows.toDF("share", "limit")
    return rows.join(trades.select("net_return"), F.col("net_return") <= F.col("limit"), "left").groupBy("share", "limit").agg(F.avg("net_return").alias("mean_beyond"))


def leg_contribution(trades: DataFrame) -> DataFrame:
    """side, gross_pnl of the long and the short legs."""
    legs = trades.select(F.explode(F.array(*[
        F.struct(F.col(f"entry_price_{x}").alias("a"), F.col(f"exit_price_{x}").alias("b"), w.alias("notional")) for x, w in (
            ("a", -F.signum("entry_z_score") * F.col("entry_gross") / (1 + F.abs("hedge_ratio"))),
            ("b", F.signum("entry_z_score") * F.col("entry_gross") * F.col("hedge_ratio") / (1 + F.abs("hedge_ratio"))),
        )
    ])).alias("l")).select("l.*")
    pnl = F.col("notional") * (F.col("b") / F.col("a") - 1)
    return legs.groupBy(F.when(F.col("notional") > 0, "long").otherwise("short").alias("side")).agg(F.sum(pnl).alias("gross_pnl"))
