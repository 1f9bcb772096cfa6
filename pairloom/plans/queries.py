"""The registered queries over the fixture panel, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import sql
from pairloom.functions.scalars import batch_number
from pairloom.functions.stats import mackinnon_p
from pairloom.operators import backtest, candidates, clean, cointegration, events, metrics, panel, quality
from pairloom.params import Params
from pairloom.plans.oracle import NUDGE, ORACLE
from pairloom.plans.research import Research
from pairloom.sources import files, fixture
from pairloom.sources.scratch import keep, scratch_folder

#: The fixture's volumes are small and its moves smaller than those of single shares.
P = Params(min_median_dollar_volume=30_000.0, extreme_return=0.05)
PLACES = 6


_LAST: dict[tuple[str, str, Params], Research] = {}


def research(spark: SparkSession, sf_dir: str, p: Params = P) -> Research:
    """The stages over a folder; the last folder's are kept, so that queries share the tables that many of them read."""
    key = (spark.sparkContext.applicationId, sf_dir, p)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Research(keep(fixture.bars(spark, sf_dir), "bars"), keep(fixture.securities(spark, sf_dir), "securities"), p, keep)
    return _LAST[key]


def forget() -> None:
    """The next query begins at the source tables again."""
    _LAST.clear()


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to PLACES decimals, infinite ones as null, and no negative zero.

    Statistics were rounded before they met a limit; a nudge keeps them off the ties that engines round differently.
    """
    fix = lambda c: F.when(F.abs(c) != float("inf"), F.round(F.col(c) + float(NUDGE), PLACES) + 0.0).alias(c)
    return df.select(*[fix(c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Research], DataFrame]) -> Callable:
    """Register a function of a Research as a query of its name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(research(spark, sf_dir)))
    return f


@query
def bars(r):
    return r.bars


@query
def reference_calendar(r):
    return r.calendar


@query
def missing_runs(r):
    return quality.missing_runs(r.bars, r.calendar)


@query
def security_quality(r):
    return r.quality


@query
def quality_summary(r):
    return quality.quality_summary(r.quality, r.calendar)


@query
def extreme_returns(r):
    return quality.extreme_returns(r.bars, r.p)


@query
def ohlc_violations(r):
    return quality.ohlc_violations(r.bars, r.p)


@query
def zero_volume_runs(r):
    return quality.zero_volume_runs(r.bars)


@query
def download_log(r):
    return quality.download_log(r.bars)


@query
def download_batches(r):
    return r.securities.select("ticker", batch_number(F.col("ticker"), 10).alias("batch"))


@query
def clean_bars(r):
    """Rows come twice, the later time with the price moved and sometimes spoiled."""
    rows = r.bars.withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2))))
    k = F.day("session")
    rows = rows.withColumn("close", F.when((F.col("turn") == 2) & (k % 5 == 0), -F.col("close")).when(F.col("turn") == 2, F.col("close") + 1).otherwise(F.col("close")))
    return clean.clean(rows, "turn").drop("turn")


def _overrides(r):
    first = r.bars.where("ticker in ('Brand#1', 'Brand#2')").groupBy("ticker").agg(F.date_add(F.min("session"), 100).alias("start_date"))
    cut = first.select("ticker", F.lit("truncate_before").alias("action"), "start_date", F.lit(None).cast("string").alias("field"))
    bad = quality.ohlc_violations(r.bars, r.p).where("rule <> 'high_below_low'")
    fix = bad.select("ticker", F.lit("repair_ohlc").alias("action"), F.col("session").alias("start_date"), F.when(F.col("rule") == "high_below_open_close", "High").otherwise("Low").alias("field"))
    return cut.unionByName(fix.where("ticker not in ('Brand#1', 'Brand#2')"))


@query
def apply_overrides(r):
    return clean.apply_overrides(r.bars, _overrides(r))[0]


@query
def override_log(r):
    return clean.apply_overrides(r.bars, _overrides(r))[1]


@query
def universe_difference(r):
    return clean.compare_universe(r.securities.where("ticker <> 'Brand#3'"), r.bars.where("ticker <> 'Brand#4'"))


@query
def dense_panel(r):
    return panel.dense_panel(r.cleaned)


@query
def eligibility(r):
    return r.panel.select("session", "sidx", "ticker", "history", "positive_days", "median_dollar_volume", "eligible")


@query
def universe_coverage(r):
    return r.coverage


@query
def month_ends(r):
    return r.month_ends


@query
def pair_correlation(r):
    return candidates.pair_correlation(r.panel, r.securities, r.p)


@query
def candidate_pairs(r):
    return r.candidates.drop("sidx")


@query
def candidate_pairs_issuer_first(r):
    return candidates.generate_candidates(r.panel, r.securities, replace(r.p, exclude_issuer_before_topk=True, max_partners=2)).drop("sidx")


@query
def candidate_summary(r):
    return candidates.candidate_summary(r.candidates)


@query
def sector_topk(r):
    return candidates.top_in_sector(r.candidates, 3).select("selection_date", "sector", "ticker_1", "ticker_2", "sector_candidate_rank")


@query
def ols_spread(r):
    return r.tested.select("selection_date", "ticker_1", "ticker_2", "formation_observations", "dependent_ticker", "alpha", "hedge_ratio", "spread_std")


@query
def adf_tau(r):
    return r.tested.select("selection_date", "ticker_1", "ticker_2", "tau_12", "tau_21")


@query
def coint_pvalues(r):
    return r.tested.select("selection_date", "ticker_1", "ticker_2", "test_status", "pvalue_12", "pvalue_21", "conservative_pvalue", "dependent_ticker", "independent_ticker")


@query
def coint_log_pvalues(r):
    """Small p-values on a log scale, four decimals of it; zero is null."""
    log = lambda c: F.round(F.ln(F.when(F.col(c) > 0, F.col(c))) + float(NUDGE), 4)
    return r.results.select("selection_date", "ticker_1", "ticker_2", log("pvalue_12").alias("log_12"), log("pvalue_21").alias("log_21"), "dependent_ticker", log("fdr_pvalue").alias("log_fdr"))


@query
def half_life(r):
    return r.tested.select("selection_date", "ticker_1", "ticker_2", "half_life", "mean_reversion_coefficient")


@query
def mean_crossings(r):
    return r.tested.select("selection_date", "ticker_1", "ticker_2", "mean_crossings")


@query
def bh_fdr(r):
    return r.results.select("selection_date", "ticker_1", "ticker_2", "fdr_pvalue", "passes_fdr", "passes_half_life", "passes_hedge_ratio", "passes_spread_std", "qualified")


@query
def coint_summary(r):
    return cointegration.test_summary(r.results)


@query
def cap_sensitivity(r):
    return cointegration.cap_sensitivity(r.by_cap, r.selection_dates, r.p)


@query
def cap_yearly(r):
    return cointegration.cap_yearly(r.by_cap, r.selection_dates, r.p)


@query
def pair_recurrence(r):
    return cointegration.pair_recurrence(r.by_cap)


@query
def baseline_pairs(r):
    return r.baseline.select("selection_date", "pair_id", "dependent_ticker", "independent_ticker", "sector", "sector_candidate_rank", "baseline_fdr_pvalue", "hedge_ratio", "half_life")


@query
def baseline_summary(r):
    return cointegration.baseline_summary(r.baseline, r.selection_dates)


@query
def frozen_z(r):
    path = events.z_paths(r.baseline, r.panel, events.evaluation_dates(r.baseline, r.panel))
    return path.select("selection_date", "pair_id", "session", "z", "both_eligible")


@query
def spread_events(r):
    return r.events.drop("formation_half_life", "hedge_ratio")


@query
def event_summary(r):
    return events.event_summary(r.events)


@query
def event_by_sector(r):
    return events.event_by_sector(r.events)


@query
def drawdown(r):
    return metrics.drawdown(r.bars.withColumnRenamed("session", "date"), "close", ("ticker",))


@query
def yearly_returns(r):
    return metrics.yearly_returns(r.bars.withColumnRenamed("session", "date"), "close", ("ticker",))


@query
def return_histogram(r):
    return metrics.histogram(quality.returns(r.bars), "ret")


@query
def best_and_worst_days(r):
    return metrics.best_and_worst(quality.returns(r.bars).where("ret is not null").select("ticker", "session", F.round("ret", 8).alias("ret")), "ret", ["ticker", "session"])


def _market(r: Research) -> DataFrame:
    return r.bars.groupBy(F.col("session").alias("date")).agg(F.median("close").alias("close"))


@query
def market_relative(r):
    """One security against the pooled series; market_relative_all has every one."""
    market = _market(r)
    own = r.bars.where("ticker = 'Brand#1'").select(F.col("session").alias("date"), F.col("close").alias("net_equity"))
    return metrics.relative(own, market, r.p)


@query
def market_relative_all(r):
    """market_relative of every security."""
    own = r.bars.select("ticker", F.col("session").alias("date"), F.col("close").alias("net_equity"))
    return metrics.relative(own, _market(r), r.p, ("ticker",))


@query
def event_outcomes(r):
    """Entered events as trades: the excursion at the end is the result."""
    rows = r.events.where("entry_triggered").withColumn("reason", F.when(F.col("touched_abs_z_0_5"), "mean_reversion").when(F.abs("end_z_score") >= 4, "stop_loss").otherwise("expiry"))
    result = F.round(-F.signum("entry_z_score") * (F.col("end_z_score") - F.col("entry_z_score")), 8)
    rows = rows.select("reason", result.alias("net_pnl"), result.alias("net_return"), F.col("forward_sessions").alias("holding_sessions"))
    return metrics.outcomes(rows, "reason")


def _table(kind: str) -> Callable[[Research], DataFrame]:
    return lambda r: backtest.table(r.baseline_backtest, kind)


for _name, _kind in {"backtest_trades": "trade", "backtest_orders": "order", "backtest_equity": "equity", "backtest_exposure": "exposure", "backtest_positions": "position"}.items():
    QUERIES[_name] = lambda spark, sf_dir, f=_table(_kind): rounded(f(research(spark, sf_dir)))


def _with_result(f: Callable[[Research, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = research(spark, sf_dir)
        return rounded(f(r, r.baseline_backtest))

    return run


QUERIES["backtest_metrics"] = _with_result(lambda r, b: metrics.performance(backtest.table(b, "equity"), backtest.table(b, "trade"), r.p))
QUERIES["portfolio_relative"] = _with_result(lambda r, b: metrics.relative(backtest.table(b, "equity"), _market(r), r.p))
QUERIES["backtest_validation"] = _with_result(lambda r, b: metrics.validation(backtest.table(b, "trade"), backtest.table(b, "equity"), r.p))
QUERIES["backtest_exit_reasons"] = _with_result(lambda r, b: metrics.outcomes(backtest.table(b, "trade"), "exit_reason"))
QUERIES["backtest_sectors"] = _with_result(lambda r, b: metrics.outcomes(backtest.table(b, "trade"), "sector"))
QUERIES["backtest_yearly"] = _with_result(lambda r, b: metrics.yearly_returns(backtest.table(b, "equity"), initial=r.p.initial_equity))
QUERIES["backtest_best_and_worst"] = _with_result(lambda r, b: metrics.best_and_worst(backtest.table(b, "trade"), "net_pnl", ["entry_date", "pair_id"]))
QUERIES["backtest_turnover"] = _with_result(lambda r, b: metrics.turnover(backtest.table(b, "order"), backtest.table(b, "equity"), r.p))
QUERIES["backtest_tail_losses"] = _with_result(lambda r, b: metrics.tail_losses(backtest.table(b, "trade")))
QUERIES["backtest_legs"] = _with_result(lambda r, b: metrics.leg_contribution(backtest.table(b, "trade")))


def backtest_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The robustness grid: one fold per scenario, in parallel."""
    r = research(spark, sf_dir)
    grid = {f"entry{e}_stop{s}_hold{h}": replace(P, entry_z=e, stop_z=s, max_holding=h) for e in (1.5, 2.0, 2.5) for s in (3.0, 4.0) for h in (10, 20)}
    out = backtest.table(r.backtest(grid), "equity", keep_scenario=True)
    return rounded(out.groupBy("scenario").agg(F.max_by("net_equity", "date").alias("final_equity"), F.max("active_pairs").alias("most_pairs"), F.max_by("cumulative_execution_cost", "date").alias("execution_cost")))


QUERIES["backtest_scenarios"] = backtest_scenarios


def mackinnon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values on a grid of statistics."""
    tau = spark.range(0, 161).select((F.col("id") / 8.0 - 19.0).alias("tau"))
    return rounded(tau.select("tau", mackinnon_p(F.col("tau")).alias("pvalue")))


QUERIES["mackinnon_p"] = mackinnon


def mackinnon_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the SQL function."""
    sql.register(spark)
    return rounded(spark.sql("SELECT tau, mackinnon_p(tau) AS pvalue FROM (SELECT id / 8.0D - 19.0D AS tau FROM range(0, 161))"))


QUERIES["mackinnon_p_sql"] = mackinnon_sql


@query
def bh_adjust_sql(r):
    """Adjusted p-values through the SQL function, a month's tests as one array."""
    sql.register(r.bars.sparkSession)
    groups = r.tested.groupBy("selection_date").agg(F.collect_list(F.struct("ticker_1", "ticker_2", "conservative_pvalue")).alias("t"))
    groups = groups.selectExpr("selection_date", "t", "bh_adjust(t.conservative_pvalue) AS q")
    return groups.select("selection_date", F.explode(F.arrays_zip("t", "q")).alias("x")).select("selection_date", "x.t.ticker_1", "x.t.ticker_2", F.col("x.q").alias("fdr_pvalue"))


@query
def wide_panels(r):
    """The panel written as five matrices, sessions by tickers, and read back."""
    path = scratch_folder(r.bars.sparkSession, "wide")
    files.write_wide_panels(r.panel, path, [x.ticker for x in r.panel.select("ticker").distinct().orderBy("ticker").collect()])
    return files.read_wide_panels(r.bars.sparkSession, path)


@query
def anomaly_events(r):
    return quality.anomaly_events(r.bars, r.quality, r.p)


@query
def latest_log(r):
    """Two runs of the download, the second without half of the tickers: a success stays before a later failure."""
    odd = F.pmod(F.regexp_extract("ticker", r"(\d+)", 1).cast("int"), F.lit(2)) == 1
    first, second = (quality.download_log(b, r.securities) for b in (r.bars.where("ticker <> 'Brand#4'"), r.bars.where(odd)))
    return quality.latest_log(first.unionByName(second))


QUERIES["figure_equity"] = _with_result(lambda r, b: metrics.equity_figure(backtest.table(b, "equity")))
QUERIES["figure_attribution"] = _with_result(lambda r, b: metrics.attribution(backtest.table(b, "trade"), "exit_reason"))
QUERIES["figure_entry_scatter"] = _with_result(lambda r, b: metrics.scatter(backtest.table(b, "trade"), "entry_z_score"))
QUERIES["figure_holding_scatter"] = _with_result(lambda r, b: metrics.scatter(backtest.table(b, "trade"), "holding_sessions"))

__all__ = ["ORACLE", "QUERIES"]
