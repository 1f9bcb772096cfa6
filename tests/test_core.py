"""Operators on hand-made rows: the edges that the fixture panel does not reach."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions import scalars, stats
from pairloom.operators import candidates, clean, cointegration, metrics, panel, quality
from pairloom.params import Params
from pairloom.schemas import BARS, InputError

DAY = dt.date(2020, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def bars(spark, rows):
    return spark.createDataFrame(rows, BARS)


def bar(ticker, i, close=10.0, volume=100.0, open_=None, high=None, low=None):
    o = close if open_ is None else open_
    top, bottom = (max(x for x in (o, close)), min(x for x in (o, close))) if None not in (o, close) else (None, None)
    return (ticker, day(i), o, high if high is not None else top, low if low is not None else bottom, close, volume)


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


@pytest.mark.parametrize(("value", "want"), [("320193.0", "0000320193"), (" 12 ", "0000000012"), ("12345678901", "12345678901"), (None, None)])
def test_cik(spark, value, want):
    assert one(spark, value).select(scalars.normalise_cik(F.col("v"))).first()[0] == want


def test_lenient_parsing(spark):
    df = spark.createDataFrame([("1.5", "2020-01-02"), ("x", "never"), ("NaN", None), ("Infinity", "2020-13-01")], "n string, d string")
    got = df.select(scalars.lenient_double(F.col("n")), scalars.lenient_date(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(1.5, dt.date(2020, 1, 2)), (None, None), (None, None), (None, None)]


def test_tolerance(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 5e-7), (1.0, 1.1), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(scalars.clearly_below(F.col("a"), F.col("b"), 1e-6, 1e-8)).collect()] == [False, True, False]


def test_clean(spark):
    rows = [bar("A", 0, 1.0), bar("A", 0, 2.0), bar("A", 1, -1.0), bar("A", 2, None), bar("A", 3, float("nan")), bar("A", 4, 5.0, None)]
    df = bars(spark, rows).withColumn("n", F.monotonically_increasing_id())
    got = sorted((r.session, r.close, r.volume) for r in clean.clean(df, "n").collect())
    assert got == [(day(0), 2.0, 100.0), (day(4), 5.0, None)]
    with pytest.raises(InputError):
        clean.validate_cleaned(bars(spark, rows[:2]))
    with pytest.raises(ValueError):
        clean.validate_cleaned(bars(spark, []))
    assert clean.validate_cleaned(clean.clean(df, "n")).count() == 2


def test_overrides(spark):
    schema = "ticker string, action string, start_date date, end_date date, field string, reason string, source string"
    data = bars(spark, [bar("A", i, 10.0 + i, open_=9.0 + i, high=9.5 + i if i == 2 else None) for i in range(4)])
    patch = [("A", "truncate_before", day(1), None, None, "", ""), ("A", "repair_ohlc", day(2), None, "High", "", "")]
    out, log = clean.apply_overrides(data, spark.createDataFrame(patch, schema))
    got = {r.session: r.high for r in out.collect()}
    assert got == {day(1): 11.0, day(2): 12.0, day(3): 13.0}
    assert sorted((r.action, r.rows_affected) for r in log.collect()) == [("repair_ohlc", 1), ("truncate_before", 1)]
    for bad in [("A", "other", day(1), None, None, "", ""), ("A", "truncate_before", None, None, None, "", ""), ("A", "repair_ohlc", day(9), None, "High", "", ""), ("A", "repair_ohlc", day(2), None, "Open", "", "")]:
        with pytest.raises(InputError):
            clean.apply_overrides(data, spark.createDataFrame([bad], schema))


def test_zero_volume_runs(spark):
    rows = [bar("A", i, 10.0 + i % 2, v) for i, v in enumerate([0.0, None, 0.0, 5.0, None, 7.0])]
    got = sorted((r.start_date, r.length, r.start_close, r.end_close, r.unique_closes) for r in quality.zero_volume_runs(bars(spark, rows)).collect())
    assert got == [(day(0), 3, 10.0, 10.0, 2), (day(4), 1, 10.0, 10.0, 1)]


def test_missing_runs_and_own_row_returns(spark):
    rows = [bar("A", i) for i in (1, 2, 6)] + [bar("B", i) for i in range(8)] + [bar("C", i) for i in range(8)]
    data = bars(spark, rows)
    calendar = quality.reference_calendar(data)
    assert calendar.count() == 8 and {r.active for r in calendar.collect()} == {2, 3}
    assert [tuple(r) for r in quality.missing_runs(data, calendar).collect()] == [("A", day(3), day(5), 3)]
    q = {r.ticker: r for r in quality.security_quality(data, calendar).collect()}
    assert (q["A"].expected_observations, q["A"].missing_observations, q["A"].maximum_missing_run, q["A"].status) == (6, 3, 3, "warning")
    jump = bars(spark, [bar("A", 0, 10.0), bar("A", 5, 16.0)])
    assert quality.extreme_returns(jump).first().ret == pytest.approx(0.6)
    dense = panel.dense_panel(bars(spark, [bar("A", 0, 10.0), bar("A", 5, 16.0), *[bar("B", i) for i in range(6)]]))
    assert [r.ret for r in candidates.log_returns(dense).where("ticker = 'A'").orderBy("sidx").collect()] == [None] * 6


def test_duplicate_and_broken_rows_are_errors(spark):
    data = bars(spark, [bar("A", 0), bar("A", 0), bar("B", 0, 10.0, high=9.0), bar("C", 0, 10.0, high=10.0 - 1e-6), bar("D", 0, volume=-1.0), bar("E", 0, volume=0.0)])
    q = {r.ticker: r for r in quality.security_quality(data, quality.reference_calendar(data)).collect()}
    assert {t: r.status for t, r in q.items()} == {"A": "error", "B": "error", "C": "pass", "D": "error", "E": "warning"}
    assert q["A"].duplicate_dates == 1 and q["B"].high_below_open_close == 1 and q["B"].high_below_low == 1


def test_eligibility_window(spark):
    p = Params(min_history=3, liquidity_window=4, min_liquidity_days=3, min_price=5.0, min_median_dollar_volume=100.0)
    volumes = [100.0, 100.0, 100.0, 0.0, None, 100.0, 100.0, 100.0]
    got = panel.eligibility(panel.dense_panel(bars(spark, [bar("A", i, 10.0, v) for i, v in enumerate(volumes)])), p).orderBy("sidx").collect()
    assert [r.eligible for r in got] == [False, False, True, False, False, False, False, True]
    assert [r.positive_days for r in got] == [None, None, 3, 3, 2, 2, 2, 3]


def test_benjamini_hochberg(spark):
    values = [0.01, 0.04, 0.04, None, 0.5, 0.9, 0.001]
    df = spark.createDataFrame([("g", f"t{i}", "x", v) for i, v in enumerate(values)], "g string, ticker_1 string, ticker_2 string, p double")
    got = {r.ticker_1: r.q for r in df.select("ticker_1", stats.benjamini_hochberg(F.col("p"), ["g"], ["ticker_1"]).alias("q")).collect()}
    known = sorted(v for v in values if v is not None)
    want = {v: min(1.0, min(x * len(known) / (i + 1) for i, x in enumerate(known) if x >= v)) for v in known}
    assert got["t3"] is None and all(got[f"t{i}"] == pytest.approx(want[v]) for i, v in enumerate(values) if v is not None)


def test_mackinnon(spark):
    taus = [-3.89644, -3.33613, -3.04445, -30.0, 2.0, -math.inf, None]
    df = spark.createDataFrame([(t,) for t in taus], "t double")
    got = [r[0] for r in df.select(stats.mackinnon_p(F.col("t"))).collect()]
    assert got[:3] == pytest.approx([0.01003, 0.04996, 0.10001], abs=2e-5) and got[3:] == [0.0, 1.0, 0.0, None]
    xs = [-8.0, -2.5, -0.1, 0.0, 0.7, 3.0, 7.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(stats.normal_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], abs=1e-14)


def walk_pair(n=400, seed=5):
    rng = random.Random(seed)
    level, gap, out = 3.0, 0.0, []
    for _ in range(n):
        level += rng.gauss(0, 0.01)
        gap = 0.8 * gap + rng.gauss(0, 0.01)
        out.append((math.exp(level), math.exp(0.5 + 0.9 * level + gap)))
    return out


def test_engle_granger_against_numpy(spark):
    np = pytest.importorskip("numpy")
    series = walk_pair()
    data = bars(spark, [r for i, (a, b) in enumerate(series) for r in (bar("A", i, a), bar("B", i, b))])
    grid = panel.dense_panel(data)
    pairs = spark.createDataFrame([(day(380), 380, "A", "B")], "selection_date date, sidx int, ticker_1 string, ticker_2 string")
    got = cointegration.test_pairs(pairs, grid, Params()).first()
    a, b = (np.log([x[k] for x in series[128:381]]) for k in (0, 1))
    for y, x, tau in ((a, b, got.tau_12), (b, a, got.tau_21)):
        beta, alpha = np.polyfit(x, y, 1)
        u = y - alpha - beta * x
        lag, diff, v = u[1:-1], u[1:-1] - u[:-2], u[2:] - u[1:-1]
        design = np.column_stack([lag, diff])
        coef, *_ = np.linalg.lstsq(design, v, rcond=None)
        resid = v - design @ coef
        s2 = resid @ resid / (len(v) - 2)
        assert tau == pytest.approx(coef[0] / math.sqrt(s2 * np.linalg.inv(design.T @ design)[0, 0]), abs=1e-6)
    assert got.test_status == "success" and got.formation_observations == 253
    dep, ind = (a, b) if got.dependent_ticker == "A" else (b, a)
    beta, alpha = np.polyfit(ind, dep, 1)
    u = dep - alpha - beta * ind
    slope = np.polyfit(u[:-1], np.diff(u), 1)[0]
    assert got.hedge_ratio == pytest.approx(beta) and got.half_life == pytest.approx(-math.log(2) / slope, rel=1e-6)
    assert got.spread_std == pytest.approx(u.std(ddof=1)) and got.mean_crossings == int((np.sign(u[1:]) != np.sign(u[:-1])).sum())


def test_test_statuses(spark):
    series = walk_pair(300)
    rows = [r for i, (a, b) in enumerate(series) for r in (bar("A", i, a), bar("C", i, 7.0), *([bar("D", i, b)] if i > 150 else []))]
    pairs = spark.createDataFrame([(day(280), 280, "A", "C"), (day(280), 280, "A", "D")], "selection_date date, sidx int, ticker_1 string, ticker_2 string")
    got = {r.ticker_2: r for r in cointegration.test_pairs(pairs, panel.dense_panel(bars(spark, rows)), Params()).collect()}
    assert got["C"].test_status == "constant_price_series" and got["D"].test_status == "insufficient_observations"
    assert got["C"].hedge_ratio is None and got["D"].formation_observations == 130


def test_correlation_needs_enough_sessions(spark):
    series = walk_pair(320)
    sec = spark.createDataFrame([("A", "S", "x", "1"), ("B", "S", "x", "2"), ("B", "S", "y", "2"), ("E", None, "x", "3")], "ticker string, sector string, sub_industry string, cik string")
    rows = [r for i, (a, b) in enumerate(series) for r in (bar("A", i, a), *([bar("B", i, b)] if i % 3 else []))]
    grid = panel.dense_panel(bars(spark, rows)).withColumn("eligible", F.lit(True))
    got = candidates.pair_correlation(grid, sec, Params(min_pair_observations=50)).collect()
    assert got and all(r.pair_observations == 84 for r in got)
    assert all(r.return_correlation is None for r in candidates.pair_correlation(grid, sec, Params()).collect())


def test_validation_and_metrics(spark):
    days = [(day(i), v, 0.5, 0.1, 1) for i, v in enumerate([1.0, 1.1, 0.99, 1.2])]
    equity = spark.createDataFrame(days, "date date, net_equity double, gross_exposure double, net_exposure double, active_pairs long")
    trades = spark.createDataFrame(
        [("A", "B", day(0), day(1), day(2), day(3), 0.3, 0.1, 0.05, 0.15, 2.5, 3), ("A", "C", day(1), day(2), day(3), day(4), -0.1, 0.1, 0.05, -0.25, 4.5, 5)],
        "ticker_a string, ticker_b string, signal_date date, entry_date date, exit_signal_date date, exit_date date, gross_pnl double, execution_cost double, borrow_cost double, net_pnl double, entry_z_score double, holding_sessions long",
    )
    m = metrics.performance(equity, trades).first()
    assert m.total_return == pytest.approx(0.2) and m.maximum_drawdown == pytest.approx(-0.1) and m.profit_factor == pytest.approx(0.6) and m.win_rate == 0.5
    checks = {r.check: r.passed for r in metrics.validation(trades, equity).collect()}
    assert checks == {"trade_pnl_reconciles": True, "entry_after_signal": True, "exit_after_signal": True, "entry_inside_stop": False, "no_concurrent_ticker": False, "maximum_pairs": True}
    with pytest.raises(InputError):
        metrics.require_valid(metrics.validation(trades, equity))
    nothing = metrics.performance(equity.limit(0), trades.limit(0)).first()
    assert nothing.trade_count == 0 and nothing.sharpe_ratio is None
