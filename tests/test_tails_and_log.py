import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from pairloom.functions import sql, stats
from pairloom.sources import files
from pairloom.sources.quotes import Batch, QuoteReader


def test_normal_tail_keeps_its_relative_accuracy(spark):
    xs = [i / 8 for i in range(-290, 291)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double")
    sql.register(spark)
    for got in (rows.select("x", stats.normal_cdf(F.col("x")).alias("p")), rows.selectExpr("x", "normal_cdf(x) AS p")):
        for r in got.collect():
            want = 0.5 * math.erfc(-r.x / math.sqrt(2))
            assert r.p == pytest.approx(want, rel=2e-12)


def plain_bh(ps):
    known = sorted(p for p in ps if p is not None)
    out = {}
    for p in known:
        out[p] = min([1.0] + [q * len(known) / (known.index(q) + known.count(q)) for q in known if q >= p])
    return [None if p is None else out[p] for p in ps]


@pytest.mark.parametrize("ps", [[], [None], [0.01], [0.04, 0.01, None, 0.03, 0.01], [0.9, 0.9, 0.9], [0.2, 0.001, 0.5, 0.5, 0.04, None, 1.0]])
def test_bh_in_sql(spark, ps):
    sql.register(spark)
    got = spark.createDataFrame([(ps,)], "ps array<double>").selectExpr("bh_adjust(ps) AS a").first().a
    assert got == pytest.approx(plain_bh(ps)) if None not in ps else [a if a is None else round(a, 12) for a in got] == [a if a is None else round(a, 12) for a in plain_bh(ps)]


def moody(tickers, start, end):
    if len(tickers) > 1:
        raise ConnectionError("too many requests")
    if tickers == ["C"]:
        raise ValueError("no such ticker C")
    return [(t, dt.date(2020, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0) for t in tickers if t != "B"]


def test_failed_tickers_stay_in_the_log():
    options = {"fetch": f"{__name__}:moody", "tickers": "A,B,C", "retries": "2", "wait": "0"}
    assert [r[0] for r in QuoteReader(options).read(Batch(["A", "B", "C"]))] == ["A"]
    log = list(QuoteReader({**options, "log": "true"}).read(Batch(["A", "B", "C"])))
    assert log == [("A", "success", "single", 1, None), ("B", "failed", "single", 0, "no rows"), ("C", "failed", "single", 0, "ValueError: no such ticker C")]


def test_wide_panels_lose_nothing(spark, tmp_path):
    rows = [(dt.date(2020, 1, d), t, None if (d, t) == (2, "A.B") else float(d), d % 2 == 0) for d in (1, 2, 3) for t in ("A.B", "C")]
    panel = spark.createDataFrame(rows, "session date, ticker string, close double, eligible boolean")
    files.write_wide_panels(panel, f"file://{tmp_path}", ["A.B", "C"], ("close", "eligible"))
    got = files.read_wide_panels(spark, f"file://{tmp_path}", ("close", "eligible"))
    assert sorted(map(tuple, got.select(panel.columns).collect())) == sorted(map(tuple, panel.collect()))
