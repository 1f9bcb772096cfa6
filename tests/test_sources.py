import datetime as dt
import json

import pytest

from pairloom.schemas import InputError
from pairloom.sources import files, quotes

PAGE = """<html><table id=x><tr><th>Symbol</th><th>Security</th><th>GICS Sector</th><th>GICS Sub-Industry</th><th>Headquarters Location</th><th>Date added</th><th>CIK</th><th>Founded</th></tr>
<tr><td>AB.C</td><td>A <b>B</b></td><td>S</td><td>U</td><td>H</td><td>1999-01-02</td><td>12</td><td>1900</td></tr><tr><td>D</td><td>D</td><td>S</td><td>U</td><td>H</td><td>soon</td><td>3.0</td><td></td></tr></table></html>"""


def test_constituents(spark):
    got = {r.yahoo_ticker: r for r in files.constituents(spark, PAGE).collect()}
    assert got["AB-C"].cik == "0000000012" and got["AB-C"].company == "A B" and got["AB-C"].date_added == dt.date(1999, 1, 2) and got["D"].date_added is None
    with pytest.raises(InputError):
        files.constituents(spark, PAGE.replace("CIK", "X"))


def test_security_files_and_tables(spark, tmp_path):
    import pandas as pd

    folder = tmp_path / "raw"
    folder.mkdir()
    for t in ("A", "B-C"):
        pd.DataFrame({"Date": pd.to_datetime(["2020-01-02", "2020-01-03"]), "Open": [1.0, 2.0], "High": [1.0, 2.0], "Low": [1.0, 2.0], "Close": [1.0, float("nan")], "Volume": [5, 6]}).to_parquet(folder / f"{t}.parquet")
    bars = files.read_security_files(spark, str(folder))
    assert sorted((r.ticker, r.close) for r in bars.where("session = '2020-01-02'").collect()) == [("A", 1.0), ("B-C", 1.0)]
    assert bars.where("close is null").count() == 2
    files.write_bars(bars, str(tmp_path / "bars"))
    assert files.read_table(spark, str(tmp_path / "bars"), "ticker", "year").count() == 4
    for path, column in ((tmp_path / "none", "ticker"), (tmp_path / "bars", "zzz")):
        with pytest.raises(InputError):
            files.read_table(spark, str(path), column)


def test_csv_json_and_unpivot(spark, tmp_path):
    wide = spark.createDataFrame([(dt.date(2020, 1, 2), 1.0, 2.0, 3.0)], "session date, close_A double, open_A double, close_B double")
    got = sorted(map(tuple, files.unpivot_quotes(wide).select("ticker", "open", "close").collect()))
    assert got == [("A", 2.0, 1.0), ("B", None, 3.0)]
    (tmp_path / "o.csv").write_text("ticker,action,start_date,end_date,field,reason,source\nA,truncate_before,2020-01-02,,,why,where\nB,repair_ohlc,2020-01-03,,High,why,where\n")
    rows = files.read_overrides(spark, str(tmp_path / "o.csv")).orderBy("position").collect()
    assert [(r.ticker, r.field) for r in rows] == [("A", None), ("B", "High")]
    files.write_metrics_json(spark.sql("select double('NaN') a, double('Infinity') b, 1.5d c, 'x' d"), str(tmp_path / "m"))
    (text,) = [p.read_text() for p in (tmp_path / "m").glob("*.json")]
    assert json.loads(text) == {"a": None, "b": None, "c": 1.5, "d": "x"}
    files.write_csv(wide, str(tmp_path / "w"))
    assert files.read_csv(spark, str(tmp_path / "w"), "session date, close_A double, open_A double, close_B double").count() == 1


def fake_fetch(tickers, start, end):
    if len(tickers) > 1 or tickers == ["BAD"]:
        raise OSError("no batch")
    return [(t, dt.date(2020, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0) for t in tickers]


def test_quotes(spark):
    spark.dataSource.register(quotes.Quotes)
    df = spark.read.format("quotes").options(fetch="tests.test_sources:fake_fetch", tickers="A,B,BAD", batch=2, retries=2, wait=0).load()
    assert sorted(r.ticker for r in df.collect()) == ["A", "B"]
