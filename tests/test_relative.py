import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_security_is_compared_with_the_market(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    db = duckdb.connect()
    for name in ("lineitem", "part", "orders", "supplier", "customer", "nation", "region", "events"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = {r.ticker: r for r in queries["market_relative_all"](spark, SF).collect()}
    want = {r[0]: r[1:] for r in db.sql(sql["market_relative_all"]).fetchall()}
    one = queries["market_relative"](spark, SF).collect()[0]
    assert len(got) > 1 and got.keys() == want.keys()
    for ticker, r in got.items():
        assert [r.beta, r.correlation, r.annual_alpha] == pytest.approx(list(want[ticker]), rel=1e-6, abs=1e-6)
    assert tuple(got["Brand#1"])[1:] == pytest.approx(tuple(one))


def test_the_portfolio_is_compared_with_the_market(spark):
    (r,) = entry.queries()["portfolio_relative"](spark, SF).collect()
    assert set(r.asDict()) == {"beta", "correlation", "annual_alpha"}
