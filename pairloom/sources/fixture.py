"""A daily price panel derived from the star-schema tables, the same in any SQL engine.

Brands are tickers, ship dates are sessions; shocks come from integer cents, so sums are exact. Brand 21 shares the
issuer of brand 1; brands have one of two sub-industries; a few highs and lows break the day's range, volumes pause for
stretches, and one close in 97 is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Four decimals by flooring, which rounds alike everywhere.
R4 = "floor(({x}) * 1e4 + 0.5e0) / 1e4"

CTES = {
    "sess": "select s, row_number() over (order by s) as i from (select distinct cast(l_shipdate as date) as s from lineitem) d",
    "tk": "select distinct p_brand as ticker, cast(replace(p_brand, 'Brand#', '') as int) as b from part",
    "traded": """select p_brand as ticker, cast(l_shipdate as date) as s, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents,
        cast(sum(cast(l_quantity as bigint)) as bigint) as qty from lineitem join part on l_partkey = p_partkey group by 1, 2""",
    "grid": """select tk.ticker, b, (b - 1) % 5 as sec, sess.s, i, coalesce(cents, 0) as cents, coalesce(qty, 0) as qty
        from tk cross join sess left join traded t on t.ticker = tk.ticker and t.s = sess.s""",
    "shock": """select *, case when sum(cents) over (partition by sec, s) = 0 then 0 else (sum(cents) over (partition by sec, s)) % 2003 - 1001 end as fs,
        case when cents = 0 then 0 else (cents % 2003) - 1001 end as us from grid""",
    "walk": """select *, sum(fs) over (partition by ticker order by i) as f, sum(us) over (partition by ticker order by i rows between 7 preceding and current row) as u,
        sum(us) over (partition by ticker order by i) as rw from shock""",
    "px": """select ticker, b, concat('SECTOR_', sec) as sector, s as session, i,
        case when (i * 7 + b) % 97 = 0 then null else round(exp(4e0 + cast((80 + 2 * b) * f as double) * 2e-7 + cast(u * (case when b % 4 = 0 then 4 else 1 end) as double) * 4e-6
        + case when b % 3 = 0 then cast(rw as double) * 5e-6 else 0e0 end), 4) end as close, 1000 * (1 + qty) as vol from walk""",
    "opened": f"select *, {R4.format(x='coalesce(lag(close) over (partition by ticker order by i), close) * (1e0 + ((i * 13 + b * 7) % 11 - 5) * 1e-3)')} as open from px",
    "bars": f"""select ticker, session, open,
        {R4.format(x="greatest(open, close) * case when (i * 31 + b) % 1009 = 0 then 0.99e0 else 1e0 + ((i * 5 + b) % 7) * 5e-4 end")} as high,
        {R4.format(x="least(open, close) * case when (i * 37 + b) % 1013 = 0 then 1.01e0 else 1e0 - ((i * 3 + b) % 7) * 5e-4 end")} as low,
        close, case when (i * 3 + b) % 1511 = 0 then null when (i + b * 53) % 701 < 6 then 0e0 else cast(vol as double) end as volume
        from opened where close is not null""",
    "securities": """select ticker, concat('SECTOR_', (b - 1) % 5) as sector, concat('SUB_', b % 2) as sub_industry,
        case when b = 21 then '0000000001' else lpad(cast(b as varchar(10)), 10, '0') end as cik from tk""",
}
BARS = ("sess", "tk", "traded", "grid", "shock", "walk", "px", "opened", "bars")


def with_clause(names: tuple[str, ...], ctes: dict[str, str] = CTES) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]})" for n in names)


def _views(spark: SparkSession, sf_dir: str) -> None:
    for name in ("lineitem", "part"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, session, open, high, low, close, volume."""
    _views(spark, sf_dir)
    return spark.sql(f"{with_clause(BARS)} SELECT ticker, session, open, high, low, close, volume FROM bars")


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, sector, sub_industry, cik."""
    _views(spark, sf_dir)
    return spark.sql(f"{with_clause(('tk', 'securities'))} SELECT ticker, sector, sub_industry, cik FROM securities")
