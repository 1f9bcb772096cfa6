"""Same-sector candidate pairs by rolling return correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.panel import month_ends
from pairloom.params import Params

#: Decimals that statistics are rounded to before they are compared with a limit.
DECIMALS = 8


def log_returns(panel: DataFrame) -> DataFrame:
    """panel with ret: log return from the calendar's previous session, null across a gap."""
    own = Window.partitionBy("ticker").orderBy("sidx")
    price = F.when(F.col("close") > 0, F.ln("close"))
    return panel.withColumn("ret", price - F.lag(price).over(own))


def first_per_ticker(securities: DataFrame) -> DataFrame:
    """ticker, sector, sub_industry, issuer; one row per ticker, rows without a sector left out."""
    order = Window.partitionBy("ticker").orderBy("sector", "sub_industry", "cik")
    rows = securities.where("sector is not null").withColumn("n", F.row_number().over(order)).where("n = 1")
    return rows.select("ticker", "sector", "sub_industry", F.col("cik").alias("issuer"))


def pair_correlation(panel: DataFrame, securities: DataFrame, p: Params = Params()) -> DataFrame:
    """selection_date, sidx, ticker_1 < ticker_2, sector, return_correlation, pair_observations of every same-sector pair
    that is eligible on a month-end with a full formation window before it.

    ``panel`` carries eligible. Pairs meet once per session, in an equi-join on (sector, sidx), and keep running sums;
    a window's moments are the difference of two running sums, so cost doesn't grow with the number of month-ends.
    """
    dims = first_per_ticker(securities)
    rows = log_returns(panel).join(F.broadcast(dims.select("ticker", "sector")), "ticker").select("sector", "sidx", "ticker", "ret", "eligible")
    a = rows.select("sector", "sidx", F.col("ticker").alias("ticker_1"), F.col("ret").alias("x"), F.col("eligible").alias("e1"))
    b = rows.select("sector", "sidx", F.col("ticker").alias("ticker_2"), F.col("ret").alias("y"), F.col("eligible").alias("e2"))
    both = a.join(b, ["sector", "sidx"]).where("ticker_1 < ticker_2")
    seen = F.col("x").isNotNull() & F.col("y").isNotNull()
    terms = {"n": F.lit(1.0), "sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "syy": F.col("y") * F.col("y"), "sxy": F.col("x") * F.col("y")}
    own = Window.partitionBy("ticker_1", "ticker_2").orderBy("sidx")
    sums = both.withColumns({k: F.sum(F.when(seen, v).otherwise(0.0)).over(own) for k, v in terms.items()})
    sums = sums.withColumns({k: F.col(k) - F.lag(k, p.formation).over(own) for k in terms})
    ends = month_ends(panel, p).where(F.col("sidx") >= p.formation)
    at = sums.join(F.broadcast(ends), "sidx").where("e1 and e2")
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    corr = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy))
    corr = F.when(F.col("n") >= p.min_pair_observations, F.round(corr, DECIMALS))
    return at.select("selection_date", "sidx", "ticker_1", "ticker_2", "sector", corr.alias("return_correlation"), F.col("n").cast("long").alias("pair_observations"))


def generate_candidates(panel: DataFrame, securities: DataFrame, p: Params = Params()) -> DataFrame:
    """The strongest partners of every security, either way round, without pairs of one issuer.

    Pairs of one issuer take up partner slots before they go, unless ``exclude_issuer_before_topk``.
    """
    pairs = pair_correlation(panel, securities, p).where(F.col("return_correlation") >= p.min_correlation)
    dims = F.broadcast(first_per_ticker(securities).drop("sector"))
    for i in (1, 2):
        pairs = pairs.join(dims.select(F.col("ticker").alias(f"ticker_{i}"), F.col("sub_industry").alias(f"sub_industry_{i}"), F.col("issuer").alias(f"issuer_{i}")), f"ticker_{i}", "left")
    same_issuer = F.coalesce(F.col("issuer_1") == F.col("issuer_2"), F.lit(False))
    if p.exclude_issuer_before_topk:
        pairs = pairs.where(~same_issuer)
    rows = pairs.withColumn("way", F.explode(F.array(F.struct(F.col("ticker_1").alias("own"), F.col("ticker_2").alias("other")), F.struct(F.col("ticker_2").alias("own"), F.col("ticker_1").alias("other")))))
    order = Window.partitionBy("selection_date", "way.own").orderBy(F.col("return_correlation").desc(), F.col("way.other"))
    top = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= p.max_partners)
    keys = [c for c in pairs.columns if not c.startswith("issuer")]
    return top.where(~same_issuer).select(*keys, F.coalesce(F.col("sub_industry_1") == F.col("sub_industry_2"), F.lit(False)).alias("same_sub_industry")).distinct()


def candidate_summary(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("selection_date").agg(
        F.count(F.lit(1)).alias("candidate_pairs"), F.countDistinct("sector").alias("sectors"), F.median("return_correlation").alias("median_correlation"),
        F.min("return_correlation").alias("minimum_correlation"), F.max("return_correlation").alias("maximum_correlation"), F.count_if("same_sub_industry").alias("same_sub_industry_pairs"),
    )


def rank_in_sector(rows: DataFrame) -> DataFrame:
    """rows with sector_candidate_rank by (same sub-industry, correlation, observations, tickers) per date and sector."""
    order = Window.partitionBy("selection_date", "sector").orderBy(F.col("same_sub_industry").desc(), F.col("return_correlation").desc(), F.col("pair_observations").desc(), "ticker_1", "ticker_2")
    return rows.withColumn("sector_candidate_rank", F.row_number().over(order).cast("long"))


def top_in_sector(rows: DataFrame, cap: int) -> DataFrame:
    return rank_in_sector(rows).where(F.col("sector_candidate_rank") <= cap)


def split_by_issuer(rows: DataFrame, securities: DataFrame) -> DataFrame:
    """rows with issuer_1, issuer_2 and same_issuer (both known and equal)."""
    dims = F.broadcast(first_per_ticker(securities).select("ticker", "issuer"))
    for i in (1, 2):
        rows = rows.join(dims.select(F.col("ticker").alias(f"ticker_{i}"), F.col("issuer").alias(f"issuer_{i}")), f"ticker_{i}", "left")
    return rows.withColumn("same_issuer", F.coalesce(F.col("issuer_1") == F.col("issuer_2"), F.lit(False)))




