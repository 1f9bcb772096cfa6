"""Bidirectional Engle-Granger tests, half-lives, qualification and cap sensitivity (Engle & Granger 1987, Dickey &
Fuller 1979, MacKinnon 1994, Benjamini & Hochberg 1995), as grouped sums over the formation windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.scalars import pair_id, ratio, valid_price
from pairloom.functions.stats import benjamini_hochberg, mackinnon_p
from pairloom.operators.candidates import DECIMALS, split_by_issuer, top_in_sector
from pairloom.params import Params

KEYS = ["selection_date", "ticker_1", "ticker_2"]


def formation_rows(pairs: DataFrame, panel: DataFrame, p: Params = Params()) -> DataFrame:
    """selection_date, ticker_1, ticker_2, n (place among surviving rows), a, b (log prices): the formation + 1 sessions up
    to the selection date with both prices. Windows are spelled out as ordinals, so both joins are equi-joins."""
    price = panel.select("sidx", "ticker", F.when(valid_price(F.col("close")), F.ln("close")).alias("v")).where("v is not null")
    wide = pairs.select(*KEYS, F.explode(F.sequence(F.col("sidx") - p.formation, F.col("sidx"))).alias("sidx"))
    wide = wide.join(price.withColumnsRenamed({"ticker": "ticker_1", "v": "a"}), ["sidx", "ticker_1"]).join(price.withColumnsRenamed({"ticker": "ticker_2", "v": "b"}), ["sidx", "ticker_2"])
    return wide.withColumn("n", F.row_number().over(Window.partitionBy(*KEYS).orderBy("sidx")))


def _tau(s: str) -> Column:
    """t-statistic of the level in v = gamma * l + phi * d, from sums; minus infinity for a perfect fit."""
    c = lambda k: F.col(f"{k}_{s}")
    det = c("ll") * c("dd") - c("ld") * c("ld")
    gamma = F.try_divide(c("dd") * c("lv") - c("ld") * c("dv"), det)
    phi = F.try_divide(c("ll") * c("dv") - c("ld") * c("lv"), det)
    s2 = F.try_divide(c("vv") - gamma * c("lv") - phi * c("dv"), c("m") - 2)
    var = s2 * F.try_divide(c("dd"), det)
    return F.when(var > 1e-30, gamma / F.sqrt(var)).when(gamma < 0, F.lit(-math.inf))


def pair_statistics(rows: DataFrame) -> DataFrame:
    """Per pair, for both directions (12: ticker_1 on ticker_2): regression, tau with one lagged difference and no
    constant, spread mean and deviation, reversion slope and mean crossings.

    One shuffle: every window and the final sums share the pair's partitioning.
    """
    every, own = Window.partitionBy(*KEYS), Window.partitionBy(*KEYS).orderBy("n")
    fits = {
        "formation_observations": F.count(F.lit(1)), "dev_1": F.stddev_pop("a"), "dev_2": F.stddev_pop("b"),
        "beta_12": F.regr_slope("a", "b"), "alpha_12": F.regr_intercept("a", "b"), "beta_21": F.regr_slope("b", "a"), "alpha_21": F.regr_intercept("b", "a"),
    }
    u = rows.withColumns({k: v.over(every) for k, v in fits.items()})
    u = u.withColumns({"u_12": F.col("a") - F.col("alpha_12") - F.col("beta_12") * F.col("b"), "u_21": F.col("b") - F.col("alpha_21") - F.col("beta_21") * F.col("a")})
    ways = ("12", "21")
    u = u.withColumns({f"l_{s}": F.lag(f"u_{s}").over(own) for s in ways} | {f"k_{s}": F.lag(f"u_{s}", 2).over(own) for s in ways} | {f"c_{s}": F.round(F.col(f"u_{s}") - F.avg(f"u_{s}").over(every), 12) for s in ways})
    # The sign of the centred spread; zeros take the last sign, and leading zeros the next.
    u = u.withColumns({f"s_{s}": F.last(F.when(F.col(f"c_{s}") != 0, F.signum(f"c_{s}")), ignorenulls=True).over(own) for s in ways})
    u = u.withColumns({f"t_{s}": F.coalesce(f"s_{s}", F.first(f"s_{s}", ignorenulls=True).over(own.rowsBetween(0, Window.unboundedFollowing))) for s in ways})
    u = u.withColumns({f"turn_{s}": F.col(f"t_{s}") != F.lag(f"t_{s}").over(own) for s in ways})
    sums = [F.any_value(k).alias(k) for k in fits]
    for s in ways:
        x, lv = F.col(f"u_{s}"), F.col(f"l_{s}")
        dv, vv, known = lv - F.col(f"k_{s}"), x - lv, F.col(f"k_{s}").isNotNull()
        terms = {"ll": lv * lv, "ld": lv * dv, "dd": dv * dv, "lv": lv * vv, "dv": dv * vv, "vv": vv * vv}
        sums += [F.sum(F.when(known, v)).alias(f"{k}_{s}") for k, v in terms.items()]
        sums += [
            F.count_if(known).alias(f"m_{s}"), F.avg(x).alias(f"mean_{s}"), F.stddev_samp(x).alias(f"std_{s}"), F.regr_count(vv, lv).alias(f"steps_{s}"),
            F.regr_slope(vv, lv).alias(f"slope_{s}"), F.count_if(f"turn_{s}").alias(f"crossings_{s}"),
        ]
    out = u.groupBy(*KEYS).agg(*sums)
    return out.withColumns({f"tau_{s}": _tau(s) for s in ways})


def test_pairs(pairs: DataFrame, panel: DataFrame, p: Params = Params()) -> DataFrame:
    """pairs with test_status, statistics of both directions, the chosen direction and its spread's parameters.

    Too few common sessions, a constant series and a statistic that can't be computed have statuses of their own, and
    null statistics. The smaller p-value's direction is chosen, ticker_1 on ticker_2 in a tie.
    """
    stats = pair_statistics(formation_rows(pairs, panel, p))
    good = (F.col("formation_observations") >= p.min_pair_observations) & (F.least("dev_1", "dev_2") >= 1e-10)
    stats = stats.withColumns({f"tau_{s}": F.when(good, F.round(f"tau_{s}", DECIMALS)) for s in ("12", "21")})
    stats = stats.withColumns({f"pvalue_{s}": mackinnon_p(F.col(f"tau_{s}")) for s in ("12", "21")})
    valid = F.col("pvalue_12").isNotNull() & F.col("pvalue_21").isNotNull()
    one = F.col("pvalue_12") <= F.col("pvalue_21")
    pick = lambda k: F.when(valid & one, F.col(f"{k}_12")).when(valid, F.col(f"{k}_21"))
    slope = pick("slope")
    life = F.when(pick("steps") < 20, None).when(slope >= 0, F.lit(math.inf)).otherwise(-math.log(2) / slope)
    stats = stats.select(
        *KEYS, "formation_observations", "dev_1", "dev_2", *[F.when(valid, F.col(f"{k}_{s}")).alias(f"{k}_{s}") for k in ("tau", "pvalue") for s in ("12", "21")],
        F.when(valid, F.greatest("pvalue_12", "pvalue_21")).alias("conservative_pvalue"), pick("pvalue").alias("chosen_pvalue"), pick("tau").alias("chosen_tau"),
        F.when(valid, F.when(one, "12").otherwise("21")).alias("direction"), F.when(valid, F.when(one, F.col("ticker_1")).otherwise(F.col("ticker_2"))).alias("dependent_ticker"),
        F.when(valid, F.when(one, F.col("ticker_2")).otherwise(F.col("ticker_1"))).alias("independent_ticker"), pick("alpha").alias("alpha"), pick("beta").alias("hedge_ratio"),
        pick("mean").alias("spread_mean"), pick("std").alias("spread_std"), slope.alias("mean_reversion_coefficient"), pick("crossings").alias("mean_crossings"), F.when(valid, life).alias("half_life"),
    )
    out = pairs.join(stats, KEYS, "left").withColumn("formation_observations", F.coalesce("formation_observations", F.lit(0)).cast("long"))
    status = (
        F.when(F.col("formation_observations") < p.min_pair_observations, "insufficient_observations")
        .when(F.least("dev_1", "dev_2") < 1e-10, "constant_price_series").when(F.col("conservative_pvalue").isNull(), "invalid_pvalue").otherwise("success")
    )
    return out.withColumn("test_status", status).drop("dev_1", "dev_2")


def qualify(rows: DataFrame, p: Params = Params(), groups: tuple[str, ...] = ("selection_date",), fdr_column: str = "fdr_pvalue") -> DataFrame:
    """rows with the adjusted p-value of their group, the gates and qualified."""
    rows = rows.withColumn(fdr_column, benjamini_hochberg(F.col("conservative_pvalue"), list(groups), ["ticker_1", "ticker_2"]))
    gate = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumns({
        "passes_fdr": gate(F.col(fdr_column) <= p.fdr), "passes_half_life": gate(F.round("half_life", DECIMALS).between(*p.half_life)),
        "passes_hedge_ratio": gate(F.round("hedge_ratio", DECIMALS).between(*p.hedge_ratio)), "passes_spread_std": gate(F.round("spread_std", DECIMALS) >= p.min_spread_std),
    })
    ok = (F.col("test_status") == "success") & F.col("passes_fdr") & F.col("passes_half_life") & F.col("passes_hedge_ratio") & F.col("passes_spread_std")
    return rows.withColumn("qualified", ok)


def _finite_median(c: str) -> Column:
    return F.median(F.when(~F.isnan(c) & (F.abs(c) != math.inf), F.col(c)))


def test_summary(results: DataFrame) -> DataFrame:
    out = results.groupBy("selection_date").agg(
        F.count(F.lit(1)).alias("pairs_tested"), F.count_if(F.col("test_status") == "success").alias("successful_tests"), F.count_if("qualified").alias("qualified_pairs"),
        F.median("conservative_pvalue").alias("median_conservative_pvalue"), _finite_median("half_life").alias("median_half_life"),
    )
    return out.withColumn("qualification_rate", ratio(F.col("qualified_pairs"), F.col("pairs_tested")))


def baseline_pairs(results: DataFrame, securities: DataFrame, p: Params = Params()) -> DataFrame:
    """Qualified pairs under the baseline cap: one issuer's pairs go first, then the cap, then the adjustment."""
    rows = split_by_issuer(results, securities).where("not same_issuer")
    rows = qualify(top_in_sector(rows, p.baseline_cap), p, fdr_column="baseline_fdr_pvalue").where("qualified")
    return rows.withColumn("pair_id", pair_id(F.col("ticker_1"), F.col("ticker_2")))


def by_cap(results: DataFrame, securities: DataFrame, p: Params = Params()) -> DataFrame:
    """results once per candidate cap, qualified anew under each: one pass over the exploded caps."""
    ranked = top_in_sector(split_by_issuer(results, securities).where("not same_issuer"), max(p.sensitivity_caps))
    caps = F.explode(F.array(*[F.lit(c) for c in p.sensitivity_caps])).alias("candidate_cap")
    rows = ranked.select("*", caps).where("sector_candidate_rank <= candidate_cap")
    return qualify(rows, p, ("candidate_cap", "selection_date"), "sensitivity_fdr_pvalue")


def _per_month(rows: DataFrame, dates: DataFrame, p: Params) -> DataFrame:
    """candidate_cap, selection_date, qualified_pairs with zeros for empty months."""
    caps = dates.select("selection_date", F.explode(F.array(*[F.lit(c) for c in p.sensitivity_caps])).alias("candidate_cap"))
    counted = rows.where("qualified").groupBy("candidate_cap", "selection_date").agg(F.count(F.lit(1)).alias("qualified_pairs"))
    return caps.join(counted, ["candidate_cap", "selection_date"], "left").withColumn("qualified_pairs", F.coalesce("qualified_pairs", F.lit(0)))


def cap_sensitivity(rows: DataFrame, dates: DataFrame, p: Params = Params()) -> DataFrame:
    """A summary row per cap; rows as by_cap() gives them, dates: every selection_date."""
    good = rows.where("qualified")
    tests = rows.groupBy("candidate_cap").agg(F.count(F.lit(1)).alias("tests"), F.count_if("qualified").alias("qualified_snapshots"))
    months = _per_month(rows, dates, p).groupBy("candidate_cap").agg(
        F.count(F.lit(1)).alias("months_total"), F.count_if(F.col("qualified_pairs") > 0).alias("months_with_pairs"), F.count_if(F.col("qualified_pairs") == 0).alias("months_without_pairs"),
        F.median("qualified_pairs").alias("median_pairs_all_months"), F.avg("qualified_pairs").alias("mean_pairs_all_months"), F.max("qualified_pairs").alias("maximum_pairs_month"),
    )
    pairs = good.groupBy("candidate_cap", "ticker_1", "ticker_2").agg(F.count(F.lit(1)).alias("n")).groupBy("candidate_cap").agg(
        F.count(F.lit(1)).alias("unique_qualified_pairs"), F.count_if(F.col("n") >= 2).alias("pairs_qualified_2plus_months"), F.count_if(F.col("n") >= 3).alias("pairs_qualified_3plus_months")
    )
    medians = good.groupBy("candidate_cap").agg(F.median("half_life").alias("median_half_life"), F.median("sensitivity_fdr_pvalue").alias("median_fdr_pvalue"))
    out = tests.join(months, "candidate_cap").join(pairs, "candidate_cap", "left").join(medians, "candidate_cap", "left")
    out = out.withColumns({"qualification_rate": ratio(F.col("qualified_snapshots"), F.col("tests")), "coverage_fraction": ratio(F.col("months_with_pairs"), F.col("months_total"))})
    return out.fillna(0, ["unique_qualified_pairs", "pairs_qualified_2plus_months", "pairs_qualified_3plus_months"])


def cap_yearly(rows: DataFrame, dates: DataFrame, p: Params = Params()) -> DataFrame:
    out = _per_month(rows, dates, p).groupBy("candidate_cap", F.year("selection_date").alias("year")).agg(
        F.count(F.lit(1)).alias("months"), F.count_if(F.col("qualified_pairs") > 0).alias("months_with_pairs"), F.sum("qualified_pairs").alias("qualified_snapshots"),
        F.median("qualified_pairs").alias("median_pairs"), F.max("qualified_pairs").alias("maximum_pairs"),
    )
    return out.withColumn("coverage_fraction", ratio(F.col("months_with_pairs"), F.col("months")))


def pair_recurrence(rows: DataFrame) -> DataFrame:
    return rows.where("qualified").groupBy("candidate_cap", "ticker_1", "ticker_2", "sector").agg(
        F.countDistinct("selection_date").alias("qualified_months"), F.min("selection_date").alias("first_qualified"), F.max("selection_date").alias("last_qualified"),
        F.median("half_life").alias("median_half_life"), F.median("return_correlation").alias("median_correlation"), F.median("sensitivity_fdr_pvalue").alias("median_fdr_pvalue"),
    )


def baseline_summary(baseline: DataFrame, dates: DataFrame) -> DataFrame:
    """Per selection date, zeros where there are no pairs; unique_stocks counts both sides."""
    stocks = baseline.select("selection_date", F.explode(F.array("ticker_1", "ticker_2")).alias("t")).groupBy("selection_date").agg(F.countDistinct("t").alias("unique_stocks"))
    rows = baseline.groupBy("selection_date").agg(
        F.count(F.lit(1)).alias("qualified_pairs"), F.countDistinct("sector").alias("sectors"), F.median("return_correlation").alias("median_correlation"),
        F.median("half_life").alias("median_half_life"), F.median("baseline_fdr_pvalue").alias("median_fdr_pvalue"),
    )
    out = dates.select("selection_date").join(rows, "selection_date", "left").join(stocks, "selection_date", "left")
    return out.fillna(0, [c for c in out.columns if c != "selection_date"])
