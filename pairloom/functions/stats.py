"""Statistical expressions: normal distribution, cointegration p-values, multiple testing."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# MacKinnon (1994) response surface for two series with a constant.
TAU_MAX, TAU_MIN, TAU_STAR = 0.92, -18.86, -2.62
SMALL = (2.92, 1.5012, 0.039796)
LARGE = (2.1945, 0.64695, -0.29198, -0.042377)
#: Terms of the series, enough between the tails, and of the continued fraction beyond TAIL.
TERMS, TAIL, TAIL_TERMS = 60, 3.0, 60


def normal_cdf(x: Column) -> Column:
    """Built-in functions only. Between the tails 1/2 + phi(x) * sum of x^(2n+1) / (1 * 3 * .. * (2n+1)); in them the
    continued fraction phi(x) / (|x| + 1/(|x| + 2/(|x| + ..))), which keeps its relative accuracy however small it gets."""
    phi = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)

    def step(a: Column, n: Column) -> Column:
        term = a["term"] * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.struct(x.alias("term"), x.alias("total")), step)["total"]
    size = F.abs(x)
    tail = phi / F.aggregate(F.sequence(F.lit(TAIL_TERMS), F.lit(1), F.lit(-1)), size, lambda a, n: size + n / a)
    return F.when(x < -TAIL, tail).when(x > TAIL, 1 - tail).otherwise(0.5 + phi * series)


def _poly(t: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * t + c
    return out


def mackinnon_p(tau: Column) -> Column:
    """p-value of an Engle-Granger statistic; minus infinity gives 0, null stays null."""
    inner = F.greatest(F.lit(TAU_MIN), F.least(F.lit(TAU_MAX), tau))
    x = F.when(tau <= TAU_STAR, _poly(inner, SMALL)).otherwise(_poly(inner, LARGE))
    return F.when(tau.isNull(), F.lit(None).cast("double")).when(tau > TAU_MAX, 1.0).when(tau < TAU_MIN, 0.0).otherwise(normal_cdf(x))


def benjamini_hochberg(p: Column, groups: list[str], tie: list[str]) -> Column:
    """Adjusted p-value among the non-null p of each group."""
    known = p.isNotNull()
    parts = [*map(F.col, groups), known]
    up = Window.partitionBy(*parts).orderBy(p.asc(), *[F.col(t).asc() for t in tie])
    down = Window.partitionBy(*parts).orderBy(p.desc(), *[F.col(t).desc() for t in tie]).rowsBetween(Window.unboundedPreceding, 0)
    raw = p * F.count(p).over(Window.partitionBy(*parts)) / F.row_number().over(up)
    return F.when(known, F.least(F.lit(1.0), F.min(raw).over(down)))
