"""Functions and tables for spark.sql()."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pairloom.functions.stats import LARGE, SMALL, TAIL, TAIL_TERMS, TAU_MAX, TAU_MIN, TAU_STAR, TERMS

PHI = "(exp(-x * x / 2) / sqrt(2 * pi()))"
SERIES = f"aggregate(sequence(1, {TERMS}), named_struct('term', x, 'total', x), (a, n) -> named_struct('term', a.term * x * x / (2 * n + 1), 'total', a.total + a.term * x * x / (2 * n + 1))).total"
MILLS = f"aggregate(sequence({TAIL_TERMS}, 1, -1), abs(x), (a, n) -> abs(x) + n / a)"


def _poly(coefficients: tuple[float, ...]) -> str:
    return " + ".join(f"{c}D * power(tau, {i})" for i, c in enumerate(coefficients))


#: Name, parameters, result and body; Catalyst inlines them, so no Python runs.
FUNCTIONS = {
    "normal_cdf": ("x DOUBLE", "DOUBLE", f"CASE WHEN x < -{TAIL}D THEN {PHI} / {MILLS} WHEN x > {TAIL}D THEN 1 - {PHI} / {MILLS} ELSE 0.5D + {PHI} * {SERIES} END"),
    "mackinnon_p": ("tau DOUBLE", "DOUBLE", f"CASE WHEN tau > {TAU_MAX}D THEN 1D WHEN tau < {TAU_MIN}D THEN 0D WHEN tau <= {TAU_STAR}D THEN normal_cdf({_poly(SMALL)}) ELSE normal_cdf({_poly(LARGE)}) END"),
    "sorted_known": ("ps ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "array_sort(filter(ps, p -> p IS NOT NULL))"),
    "bh_raw": ("k ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(k, (p, i) -> p * size(k) / (i + 1))"),
    "suffix_min": ("r ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(r, (p, i) -> least(1D, array_min(slice(r, i + 1, size(r)))))"),
    "bh_adjust": ("ps ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(ps, p -> get(suffix_min(bh_raw(sorted_known(ps))), cast(array_position(sorted_known(ps), p) AS int) - 1))"),
}


def register(spark: SparkSession) -> None:
    """normal_cdf(x), mackinnon_p(tau) and bh_adjust(array of p-values, nulls staying in place) for this session."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


def register_views(research, prefix: str = "") -> None:
    """The tables of a Research, its backtest's among them, as temporary views; each is computed when a query reads it."""
    from pairloom.operators import backtest

    tables = {name: getattr(research, name) for name in ("bars", "securities", "quality", "panel", "candidates", "results", "baseline", "events")}
    tables |= {f"backtest_{kind}": backtest.table(research.baseline_backtest, kind) for kind in backtest.KINDS}
    for name, rows in tables.items():
        rows.createOrReplaceTempView(prefix + name)
