"""SQL for DuckDB over the driver's tables: written apart from the DataFrame operators, and in other forms where one exists."""

from __future__ import annotations

from pairloom.plans import oracle_backtest
from pairloom.sources.fixture import CTES as FIXTURE

NUDGE = "3.7e-10"
K = "selection_date, ticker_1, ticker_2"


def r(*names: str) -> str:
    """Doubles of the result: six decimals, infinite ones null, no negative zero; queries.rounded() says why NUDGE."""
    return ", ".join(f"round(CASE WHEN isinf({n}) THEN NULL ELSE {n} END + {NUDGE}, 6) + 0.0 AS {n}" for n in names)


def breach(a: str, op: str, b: str) -> str:
    return f"coalesce({a} {op} {b} AND abs({a} - {b}) > 1e-8 + 1e-6 * abs({b}), false)"


#: The normal distribution: a series, and in the tail, where it cancels, Simpson's rule over exp(-|x| t - t * t / 2).
PHI = (
    "(CASE WHEN {x} < -3 THEN exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * (0.02 / -({x})) / 3 * list_sum(list_transform(range(0, 2001), "
    "lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.02 * i - pow(0.02 * i / ({x}), 2) / 2))) "
    "ELSE 0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * coalesce(sign({x}) * list_sum(list_transform(range(0, 200), "
    "lambda n: exp((2 * n + 1) * ln(nullif(abs({x}), 0)) - lgamma(2 * n + 2) + n * ln(2) + lgamma(n + 1)))), 0) END)"
)


def tau(s: str) -> str:
    det = f"(ll{s} * dd{s} - ld{s} * ld{s})"
    g, f = f"((dd{s} * lv{s} - ld{s} * dv{s}) / {det})", f"((ll{s} * dv{s} - ld{s} * lv{s}) / {det})"
    return f"round({g} / sqrt((vv{s} - {g} * lv{s} - {f} * dv{s}) / (m - 2) * dd{s} / {det}), 8)"


def sums(s: str) -> str:
    l, d, v = f"l{s}", f"(l{s} - k{s})", f"(u{s} - l{s})"
    return ", ".join(f"sum({a} * {b}) AS {n}{s}" for n, a, b in (("ll", l, l), ("ld", l, d), ("dd", d, d), ("lv", l, v), ("dv", d, v), ("vv", v, v)))


def pvalue(t: str) -> str:
    small, large = f"(2.92 + 1.5012 * {t} + 0.039796 * {t} * {t})", f"(2.1945 + 0.64695 * {t} - 0.29198 * {t} * {t} - 0.042377 * {t} * {t} * {t})"
    return f"CASE WHEN {t} > 0.92 THEN 1.0 WHEN {t} < -18.86 THEN 0.0 WHEN {t} <= -2.62 THEN {PHI.format(x=small)} ELSE {PHI.format(x=large)} END"


def bh(p: str, groups: str) -> str:
    """Rank and running minimum need two levels: the first gives raw, the second the minimum."""
    return f"{p} * count({p}) OVER (PARTITION BY {groups}, {p} IS NULL) / row_number() OVER (PARTITION BY {groups}, {p} IS NULL ORDER BY {p}, ticker_1, ticker_2)"


def bh_min(p: str, groups: str) -> str:
    return f"CASE WHEN {p} IS NOT NULL THEN least(1.0, min(raw) OVER (PARTITION BY {groups}, {p} IS NULL ORDER BY {p} DESC, ticker_1 DESC, ticker_2 DESC ROWS UNBOUNDED PRECEDING)) END"


GATES = "coalesce({f} <= 0.1, false) AS passes_fdr, coalesce(round(half_life, 8) BETWEEN 2 AND 60, false) AS passes_half_life, coalesce(round(hedge_ratio, 8) BETWEEN 0.1 AND 10, false) AS passes_hedge_ratio, coalesce(round(spread_std, 8) >= 0.001, false) AS passes_spread_std"
PASSED = "(test_status = 'success' AND passes_fdr AND passes_half_life AND passes_hedge_ratio AND passes_spread_std) AS qualified"
RANK = "row_number() OVER (PARTITION BY selection_date, sector ORDER BY same_sub_industry DESC, return_correlation DESC, pair_observations DESC, ticker_1, ticker_2)"
MONTH = "cast(date_trunc('month', {}) AS date)"


def strongest(pairs: str, k: int) -> str:
    """Pairs that are among the k strongest of either side."""
    return f"""SELECT p.*, s1.sub_industry AS sub_industry_1, s2.sub_industry AS sub_industry_2, coalesce(s1.sub_industry = s2.sub_industry, false) AS same_sub_industry,
        coalesce(s1.cik = s2.cik, false) AS same_issuer
        FROM {pairs} p JOIN securities s1 ON s1.ticker = ticker_1 JOIN securities s2 ON s2.ticker = ticker_2
        WHERE (selection_date, ticker_1, ticker_2) IN (SELECT selection_date, least(own, other), greatest(own, other) FROM (
            SELECT *, row_number() OVER (PARTITION BY selection_date, own ORDER BY return_correlation DESC, other) AS n FROM (
                SELECT selection_date, ticker_1 AS own, ticker_2 AS other, return_correlation FROM {pairs}
                UNION ALL SELECT selection_date, ticker_2, ticker_1, return_correlation FROM {pairs})) WHERE n <= {k})"""


CTES = FIXTURE | {
    "spans": "SELECT ticker, min(session) AS f, max(session) AS l FROM bars GROUP BY 1",
    "seen": "SELECT session, count(DISTINCT ticker) AS observed FROM bars GROUP BY 1",
    "calendar": """SELECT *, observed / active AS coverage FROM (SELECT session, observed, (SELECT count(*) FROM spans WHERE f <= session AND l >= session) AS active FROM seen)
        WHERE observed / active >= 0.25""",
    "expected": "SELECT s.ticker, c.session, b.close IS NOT NULL AS there FROM spans s JOIN calendar c ON c.session BETWEEN f AND l LEFT JOIN bars b ON b.ticker = s.ticker AND b.session = c.session",
    "holes": """SELECT ticker, min(session) AS start, max(session) AS "end", count(*) AS length FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session)
        - row_number() OVER (PARTITION BY ticker, there ORDER BY session) AS g FROM expected) WHERE NOT there GROUP BY ticker, g""",
    "moves": """SELECT *, close / lag(close) OVER w - 1 AS ret, lag(session) OVER w AS previous_session, lag(close) OVER w AS previous_close,
        row_number() OVER (PARTITION BY ticker ORDER BY session DESC) AS back FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY session)""",
    "ruled": f"""SELECT *, {breach('high', '<', 'low')} AS hl, {breach('high', '<', 'greatest(open, close)')} AS ho, {breach('low', '>', 'least(open, close)')} AS lo FROM moves""",
    "record": """SELECT ticker, min(session) AS first_date, max(session) AS last_date, count(*) AS observations, count(*) - count(DISTINCT session) AS duplicate_dates,
        5 * count(*) - count(open) - count(high) - count(low) - count(close) - count(volume) AS missing_ohlcv_values,
        count(*) FILTER (open <= 0) AS nonpositive_open, count(*) FILTER (high <= 0) AS nonpositive_high, count(*) FILTER (low <= 0) AS nonpositive_low, count(*) FILTER (close <= 0) AS nonpositive_close,
        count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (volume = 0) AS zero_volume, count(*) FILTER (hl) AS high_below_low, count(*) FILTER (ho) AS high_below_open_close,
        count(*) FILTER (lo) AS low_above_open_close, count(*) FILTER (abs(ret) > 0.05) AS extreme_return_count, max(abs(ret)) AS maximum_absolute_return,
        median(close) FILTER (back <= 252) AS median_price_recent, median(close * volume) FILTER (back <= 252) AS median_dollar_volume_recent FROM ruled GROUP BY ticker""",
    "quality": """SELECT r.*, expected_observations, missing_observations, missing_observations / expected_observations AS missing_fraction, coalesce(longest, 0) AS maximum_missing_run,
        observations >= 252 AS sufficient_history,
        CASE WHEN duplicate_dates + missing_ohlcv_values + nonpositive_open + nonpositive_high + nonpositive_low + nonpositive_close + negative_volume + high_below_low + high_below_open_close
            + low_above_open_close > 0 THEN 'error'
            WHEN extreme_return_count > 0 OR zero_volume > 0 OR missing_observations / expected_observations > 0.05 THEN 'warning' ELSE 'pass' END AS status
        FROM record r JOIN (SELECT ticker, count(*) AS expected_observations, count(*) FILTER (NOT there) AS missing_observations FROM expected GROUP BY 1) e USING (ticker)
        LEFT JOIN (SELECT ticker, max(length) AS longest FROM holes GROUP BY 1) h USING (ticker)""",
    "repairs": f"""SELECT b.ticker, b.session, {breach('high', '<', 'greatest(open, close)')} AS fix_high, {breach('low', '>', 'least(open, close)')} AS fix_low FROM bars b WHERE ticker NOT IN ('Brand#1', 'Brand#2')""",
    "patched": """SELECT b.*, coalesce(fix_high, false) AS fh, coalesce(fix_low, false) AS fl, greatest(open, high, low, close) AS top, least(open, high, low, close) AS bottom,
        b.ticker IN ('Brand#1', 'Brand#2') AND b.session < s.f + 100 AS dropped, s.f + 100 AS cut FROM bars b JOIN spans s USING (ticker) LEFT JOIN repairs r ON r.ticker = b.ticker AND r.session = b.session""",
    "days": "SELECT session, cast(row_number() OVER (ORDER BY session) - 1 AS int) AS sidx FROM (SELECT DISTINCT session FROM bars)",
    "panel": "SELECT d.session, d.sidx, t.ticker, b.open, b.close, b.volume FROM days d CROSS JOIN (SELECT DISTINCT ticker FROM bars) t LEFT JOIN bars b ON b.session = d.session AND b.ticker = t.ticker",
    "liquid": """SELECT *, count(close) OVER (PARTITION BY ticker ORDER BY sidx) AS history,
        CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY sidx) >= 15 THEN cast(sum(CASE WHEN volume > 0 THEN 1 ELSE 0 END) OVER w AS bigint) END AS positive_days,
        CASE WHEN count(CASE WHEN volume > 0 THEN close END) OVER w >= 15 THEN median(CASE WHEN volume > 0 THEN close * volume END) OVER w END AS median_dollar_volume
        FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY sidx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "elig": "SELECT *, coalesce(close > 0 AND open > 0 AND history >= 252 AND close >= 5 AND volume > 0 AND positive_days >= 15 AND median_dollar_volume >= 30000, false) AS eligible FROM liquid",
    "ends": "SELECT max(session) AS selection_date, max(sidx) AS sidx FROM days GROUP BY date_trunc('month', session) HAVING date_trunc('month', max(session)) < (SELECT date_trunc('month', max(session)) FROM days)",
    "rets": "SELECT ticker, sidx, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY sidx) AS ret FROM panel",
    "corrs": """SELECT e.selection_date, e.sidx, a.ticker AS ticker_1, b.ticker AS ticker_2, s1.sector, CASE WHEN count(x.ret + y.ret) >= 200 THEN round(corr(x.ret, y.ret), 8) END AS return_correlation,
        count(x.ret + y.ret) AS pair_observations
        FROM ends e JOIN elig a ON a.sidx = e.sidx AND a.eligible JOIN elig b ON b.sidx = e.sidx AND b.eligible AND a.ticker < b.ticker
        JOIN securities s1 ON s1.ticker = a.ticker JOIN securities s2 ON s2.ticker = b.ticker AND s2.sector = s1.sector
        JOIN rets x ON x.ticker = a.ticker AND x.sidx BETWEEN e.sidx - 251 AND e.sidx JOIN rets y ON y.ticker = b.ticker AND y.sidx = x.sidx
        WHERE e.sidx >= 252 GROUP BY ALL""",
    "strong": "SELECT * FROM corrs WHERE return_correlation >= 0.5",
    "cand": f"SELECT * EXCLUDE (same_issuer) FROM ({strongest('strong', 10)}) WHERE NOT same_issuer",
    "apart": "SELECT p.* FROM strong p JOIN securities s1 ON s1.ticker = ticker_1 JOIN securities s2 ON s2.ticker = ticker_2 WHERE NOT coalesce(s1.cik = s2.cik, false)",
    "cand2": f"SELECT * EXCLUDE (same_issuer) FROM ({strongest('apart', 2)})",
    "picked": f"SELECT * EXCLUDE (n) FROM (SELECT *, {RANK} AS n FROM cand) WHERE n <= 50",
    "fr": """SELECT c.selection_date, c.ticker_1, c.ticker_2, ln(x.close) AS a, ln(y.close) AS b, row_number() OVER (PARTITION BY c.selection_date, c.ticker_1, c.ticker_2 ORDER BY x.sidx) AS n
        FROM picked c JOIN panel x ON x.ticker = c.ticker_1 AND x.sidx BETWEEN c.sidx - 252 AND c.sidx JOIN panel y ON y.ticker = c.ticker_2 AND y.sidx = x.sidx WHERE x.close > 0 AND y.close > 0""",
    "fit": f"""SELECT {K}, count(*) AS formation_observations, least(stddev_pop(a), stddev_pop(b)) AS dev, regr_slope(a, b) AS b12, regr_intercept(a, b) AS a12, regr_slope(b, a) AS b21, regr_intercept(b, a) AS a21
        FROM fr GROUP BY {K}""",
    "res": f"SELECT fr.*, a - a12 - b12 * b AS u12, b - a21 - b21 * a AS u21 FROM fr JOIN fit USING ({K}) WHERE formation_observations >= 200 AND dev >= 1e-10",
    "lagged": f"SELECT *, lag(u12) OVER w AS l12, lag(u12, 2) OVER w AS k12, lag(u21) OVER w AS l21, lag(u21, 2) OVER w AS k21 FROM res WINDOW w AS (PARTITION BY {K} ORDER BY n)",
    "adf": f"SELECT {K}, {tau('12')} AS tau_12, {tau('21')} AS tau_21 FROM (SELECT {K}, count(*) AS m, {sums('12')}, {sums('21')} FROM lagged WHERE k12 IS NOT NULL GROUP BY {K})",
    "ps": f"SELECT *, {pvalue('tau_12')} AS pvalue_12, {pvalue('tau_21')} AS pvalue_21 FROM adf",
    "chosen": f"""SELECT {K}, tau_12, tau_21, pvalue_12, pvalue_21, greatest(pvalue_12, pvalue_21) AS conservative_pvalue, pvalue_12 <= pvalue_21 AS one,
        CASE WHEN one THEN ticker_1 ELSE ticker_2 END AS dependent_ticker, CASE WHEN one THEN ticker_2 ELSE ticker_1 END AS independent_ticker,
        CASE WHEN one THEN a12 ELSE a21 END AS alpha, CASE WHEN one THEN b12 ELSE b21 END AS hedge_ratio FROM ps JOIN fit USING ({K})""",
    "sp": f"SELECT {K}, n, CASE WHEN one THEN u12 ELSE u21 END AS u, lag(CASE WHEN one THEN u12 ELSE u21 END) OVER (PARTITION BY {K} ORDER BY n) AS l FROM res JOIN chosen USING ({K})",
    "signs": f"SELECT *, CASE WHEN round(u - avg(u) OVER (PARTITION BY {K}), 12) <> 0 THEN sign(u - avg(u) OVER (PARTITION BY {K})) END AS s0 FROM sp",
    "filled": f"""SELECT *, coalesce(last_value(s0 IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY n ROWS UNBOUNDED PRECEDING),
        first_value(s0 IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS s FROM signs""",
    "turned": f"SELECT *, s <> lag(s) OVER (PARTITION BY {K} ORDER BY n) AS turn FROM filled",
    "spread": f"""SELECT {K}, avg(u) AS spread_mean, stddev_samp(u) AS spread_std, regr_slope(u - l, l) AS mean_reversion_coefficient, count(*) FILTER (turn) AS mean_crossings,
        CASE WHEN regr_count(u - l, l) < 20 THEN NULL WHEN regr_slope(u - l, l) >= 0 THEN 'inf'::double ELSE -ln(2) / regr_slope(u - l, l) END AS half_life FROM turned GROUP BY {K}""",
    "tested": f"""SELECT p.*, coalesce(formation_observations, 0) AS formation_observations, tau_12, tau_21, pvalue_12, pvalue_21, conservative_pvalue, dependent_ticker, independent_ticker, alpha, hedge_ratio,
        spread_mean, spread_std, mean_reversion_coefficient, mean_crossings, half_life,
        CASE WHEN coalesce(formation_observations, 0) < 200 THEN 'insufficient_observations' WHEN dev < 1e-10 THEN 'constant_price_series' WHEN conservative_pvalue IS NULL THEN 'invalid_pvalue' ELSE 'success' END AS test_status
        FROM picked p LEFT JOIN fit USING ({K}) LEFT JOIN chosen USING ({K}) LEFT JOIN spread USING ({K})""",
    "adjusted": f"SELECT *, {bh_min('conservative_pvalue', 'selection_date')} AS fdr_pvalue FROM (SELECT *, {bh('conservative_pvalue', 'selection_date')} AS raw FROM tested)",
    "results": f"SELECT *, {PASSED} FROM (SELECT *, {GATES.format(f='fdr_pvalue')} FROM adjusted)",
    "ranked": f"""SELECT t.*, {RANK} AS sector_candidate_rank FROM tested t WHERE NOT coalesce((SELECT cik FROM securities WHERE ticker = ticker_1) = (SELECT cik FROM securities WHERE ticker = ticker_2), false)""",
    "base0": f"SELECT *, {bh_min('conservative_pvalue', 'selection_date')} AS baseline_fdr_pvalue FROM (SELECT *, {bh('conservative_pvalue', 'selection_date')} AS raw FROM ranked WHERE sector_candidate_rank <= 20)",
    "base": f"SELECT *, concat(ticker_1, '__', ticker_2) AS pair_id FROM (SELECT *, {PASSED} FROM (SELECT *, {GATES.format(f='baseline_fdr_pvalue')} FROM base0)) WHERE qualified",
    "caps": "SELECT unnest([10, 20, 30, 50])::int AS candidate_cap",
    "cap0": f"""SELECT *, {bh_min('conservative_pvalue', 'candidate_cap, selection_date')} AS sensitivity_fdr_pvalue FROM (SELECT *, {bh('conservative_pvalue', 'candidate_cap, selection_date')} AS raw
        FROM ranked JOIN caps ON sector_candidate_rank <= candidate_cap)""",
    "capped": f"SELECT *, {PASSED} FROM (SELECT *, {GATES.format(f='sensitivity_fdr_pvalue')} FROM cap0)",
    "monthly": """SELECT candidate_cap, d.selection_date, count(c.ticker_1) AS q FROM caps CROSS JOIN (SELECT DISTINCT selection_date FROM tested) d
        LEFT JOIN (SELECT * FROM capped WHERE qualified) c USING (candidate_cap, selection_date) GROUP BY ALL""",
    "evals": f"""SELECT DISTINCT b.selection_date, d.session, d.sidx FROM base b JOIN days d ON {MONTH.format('d.session')} = cast({MONTH.format('b.selection_date')} + INTERVAL 1 MONTH AS date)
        WHERE {MONTH.format('d.session')} < (SELECT {MONTH.format('max(session)')} FROM days)""",
    "when_": "SELECT * FROM evals UNION ALL SELECT DISTINCT e.selection_date, d.session, d.sidx FROM evals e JOIN days d ON d.session = e.selection_date",
    "zs": """SELECT b.selection_date, b.pair_id, w.session, w.sidx, round((ln(d.close) - alpha - hedge_ratio * ln(i.close) - spread_mean) / spread_std, 8) AS z, coalesce(d.eligible AND i.eligible, false) AS both_eligible
        FROM base b JOIN when_ w USING (selection_date) LEFT JOIN elig d ON d.sidx = w.sidx AND d.ticker = dependent_ticker LEFT JOIN elig i ON i.sidx = w.sidx AND i.ticker = independent_ticker""",
    "sig": """SELECT selection_date, pair_id, arg_min(sidx, sidx) AS ss, arg_min(session, sidx) AS sd, arg_min(z, sidx) AS sz FROM zs
        WHERE abs(z) >= 2 AND both_eligible AND sidx < (SELECT max(sidx) FROM when_ w WHERE w.selection_date = zs.selection_date) GROUP BY ALL""",
    "fwd": """SELECT zs.*, ss, sd, sz, row_number() OVER (PARTITION BY zs.selection_date, zs.pair_id ORDER BY sidx) AS k FROM zs JOIN sig USING (selection_date, pair_id) WHERE sidx > ss AND z IS NOT NULL""",
    "after_": """SELECT selection_date, pair_id, max(k) AS forward_sessions, min(k) FILTER (abs(z) <= 1) AS t1, min(k) FILTER (abs(z) <= 0.5) AS t05, min(k) FILTER (sign(sz) * z <= 0) AS tm,
        max(-sign(sz) * (z - sz)) AS best, min(-sign(sz) * (z - sz)) AS worst, arg_max(z, sidx) AS end_z FROM fwd GROUP BY ALL""",
    "lasts": "SELECT selection_date, pair_id, count(*) FILTER (session > selection_date) AS evaluation_sessions, list(z ORDER BY sidx)[-1] AS raw_end FROM zs GROUP BY ALL",
    "events_": """SELECT l.selection_date, l.pair_id, cast(date_trunc('month', l.selection_date) + INTERVAL 1 MONTH AS date) AS evaluation_month, evaluation_sessions, forward_sessions IS NOT NULL AS entry_triggered,
        sd AS signal_date, CASE WHEN forward_sessions IS NOT NULL THEN (SELECT session FROM days WHERE sidx = ss + 1) END AS entry_evaluation_date, sz AS entry_z_score, coalesce(forward_sessions, 0) AS forward_sessions,
        t1 IS NOT NULL AS touched_abs_z_1, t05 IS NOT NULL AS touched_abs_z_0_5, tm IS NOT NULL AS crossed_mean, t1 AS sessions_to_abs_z_1, t05 AS sessions_to_abs_z_0_5, tm AS sessions_to_mean_crossing,
        best AS maximum_favourable_excursion_z, worst AS maximum_adverse_excursion_z, CASE WHEN sd IS NULL THEN raw_end ELSE end_z END AS end_z_score,
        ticker_1, ticker_2, dependent_ticker, independent_ticker, sector, same_sub_industry, return_correlation, baseline_fdr_pvalue AS fdr_pvalue,
        CASE WHEN forward_sessions IS NULL THEN '' WHEN sz > 0 THEN concat('short_', dependent_ticker, '_long_', independent_ticker) ELSE concat('long_', dependent_ticker, '_short_', independent_ticker) END AS entry_direction
        FROM lasts l JOIN base b USING (selection_date, pair_id) LEFT JOIN sig USING (selection_date, pair_id) LEFT JOIN after_ USING (selection_date, pair_id)""",
}


CTES |= oracle_backtest.CTES


def sql(select: str, **other: str) -> str:
    """The CTEs that the statement needs, in order, and the statement; ``other`` has CTEs in place of those of their names."""
    import re

    needed: set[str] = set()
    ctes = CTES | other

    def visit(text: str) -> None:
        for name in ctes:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(ctes[name])

    visit(select)
    how = {n: "AS MATERIALIZED" for n in oracle_backtest.MATERIALIZED}
    parts = ",\n".join(f"{n} {how.get(n, 'AS')} ({ctes[n]})" for n in ctes if n in needed)
    start = "WITH RECURSIVE" if "bt" in needed else "WITH"
    return f"{start} {parts}\n{select}" if parts else select


RATES = """count(*) FILTER (entry_triggered) AS entry_events, avg(entry_triggered::int) AS entry_frequency, avg(touched_abs_z_1::int) FILTER (entry_triggered) AS touched_abs_z_1_rate,
    avg(touched_abs_z_0_5::int) FILTER (entry_triggered) AS touched_abs_z_0_5_rate, avg(crossed_mean::int) FILTER (entry_triggered) AS mean_crossing_rate,
    median(sessions_to_abs_z_0_5) FILTER (entry_triggered) AS median_sessions_to_abs_z_0_5, median(maximum_favourable_excursion_z) FILTER (entry_triggered) AS median_favourable_excursion_z,
    median(maximum_adverse_excursion_z) FILTER (entry_triggered) AS median_adverse_excursion_z"""
RATE_NAMES = ["entry_frequency", "touched_abs_z_1_rate", "touched_abs_z_0_5_rate", "mean_crossing_rate", "median_sessions_to_abs_z_0_5", "median_favourable_excursion_z", "median_adverse_excursion_z"]
PX = ("open", "high", "low", "close", "volume")
Q = ["missing_fraction", "maximum_absolute_return", "median_price_recent", "median_dollar_volume_recent"]
METRICS = "pair_months_evaluated, entry_events, " + ", ".join(RATE_NAMES) + ", median_entry_abs_z, median_sessions_to_abs_z_1, median_sessions_to_mean_crossing"

SELECTS = {
    "bars": f"SELECT ticker, session, {r(*PX)} FROM bars",
    "reference_calendar": f"SELECT session, observed, active, {r('coverage')} FROM calendar",
    "missing_runs": 'SELECT ticker, start, "end", length FROM holes',
    "security_quality": f"SELECT * REPLACE ({r(*Q)}) FROM quality",
    "quality_summary": """SELECT unnest(['files_checked', 'pass', 'warning', 'error', 'securities_with_252_observations', 'securities_with_structural_errors', 'securities_with_extreme_returns',
        'securities_with_zero_volume', 'reference_trading_days', 'earliest_security_date', 'latest_security_date', 'reference_start', 'reference_end']) AS metric,
        unnest([count(*)::double, (count(*) FILTER (status = 'pass'))::double, (count(*) FILTER (status = 'warning'))::double, (count(*) FILTER (status = 'error'))::double,
        (count(*) FILTER (sufficient_history))::double, (count(*) FILTER (status = 'error'))::double, (count(*) FILTER (extreme_return_count > 0))::double, (count(*) FILTER (zero_volume > 0))::double,
        (SELECT count(*) FROM calendar)::double, NULL, NULL, NULL, NULL]) AS value,
        unnest([NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, min(first_date), max(last_date), (SELECT min(session) FROM calendar), (SELECT max(session) FROM calendar)]) AS day FROM quality""",
    "extreme_returns": f"SELECT ticker, session, previous_session, {r('previous_close', 'close', 'ret')} FROM moves WHERE abs(ret) > 0.05",
    "ohlc_violations": f"""SELECT ticker, session, rule, {r('difference')} FROM (SELECT ticker, session, 'high_below_low' AS rule, low - high AS difference FROM ruled WHERE hl
        UNION ALL SELECT ticker, session, 'high_below_open_close', greatest(open, close) - high FROM ruled WHERE ho UNION ALL SELECT ticker, session, 'low_above_open_close', low - least(open, close) FROM ruled WHERE lo)""",
    "zero_volume_runs": f"""SELECT ticker, start_date, end_date, length, {r('start_close', 'end_close')}, unique_closes FROM (SELECT ticker, min(session) AS start_date, max(session) AS end_date, count(*) AS length,
        arg_min(close, session) AS start_close, arg_max(close, session) AS end_close, count(DISTINCT close) AS unique_closes FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session)
        - row_number() OVER (PARTITION BY ticker, coalesce(volume, 0) = 0 ORDER BY session) AS g FROM bars) WHERE coalesce(volume, 0) = 0 GROUP BY ticker, g)""",
    "download_log": f"""SELECT ticker, status, first_date, last_date, observations, {r('missing_fraction')} FROM (SELECT ticker, 'success' AS status, min(session) AS first_date, max(session) AS last_date, count(*) AS observations,
        (5 * count(*) - count(open) - count(high) - count(low) - count(close) - count(volume)) / (5 * count(*)) AS missing_fraction FROM bars GROUP BY ticker)""",
    "download_batches": "SELECT ticker, (row_number() OVER (ORDER BY ticker) - 1) // 10 AS batch FROM securities",
    "clean_bars": f"""SELECT ticker, session, {r(*PX)} FROM (SELECT ticker, session, open, high, low, CASE WHEN day(session) % 5 = 0 THEN close ELSE close + 1 END AS close, volume FROM bars)""",
    "apply_overrides": f"SELECT ticker, session, {r(*PX)} FROM (SELECT ticker, session, open, CASE WHEN fh THEN top ELSE high END AS high, CASE WHEN fl THEN bottom ELSE low END AS low, close, volume FROM patched WHERE NOT dropped)",
    "override_log": f"""SELECT ticker, action, session, field, {r('old_value', 'new_value')}, rows_affected FROM (
        SELECT ticker, 'truncate_before' AS action, any_value(cut) AS session, NULL::varchar AS field, NULL::double AS old_value, NULL::double AS new_value, count(*) AS rows_affected FROM patched WHERE dropped GROUP BY ticker
        UNION ALL SELECT ticker, 'repair_ohlc', session, 'high', high, top, 1 FROM patched WHERE fh UNION ALL SELECT ticker, 'repair_ohlc', session, 'low', low, bottom, 1 FROM patched WHERE fl)""",
    "universe_difference": "SELECT 'Brand#4' AS ticker, 'missing' AS side UNION ALL SELECT 'Brand#3', 'unexpected'",
    "dense_panel": f"SELECT session, sidx, ticker, {r('open', 'close', 'volume')} FROM panel",
    "eligibility": f"SELECT session, sidx, ticker, history, positive_days, {r('median_dollar_volume')}, eligible FROM elig",
    "universe_coverage": f"""SELECT *, {r('f').replace('AS f', 'AS eligible_fraction')} FROM (SELECT session, count(close) AS available_securities, count(*) FILTER (eligible) AS eligible_securities,
        count(close) - count(*) FILTER (eligible) AS ineligible_securities, count(*) FILTER (eligible) / count(close) AS f FROM elig GROUP BY session)""".replace("SELECT *, round", "SELECT * EXCLUDE (f), round"),
    "month_ends": "SELECT selection_date, sidx FROM ends",
    "pair_correlation": f"SELECT * REPLACE ({r('return_correlation')}) FROM corrs",
    "candidate_pairs": f"SELECT * EXCLUDE (sidx) REPLACE ({r('return_correlation')}) FROM cand",
    "candidate_pairs_issuer_first": f"SELECT * EXCLUDE (sidx) REPLACE ({r('return_correlation')}) FROM cand2",
    "candidate_summary": f"""SELECT selection_date, candidate_pairs, sectors, {r('median_correlation', 'minimum_correlation', 'maximum_correlation')}, same_sub_industry_pairs FROM (SELECT selection_date, count(*) AS candidate_pairs,
        count(DISTINCT sector) AS sectors, median(return_correlation) AS median_correlation, min(return_correlation) AS minimum_correlation, max(return_correlation) AS maximum_correlation,
        count(*) FILTER (same_sub_industry) AS same_sub_industry_pairs FROM cand GROUP BY 1)""",
    "sector_topk": f"SELECT selection_date, sector, ticker_1, ticker_2, n AS sector_candidate_rank FROM (SELECT *, {RANK} AS n FROM cand) WHERE n <= 3",
    "ols_spread": f"SELECT {K}, formation_observations, dependent_ticker, {r('alpha', 'hedge_ratio', 'spread_std')} FROM tested",
    "adf_tau": f"SELECT {K}, {r('tau_12', 'tau_21')} FROM tested",
    "coint_pvalues": f"SELECT {K}, test_status, {r('pvalue_12', 'pvalue_21', 'conservative_pvalue')}, dependent_ticker, independent_ticker FROM tested",
    "half_life": f"SELECT {K}, {r('half_life', 'mean_reversion_coefficient')} FROM tested",
    "mean_crossings": f"SELECT {K}, mean_crossings FROM tested",
    "bh_fdr": f"SELECT {K}, {r('fdr_pvalue')}, passes_fdr, passes_half_life, passes_hedge_ratio, passes_spread_std, qualified FROM results",
    "coint_summary": f"""SELECT selection_date, pairs_tested, successful_tests, qualified_pairs, {r('median_conservative_pvalue', 'median_half_life', 'qualification_rate')} FROM (SELECT selection_date, count(*) AS pairs_tested,
        count(*) FILTER (test_status = 'success') AS successful_tests, count(*) FILTER (qualified) AS qualified_pairs, median(conservative_pvalue) AS median_conservative_pvalue,
        median(half_life) FILTER (NOT isinf(half_life)) AS median_half_life, count(*) FILTER (qualified) / count(*) AS qualification_rate FROM results GROUP BY 1)""",
    "cap_sensitivity": f"""SELECT t.candidate_cap, tests, qualified_snapshots, {r('qualification_rate', 'coverage_fraction', 'median_pairs_all_months', 'mean_pairs_all_months', 'median_half_life', 'median_fdr_pvalue')},
        months_total, months_with_pairs, months_without_pairs, maximum_pairs_month, coalesce(unique_qualified_pairs, 0) AS unique_qualified_pairs, coalesce(two, 0) AS pairs_qualified_2plus_months,
        coalesce(three, 0) AS pairs_qualified_3plus_months
        FROM (SELECT candidate_cap, count(*) AS tests, count(*) FILTER (qualified) AS qualified_snapshots, count(*) FILTER (qualified) / count(*) AS qualification_rate,
            median(half_life) FILTER (qualified) AS median_half_life, median(sensitivity_fdr_pvalue) FILTER (qualified) AS median_fdr_pvalue FROM capped GROUP BY 1) t
        JOIN (SELECT candidate_cap, count(*) AS months_total, count(*) FILTER (q > 0) AS months_with_pairs, count(*) FILTER (q = 0) AS months_without_pairs, count(*) FILTER (q > 0) / count(*) AS coverage_fraction,
            median(q) AS median_pairs_all_months, avg(q) AS mean_pairs_all_months, max(q) AS maximum_pairs_month FROM monthly GROUP BY 1) m USING (candidate_cap)
        LEFT JOIN (SELECT candidate_cap, count(*) AS unique_qualified_pairs, count(*) FILTER (n >= 2) AS two, count(*) FILTER (n >= 3) AS three FROM (SELECT candidate_cap, ticker_1, ticker_2, count(*) AS n FROM capped
            WHERE qualified GROUP BY ALL) GROUP BY 1) p USING (candidate_cap)""",
    "cap_yearly": f"""SELECT candidate_cap, year, months, months_with_pairs, qualified_snapshots, {r('median_pairs')}, maximum_pairs, {r('coverage_fraction')} FROM (SELECT candidate_cap, year(selection_date)::int AS year, count(*) AS months,
        count(*) FILTER (q > 0) AS months_with_pairs, sum(q)::bigint AS qualified_snapshots, median(q) AS median_pairs, max(q) AS maximum_pairs, count(*) FILTER (q > 0) / count(*) AS coverage_fraction FROM monthly GROUP BY ALL)""",
    "pair_recurrence": f"""SELECT candidate_cap, ticker_1, ticker_2, sector, qualified_months, first_qualified, last_qualified, {r('median_half_life', 'median_correlation', 'median_fdr_pvalue')} FROM (SELECT candidate_cap, ticker_1, ticker_2, sector,
        count(DISTINCT selection_date) AS qualified_months, min(selection_date) AS first_qualified, max(selection_date) AS last_qualified, median(half_life) AS median_half_life,
        median(return_correlation) AS median_correlation, median(sensitivity_fdr_pvalue) AS median_fdr_pvalue FROM capped WHERE qualified GROUP BY ALL)""",
    "baseline_pairs": f"SELECT selection_date, pair_id, dependent_ticker, independent_ticker, sector, sector_candidate_rank, {r('baseline_fdr_pvalue', 'hedge_ratio', 'half_life')} FROM base",
    "baseline_summary": f"""SELECT selection_date, qualified_pairs, sectors, {r('median_correlation', 'median_half_life', 'median_fdr_pvalue')}, unique_stocks FROM (SELECT d.selection_date, count(pair_id) AS qualified_pairs,
        count(DISTINCT sector) AS sectors, coalesce(median(return_correlation), 0) AS median_correlation, coalesce(median(half_life), 0) AS median_half_life, coalesce(median(baseline_fdr_pvalue), 0) AS median_fdr_pvalue,
        len(list_distinct(flatten(list([ticker_1, ticker_2])))) AS unique_stocks FROM (SELECT DISTINCT selection_date FROM tested) d LEFT JOIN base USING (selection_date) GROUP BY 1)""",
    "frozen_z": f"SELECT zs.selection_date, pair_id, session, {r('z')}, both_eligible FROM zs WHERE session > selection_date",
    "spread_events": f"SELECT * REPLACE ({r('entry_z_score', 'maximum_favourable_excursion_z', 'maximum_adverse_excursion_z', 'end_z_score', 'return_correlation', 'fdr_pvalue')}) FROM events_",
    "event_by_sector": f"SELECT * REPLACE ({r(*RATE_NAMES)}) FROM (SELECT sector, count(*) AS pair_months, {RATES} FROM events_ GROUP BY sector)",
    "event_summary": f"""SELECT metric, {r('value')} FROM (SELECT COLUMNS(*)::double FROM (SELECT count(*) AS pair_months_evaluated, {RATES}, median(abs(entry_z_score)) FILTER (entry_triggered) AS median_entry_abs_z,
        median(sessions_to_abs_z_1) FILTER (entry_triggered) AS median_sessions_to_abs_z_1, median(sessions_to_mean_crossing) FILTER (entry_triggered) AS median_sessions_to_mean_crossing FROM events_))
        UNPIVOT INCLUDE NULLS (value FOR metric IN ({METRICS}))""",
    "drawdown": f"""SELECT ticker, date, {r('close', 'peak', 'drawdown')} FROM (SELECT ticker, session AS date, close, max(close) OVER w AS peak, close / max(close) OVER w - 1 AS drawdown FROM bars
        WINDOW w AS (PARTITION BY ticker ORDER BY session))""",
    "yearly_returns": f"SELECT ticker, year, {r('annual_return')}, sessions FROM (SELECT ticker, year(session)::int AS year, exp(sum(ln(1 + ret))) - 1 AS annual_return, count(*) AS sessions FROM moves WHERE ret IS NOT NULL GROUP BY ALL)",
    "return_histogram": f"""SELECT bin, {r('low', 'high')}, n FROM (SELECT bin, lo + bin * (hi - lo) / 24 AS low, lo + (bin + 1) * (hi - lo) / 24 AS high, count(*) AS n FROM (SELECT lo, hi, least(floor((ret - lo) / (hi - lo) * 24), 23)::bigint AS bin
        FROM moves, (SELECT min(ret) AS lo, max(ret) AS hi FROM moves) WHERE ret IS NOT NULL) GROUP BY bin, lo, hi)""",
    "best_and_worst_days": f"""SELECT side, place, ticker, session, {r('ret')} FROM (SELECT 'best' AS side, row_number() OVER (ORDER BY round(ret, 8) DESC, ticker, session) AS place, ticker, session, round(ret, 8) AS ret FROM moves WHERE ret IS NOT NULL
        UNION ALL SELECT 'worst', row_number() OVER (ORDER BY round(ret, 8), ticker, session), ticker, session, round(ret, 8) FROM moves WHERE ret IS NOT NULL) WHERE place <= 10""",
    "market_relative": f"""SELECT {r('beta', 'correlation', 'annual_alpha')} FROM (SELECT regr_slope(ret, m) AS beta, corr(ret, m) AS correlation, regr_intercept(ret, m) * 252 AS annual_alpha FROM
        (SELECT session, ret FROM moves WHERE ticker = 'Brand#1') JOIN (SELECT session, c / lag(c) OVER (ORDER BY session) - 1 AS m FROM (SELECT session, median(close) AS c FROM bars GROUP BY 1)) USING (session))""",
    "market_relative_all": f"""SELECT ticker, {r('beta', 'correlation', 'annual_alpha')} FROM (SELECT ticker, regr_slope(ret, m) AS beta, corr(ret, m) AS correlation, regr_intercept(ret, m) * 252 AS annual_alpha FROM
        (SELECT ticker, session, ret FROM moves) JOIN (SELECT session, c / lag(c) OVER (ORDER BY session) - 1 AS m FROM (SELECT session, median(close) AS c FROM bars GROUP BY 1)) USING (session) GROUP BY ticker)""",
    "event_outcomes": f"""SELECT reason, trades, {r('win_rate', 'net_pnl', 'mean_net_return', 'median_holding_sessions')} FROM (SELECT reason, count(*) AS trades, avg((x > 0)::int) AS win_rate, sum(x) AS net_pnl, avg(x) AS mean_net_return,
        median(forward_sessions) AS median_holding_sessions FROM (SELECT *, CASE WHEN touched_abs_z_0_5 THEN 'mean_reversion' WHEN abs(end_z_score) >= 4 THEN 'stop_loss' ELSE 'expiry' END AS reason,
        round(-sign(entry_z_score) * (end_z_score - entry_z_score), 8) AS x FROM events_ WHERE entry_triggered) GROUP BY reason)""",
    "mackinnon_p": f"SELECT tau, {r('pvalue')} FROM (SELECT tau, {pvalue('tau')} AS pvalue FROM (SELECT i / 8.0 - 19.0 AS tau FROM range(0, 161) t(i)))",
}
SELECTS["coint_log_pvalues"] = f"""SELECT {K}, round(ln(nullif(pvalue_12, 0)) + {NUDGE}, 4) + 0.0 AS log_12, round(ln(nullif(pvalue_21, 0)) + {NUDGE}, 4) + 0.0 AS log_21, dependent_ticker,
    round(ln(nullif(fdr_pvalue, 0)) + {NUDGE}, 4) + 0.0 AS log_fdr FROM adjusted"""
SELECTS["mackinnon_p_sql"] = SELECTS["mackinnon_p"]
SELECTS |= {
    "bh_adjust_sql": f"SELECT selection_date, ticker_1, ticker_2, {r('fdr_pvalue')} FROM adjusted",
    "wide_panels": f"SELECT session, ticker, {r('open', 'close', 'volume', 'median_dollar_volume')}, eligible FROM elig",
    "anomaly_events": f"""SELECT ticker, session, anomaly_type, {r('value')} FROM (SELECT ticker, session, 'extreme_return' AS anomaly_type, ret AS value FROM moves WHERE abs(ret) > 0.05
        UNION ALL SELECT ticker, session, 'high_below_low', low - high FROM ruled WHERE hl UNION ALL SELECT ticker, session, 'high_below_open_close', greatest(open, close) - high FROM ruled WHERE ho
        UNION ALL SELECT ticker, session, 'low_above_open_close', low - least(open, close) FROM ruled WHERE lo) WHERE ticker IN (SELECT ticker FROM quality WHERE status <> 'pass')""",
    "latest_log": f"""SELECT s.ticker, CASE WHEN b.ticker IS NULL THEN 'failed' ELSE 'success' END AS status, first_date, last_date, coalesce(observations, 0) AS observations, {r('missing_fraction')}
        FROM securities s LEFT JOIN (SELECT ticker, min(session) AS first_date, max(session) AS last_date, count(*) AS observations,
            (5 * count(*) - count(open) - count(high) - count(low) - count(close) - count(volume)) / (5 * count(*)) AS missing_fraction FROM bars WHERE ticker <> 'Brand#4' GROUP BY ticker) b USING (ticker)""",
    "figure_equity": f"SELECT date, {r('net_equity', 'drawdown')} FROM (SELECT date, net_equity, fall AS drawdown FROM bret)",
    "figure_attribution": f"""SELECT exit_reason, {r('gross_pnl', 'execution_cost', 'borrow_cost', 'net_pnl')} FROM (SELECT exit_reason, sum(gross_pnl) AS gross_pnl, sum(execution_cost) AS execution_cost,
        sum(borrow_cost) AS borrow_cost, sum(net_pnl) AS net_pnl FROM btr GROUP BY 1)""",
    "figure_entry_scatter": f"SELECT pair_id, entry_date, {r('entry_z_score', 'net_return')} FROM btr",
    "figure_holding_scatter": f"SELECT pair_id, entry_date, holding_sessions, {r('net_return')} FROM btr",
}
SELECTS |= oracle_backtest.selects(r)
ORACLE = {name: sql(select) for name, select in SELECTS.items()} | {"backtest_scenarios": sql(SELECTS["backtest_scenarios"], prm=oracle_backtest.GRID)}
