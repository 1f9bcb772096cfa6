"""The backtest as one recursive query for DuckDB: a row per session and scenario, whose lists hold the open positions."""

from __future__ import annotations

SIGNAL = "STRUCT(nz DOUBLE, fdr DOUBLE, pid VARCHAR, dep VARCHAR, ind VARCHAR, sector VARCHAR, sel DATE, alpha DOUBLE, beta DOUBLE, mean DOUBLE, std DOUBLE, z DOUBLE, day DATE)"
POSITION = f"STRUCT(pid VARCHAR, s {SIGNAL}, since DATE, na DOUBLE, nb DOUBLE, pa DOUBLE, pb DOUBLE, paid DOUBLE, held BIGINT, fee DOUBLE, best DOUBLE, worst DOUBLE, z DOUBLE, why VARCHAR, whyd DATE)"
LEAVING = f"STRUCT(h {POSITION}, oa DOUBLE, ob DOUBLE, reason VARCHAR, sd DATE)"
STEP = f"STRUCT(cash DOUBLE, ex DOUBLE, pos {POSITION}[], s {SIGNAL})"


def total(items: str, value: str) -> str:
    return f"coalesce(list_sum(list_transform({items}, lambda h: {value})), 0.0)"


def worth(prices: str) -> str:
    """A position's value, zero if a leg has no price."""
    return f"coalesce(h.na * {prices}[h.s.dep] + h.nb * {prices}[h.s.ind], 0.0)"


def size(prices: str) -> str:
    return f"coalesce(abs(h.na) * {prices}[h.s.dep], 0.0) + coalesce(abs(h.nb) * {prices}[h.s.ind], 0.0)"


def busy(positions: str, s: str) -> str:
    legs = f"flatten(list_transform({positions}, lambda h: [h.s.dep, h.s.ind]))"
    return f"list_has_any({legs}, [{s}.dep, {s}.ind])"


EXIT_COST = "0.001 * (abs(h.h.na) * h.oa + abs(h.h.nb) * h.ob)"
ROOM = f"least(0.2 * (a.cash + {total('a.pos', worth('o'))}), a.cash + {total('a.pos', worth('o'))} - {total('a.pos', size('o'))})"
UNIT = "(1 + abs(x.s.beta))"
BOUGHT = f"""{{'pid': x.s.pid, 's': x.s, 'since': session, 'na': -sign(x.s.z) * g / {UNIT} / o[x.s.dep], 'nb': sign(x.s.z) * x.s.beta * g / {UNIT} / o[x.s.ind],
    'pa': o[x.s.dep], 'pb': o[x.s.ind], 'paid': g * 0.001, 'held': 0, 'fee': 0.0, 'best': 0.0, 'worst': 0.0, 'z': x.s.z, 'why': NULL, 'whyd': NULL}}::{POSITION}"""
#: A position's borrow of a day, and its z at a close.
FEE = "(greatest(coalesce(-h.na * c[h.s.dep], 0.0), 0.0) + greatest(coalesce(-h.nb * c[h.s.ind], 0.0), 0.0)) * 0.03 / 252"
Z = "CASE WHEN h.s.std > 0 THEN (ln(c[h.s.dep]) - h.s.alpha - h.s.beta * ln(c[h.s.ind]) - h.s.mean) / h.s.std END"
MOVE = "sign(h.s.z) * (h.s.z - h.z)"
WHY = "CASE WHEN h.z IS NULL THEN 'data_failure' WHEN abs(h.z) <= 0.5 THEN 'mean_reversion' WHEN abs(h.z) >= sz THEN 'stop_loss' WHEN h.held >= mh THEN 'maximum_holding_period' ELSE h.why END"


def changed(positions: str, **fields: str) -> str:
    """Positions with some fields computed anew from the old ones."""
    names = "pid s since na nb pa pb paid held fee best worst z why whyd".split()
    inner = ", ".join(f"'{n}': {fields.get(n, 'h.' + n)}" for n in names)
    return f"list_transform({positions}, lambda h: {{{inner}}}::{POSITION})"


PHASES = [
    # the day and what is due at its open
    """SELECT b.scenario, b.ez, b.sz, b.mh, d.j, d.session, d.nm, d.o, d.c, d.el, d.sg, d.un, b.cash, b.ex, b.bo, b.pos, b.wait, CASE WHEN b.nm = d.nm THEN b.spent ELSE [] END AS spent, b.session AS before
        FROM bt b JOIN bin_ d ON d.j = b.j + 1""",
    f"""SELECT *, list_transform(list_filter(pos, lambda h: (h.why IS NOT NULL OR NOT list_contains(un, h.pid)) AND o[h.s.dep] IS NOT NULL AND o[h.s.ind] IS NOT NULL),
        lambda h: {{'h': h, 'oa': o[h.s.dep], 'ob': o[h.s.ind], 'reason': coalesce(h.why, 'qualification_expiry'), 'sd': CASE WHEN h.why IS NULL THEN coalesce(before, session) ELSE h.whyd END}}::{LEAVING}) AS due FROM ({{}})""",
    f"""SELECT * EXCLUDE (cash, ex, pos), cash + {total('due', f'h.h.na * h.oa + h.h.nb * h.ob - {EXIT_COST}')} AS cash, ex + {total('due', EXIT_COST)} AS ex,
        list_filter(pos, lambda h: NOT list_contains(list_transform(due, lambda x: x.h.pid), h.pid)) AS pos FROM ({{}})""",
    # entries, one after the other
    f"""SELECT * EXCLUDE (cash, ex, pos, wait), list_reduce(list_transform(list_sort(wait), lambda s: {{'cash': 0.0, 'ex': 0.0, 'pos': []::{POSITION}[], 's': s}}::{STEP}),
        lambda a, x: list_transform([CASE WHEN len(a.pos) < 5 AND list_contains(un, x.s.pid) AND list_has_all(el, [x.s.dep, x.s.ind]) AND o[x.s.dep] IS NOT NULL AND o[x.s.ind] IS NOT NULL
            AND NOT {busy('a.pos', 'x.s')} THEN {ROOM} ELSE 0.0 END], lambda g: CASE WHEN g > 0 THEN {{'cash': a.cash + sign(x.s.z) * g / {UNIT} * (1 - x.s.beta) - g * 0.001, 'ex': a.ex + g * 0.001,
            'pos': list_append(a.pos, {BOUGHT}), 's': NULL}}::{STEP} ELSE a END)[1],
        {{'cash': cash, 'ex': ex, 'pos': pos, 's': NULL}}::{STEP}) AS e FROM ({{}})""",
    # the close
    f"SELECT * EXCLUDE (e, bo), e.cash - {total('e.pos', FEE)} AS cash, e.ex AS ex, bo + {total('e.pos', FEE)} AS bo, {changed('e.pos', held='h.held + 1', fee=f'h.fee + {FEE}', z=Z)} AS pos FROM ({{}})",
    f"SELECT * REPLACE ({changed('pos', best=f'greatest(h.best, coalesce({MOVE}, h.best))', worst=f'least(h.worst, coalesce({MOVE}, h.worst))', why=WHY)} AS pos) FROM ({{}})",
    f"SELECT * REPLACE ({changed('pos', whyd='CASE WHEN h.why IS NOT NULL THEN session END')} AS pos) FROM ({{}})",
    # triggers: what was inside may signal again; what signals is spent
    "SELECT * REPLACE (list_filter(spent, lambda n: NOT list_contains(list_transform(list_filter(sg, lambda s: abs(s.z) < ez), lambda s: s.pid), n)) AS spent) FROM ({})",
    f"SELECT *, list_filter(sg, lambda s: abs(s.z) >= ez AND abs(s.z) < sz AND NOT list_contains(spent, s.pid) AND list_has_all(el, [s.dep, s.ind]) AND NOT {busy('pos', 's')}) AS wait FROM ({{}})",
    "SELECT scenario, ez, sz, mh, j, session, nm, cash, ex, bo, pos, wait, list_concat(spent, list_transform(wait, lambda s: s.pid)) AS spent, due, "
    f"cash + {total('pos', worth('c'))} AS nav, {total('pos', size('c'))} AS gross, {total('pos', 'coalesce(h.na * c[h.s.dep], 0.0) + coalesce(h.nb * c[h.s.ind], 0.0)')} AS net FROM ({{}})",
]


def recursion() -> str:
    step = PHASES[0]
    for phase in PHASES[1:]:
        step = phase.replace("({})", f"({step})")
    return f"""SELECT scenario, ez, sz, mh, 0::BIGINT AS j, NULL::DATE AS session, NULL::DATE AS nm, 1.0::DOUBLE AS cash, 0.0::DOUBLE AS ex, 0.0::DOUBLE AS bo, []::{POSITION}[] AS pos, []::{SIGNAL}[] AS wait,
        []::VARCHAR[] AS spent, []::{LEAVING}[] AS due, 1.0::DOUBLE AS nav, 0.0::DOUBLE AS gross, 0.0::DOUBLE AS net FROM prm
        UNION ALL {step}"""


MONTH = "cast(date_trunc('month', {}) AS date)"
#: In order; bin_ is read in every step, so it must be computed once.
CTES = {
    "buniv": f"SELECT *, cast({MONTH.format('selection_date')} + INTERVAL 1 MONTH AS date) AS um FROM base",
    "bdays": f"""SELECT *, row_number() OVER (ORDER BY session) AS j FROM (SELECT session, sidx, {MONTH.format('session')} AS m, {MONTH.format('lead(session) OVER (ORDER BY session)')} AS nm FROM days)
        WHERE m >= (SELECT min(um) FROM buniv)""",
    "bquotes": """SELECT session, map(list(ticker ORDER BY ticker) FILTER (open > 0), list(open ORDER BY ticker) FILTER (open > 0)) AS o, map(list(ticker ORDER BY ticker) FILTER (close > 0),
        list(close ORDER BY ticker) FILTER (close > 0)) AS c, list(ticker) FILTER (eligible) AS el FROM elig GROUP BY session""",
    "bsignals": f"""SELECT session, list({{'nz': -abs(z), 'fdr': baseline_fdr_pvalue, 'pid': pair_id, 'dep': dependent_ticker, 'ind': independent_ticker, 'sector': sector, 'sel': selection_date, 'alpha': alpha,
        'beta': hedge_ratio, 'mean': spread_mean, 'std': spread_std, 'z': z, 'day': session}}::{SIGNAL}) FILTER (z IS NOT NULL) AS sg
        FROM (SELECT d.session, b.*, CASE WHEN spread_std > 0 THEN round((ln(x.close) - alpha - hedge_ratio * ln(y.close) - spread_mean) / spread_std, 8) END AS z FROM bdays d JOIN buniv b ON b.um = d.nm
            JOIN elig x ON x.sidx = d.sidx AND x.ticker = dependent_ticker AND x.close > 0 JOIN elig y ON y.sidx = d.sidx AND y.ticker = independent_ticker AND y.close > 0) GROUP BY session""",
    "blisted": "SELECT um, list(pair_id) AS un FROM buniv GROUP BY um",
    "bin_": f"""SELECT d.j, d.session, coalesce(d.nm, DATE '9999-01-01') AS nm, o, c, coalesce(el, []) AS el, coalesce(sg, []::{SIGNAL}[]) AS sg, coalesce(un, []) AS un
        FROM bdays d LEFT JOIN bquotes q ON q.session = d.session LEFT JOIN bsignals s ON s.session = d.session LEFT JOIN blisted l ON l.um = d.m""",
    "prm": "SELECT 'baseline' AS scenario, 2.0::DOUBLE AS ez, 4.0::DOUBLE AS sz, 20 AS mh",
    "bt": recursion(),
    "btr": """SELECT scenario, h.pid AS pair_id, h.s.sector AS sector, h.s.dep AS ticker_a, h.s.ind AS ticker_b, h.s.sel AS selection_date, h.s.day AS signal_date, h.since AS entry_date, x.sd AS exit_signal_date,
        session AS exit_date, h.pa AS entry_price_a, h.pb AS entry_price_b, x.oa AS exit_price_a, x.ob AS exit_price_b, h.s.alpha AS alpha, h.s.beta AS hedge_ratio, h.s.mean AS spread_mean, h.s.std AS spread_std,
        h.s.z AS entry_z_score, h.z AS exit_z_score, x.reason AS exit_reason, h.held AS holding_sessions, abs(h.na) * h.pa + abs(h.nb) * h.pb AS entry_gross,
        h.na * (x.oa - h.pa) + h.nb * (x.ob - h.pb) AS gross_pnl, h.paid + 0.001 * (abs(h.na) * x.oa + abs(h.nb) * x.ob) AS execution_cost, h.fee AS borrow_cost,
        h.na * (x.oa - h.pa) + h.nb * (x.ob - h.pb) - h.paid - 0.001 * (abs(h.na) * x.oa + abs(h.nb) * x.ob) - h.fee AS net_pnl, h.best AS maximum_favourable_excursion_z, h.worst AS maximum_adverse_excursion_z,
        h.na * h.pa + h.nb * h.pb AS entry_net_cash_flow, gross_pnl / entry_gross AS gross_return, net_pnl / entry_gross AS net_return, h.na AS na, h.nb AS nb
        FROM (SELECT scenario, session, x, x.h AS h FROM (SELECT scenario, session, unnest(due) AS x FROM bt))""",
    "bpo": "SELECT scenario, session, unnest(pos) AS h FROM bt",
    "bor": """SELECT scenario, date, pair_id, ticker, CASE WHEN n > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(n) AS shares, price, reason, 0.001 * abs(n) * price AS cost FROM (
        SELECT scenario, exit_date AS date, pair_id, unnest([ticker_a, ticker_b]) AS ticker, unnest([-na, -nb]) AS n, unnest([exit_price_a, exit_price_b]) AS price, exit_reason AS reason FROM btr
        UNION ALL SELECT scenario, session, h.pid, unnest([h.s.dep, h.s.ind]), unnest([h.na, h.nb]), unnest([h.pa, h.pb]), 'entry' FROM bpo WHERE h.since = session)""",
    "beq": """SELECT scenario, session AS date, nav AS net_equity, cash, CASE WHEN nav > 0 THEN gross / nav END AS gross_exposure, CASE WHEN nav > 0 THEN net / nav END AS net_exposure, len(pos) AS active_pairs,
        ex AS cumulative_execution_cost, bo AS cumulative_borrow_cost, gross AS gross_market_value, net AS net_market_value FROM bt WHERE j > 0""",
    "bret": "SELECT *, net_equity / lag(net_equity) OVER (ORDER BY date) - 1 AS ret, net_equity / max(net_equity) OVER (ORDER BY date) - 1 AS fall FROM beq",
}
MATERIALIZED = {"bin_", "bt", "btr", "beq"}


def selects(r) -> dict[str, str]:
    """The registered queries over those tables; r() rounds doubles."""
    trade = "entry_price_a entry_price_b exit_price_a exit_price_b alpha hedge_ratio spread_mean spread_std entry_z_score exit_z_score entry_gross gross_pnl execution_cost borrow_cost net_pnl gross_return net_return maximum_favourable_excursion_z maximum_adverse_excursion_z entry_net_cash_flow".split()
    outcome = """count(*) AS trades, avg((net_pnl > 0)::int) AS win_rate, sum(net_pnl) AS net_pnl, avg(net_return) AS mean_net_return, median(holding_sessions) AS median_holding_sessions FROM btr"""
    outcomes = r("win_rate", "net_pnl", "mean_net_return", "median_holding_sessions")
    metric = "maximum_drawdown total_return average_gross_exposure maximum_gross_exposure average_net_exposure fraction_days_invested win_rate profit_factor median_holding_sessions total_execution_cost total_borrow_cost annualized_return annualized_volatility sharpe_ratio sortino_ratio calmar_ratio".split()
    return {
        "backtest_trades": f"SELECT * EXCLUDE (scenario, na, nb) REPLACE ({r(*trade)}) FROM btr",
        "backtest_orders": f"SELECT * EXCLUDE (scenario) REPLACE ({r('shares', 'price', 'cost')}) FROM bor",
        "backtest_equity": f"SELECT date, active_pairs, {r('net_equity', 'cash', 'gross_exposure', 'net_exposure', 'cumulative_execution_cost', 'cumulative_borrow_cost')} FROM beq",
        "backtest_exposure": f"SELECT date, active_pairs, {r('gross_market_value', 'net_market_value', 'gross_exposure', 'net_exposure')} FROM beq",
        "backtest_positions": f"""SELECT date, pair_id, ticker_a, ticker_b, {r('shares_a', 'shares_b', 'z_score')}, sessions_held FROM (SELECT session AS date, h.pid AS pair_id, h.s.dep AS ticker_a, h.s.ind AS ticker_b,
            h.na AS shares_a, h.nb AS shares_b, h.z AS z_score, h.held AS sessions_held FROM bpo)""",
        "backtest_metrics": f"""SELECT start_date, end_date, open_positions_at_end, trade_count, {r(*metric)} FROM (SELECT *, CASE WHEN n > 0 AND total_return > -1 THEN pow(1 + total_return, 252.0 / n) - 1 END AS annualized_return,
            dev * sqrt(252) AS annualized_volatility, CASE WHEN dev > 0 THEN mu / dev * sqrt(252) END AS sharpe_ratio, CASE WHEN down > 0 THEN mu / down * sqrt(252) END AS sortino_ratio,
            CASE WHEN maximum_drawdown < 0 THEN annualized_return / -maximum_drawdown END AS calmar_ratio
            FROM (SELECT min(date) AS start_date, max(date) AS end_date, count(ret) AS n, avg(ret) AS mu, stddev_samp(ret) AS dev, stddev_samp(ret) FILTER (ret < 0) AS down,
                arg_max(net_equity, date) / arg_min(net_equity, date) - 1 AS total_return, avg(gross_exposure) AS average_gross_exposure, max(gross_exposure) AS maximum_gross_exposure,
                avg(net_exposure) AS average_net_exposure, avg((active_pairs > 0)::int) AS fraction_days_invested, arg_max(active_pairs, date) AS open_positions_at_end, min(fall) AS maximum_drawdown FROM bret),
            (SELECT count(*) AS trade_count, avg((net_pnl > 0)::int) AS win_rate, coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0) / nullif(-sum(net_pnl) FILTER (net_pnl < 0), 0) AS profit_factor,
                median(holding_sessions) AS median_holding_sessions, coalesce(sum(execution_cost), 0) AS total_execution_cost, coalesce(sum(borrow_cost), 0) AS total_borrow_cost FROM btr))""",
        "portfolio_relative": f"""SELECT {r('beta', 'correlation', 'annual_alpha')} FROM (SELECT regr_slope(ret, m) AS beta, corr(ret, m) AS correlation, regr_intercept(ret, m) * 252 AS annual_alpha FROM bret
            JOIN (SELECT session AS date, c / lag(c) OVER (ORDER BY session) - 1 AS m FROM (SELECT session, median(close) AS c FROM bars GROUP BY 1)) USING (date))""",
        "backtest_validation": f"""SELECT "check", passed, {r('detail')} FROM (
            SELECT 'trade_pnl_reconciles' AS "check", abs(sum(gross_pnl) - sum(execution_cost) - sum(borrow_cost) - sum(net_pnl)) <= 1e-10 AS passed, abs(sum(gross_pnl) - sum(execution_cost) - sum(borrow_cost) - sum(net_pnl)) AS detail FROM btr
            UNION ALL SELECT 'entry_after_signal', count(*) = 0, count(*) FROM btr WHERE entry_date <= signal_date UNION ALL SELECT 'exit_after_signal', count(*) = 0, count(*) FROM btr WHERE exit_date <= exit_signal_date
            UNION ALL SELECT 'entry_inside_stop', count(*) = 0, count(*) FROM btr WHERE abs(entry_z_score) >= 4
            UNION ALL SELECT 'no_concurrent_ticker', count(*) = 0, count(*) FROM (SELECT DISTINCT a.pair_id, a.entry_date, t FROM (SELECT *, unnest([ticker_a, ticker_b]) AS t FROM btr) a
                JOIN (SELECT pair_id AS p, entry_date AS e, exit_date AS x, unnest([ticker_a, ticker_b]) AS u FROM btr) b ON a.t = b.u AND (p, e) <> (a.pair_id, a.entry_date) AND e < a.entry_date AND x > a.entry_date)
            UNION ALL SELECT 'maximum_pairs', max(active_pairs) <= 5, max(active_pairs) FROM beq)""",
        "backtest_exit_reasons": f"SELECT exit_reason, trades, {outcomes} FROM (SELECT exit_reason, {outcome} GROUP BY exit_reason)",
        "backtest_sectors": f"SELECT sector, trades, {outcomes} FROM (SELECT sector, {outcome} GROUP BY sector)",
        "backtest_yearly": f"""SELECT year, {r('annual_return')}, sessions FROM (SELECT year(date)::int AS year, arg_max(net_equity, date) / coalesce(any_value(prior), 1.0) - 1 AS annual_return, count(*) AS sessions FROM
            (SELECT date, net_equity, first_value(before) OVER (PARTITION BY year(date) ORDER BY date) AS prior FROM (SELECT date, net_equity, lag(net_equity) OVER (ORDER BY date) AS before FROM beq)) GROUP BY 1)""",
        "backtest_best_and_worst": f"""SELECT * EXCLUDE (scenario, na, nb) REPLACE ({r(*trade)}) FROM (SELECT *, 'best' AS side, row_number() OVER (ORDER BY net_pnl DESC, entry_date, pair_id) AS place FROM btr
            UNION ALL SELECT *, 'worst', row_number() OVER (ORDER BY net_pnl, entry_date, pair_id) FROM btr) WHERE place <= 10""",
        "backtest_turnover": f"""SELECT year, {r('turnover')} FROM (SELECT year, coalesce(traded / mean_equity, 0) AS turnover FROM (SELECT year(date)::int AS year, avg(net_equity) AS mean_equity FROM beq GROUP BY 1)
            LEFT JOIN (SELECT year(date)::int AS year, sum(shares * price) AS traded FROM bor GROUP BY 1) USING (year))""",
        "backtest_tail_losses": f"""SELECT {r('share')}, {r('lim').replace(' AS lim', ' AS "limit"')}, {r('mean_beyond')} FROM (SELECT share, lim, avg(net_return) AS mean_beyond FROM
            (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE AS share, unnest(quantile_cont(net_return, [0.01, 0.05, 0.1])) AS lim FROM btr) JOIN btr ON net_return <= lim GROUP BY ALL)""",
        "backtest_legs": f"""SELECT side, {r('gross_pnl')} FROM (SELECT CASE WHEN n > 0 THEN 'long' ELSE 'short' END AS side, sum(n * (b - a)) AS gross_pnl FROM
            (SELECT unnest([na, nb]) AS n, unnest([entry_price_a, entry_price_b]) AS a, unnest([exit_price_a, exit_price_b]) AS b FROM btr) GROUP BY 1)""",
        "backtest_scenarios": f"""SELECT scenario, {r('final_equity')}, most_pairs, {r('execution_cost')} FROM (SELECT scenario, arg_max(net_equity, date) AS final_equity, max(active_pairs) AS most_pairs,
            arg_max(cumulative_execution_cost, date) AS execution_cost FROM beq GROUP BY scenario)""",
    }


GRID = """SELECT concat('entry', e, '_stop', s, '_hold', h) AS scenario, e::DOUBLE AS ez, s::DOUBLE AS sz, h AS mh
    FROM (SELECT unnest(['1.5', '2.0', '2.5']) AS e), (SELECT unnest(['3.0', '4.0']) AS s), (SELECT unnest([10, 20]) AS h)"""
