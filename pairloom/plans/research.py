"""The stages chained over a bar table and a securities table; each property is a lazy DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from pairloom.operators import backtest, candidates, clean, cointegration, events, panel, quality
from pairloom.params import Params


class Research:
    """Bars and securities in, every stage's table out.

    ``keep`` is applied to the tables that several stages read (panel, candidates, test results, events, backtest):
    identity by default; sources.scratch.keep writes them to the shared folder, which also keeps plans short.
    """

    def __init__(self, bars: DataFrame, securities: DataFrame, params: Params = Params(), keep=lambda df, name: df):
        self.bars, self.securities, self.p, self.keep = bars, securities, params, keep

    @cached_property
    def calendar(self) -> DataFrame:
        return quality.reference_calendar(self.bars, self.p)

    @cached_property
    def quality(self) -> DataFrame:
        return quality.security_quality(self.bars, self.calendar, self.p)

    @cached_property
    def cleaned(self) -> DataFrame:
        return clean.clean(self.bars)

    @cached_property
    def panel(self) -> DataFrame:
        return self.keep(panel.eligibility(panel.dense_panel(self.cleaned), self.p), "panel")

    @cached_property
    def coverage(self) -> DataFrame:
        return panel.universe_coverage(self.panel)

    @cached_property
    def month_ends(self) -> DataFrame:
        return panel.month_ends(self.panel, self.p)

    @cached_property
    def candidates(self) -> DataFrame:
        return self.keep(candidates.generate_candidates(self.panel, self.securities, self.p), "candidates")

    @cached_property
    def tested(self) -> DataFrame:
        picked = candidates.top_in_sector(self.candidates, self.p.test_cap).drop("sector_candidate_rank")
        return self.keep(cointegration.test_pairs(picked, self.panel, self.p), "tested")

    @cached_property
    def results(self) -> DataFrame:
        return cointegration.qualify(self.tested, self.p)

    @cached_property
    def selection_dates(self) -> DataFrame:
        return self.tested.select("selection_date").distinct()

    @cached_property
    def by_cap(self) -> DataFrame:
        return self.keep(cointegration.by_cap(self.tested, self.securities, self.p), "by_cap")

    @cached_property
    def baseline(self) -> DataFrame:
        return self.keep(cointegration.baseline_pairs(self.tested, self.securities, self.p), "baseline")

    @cached_property
    def events(self) -> DataFrame:
        return self.keep(events.spread_events(self.baseline, self.panel, self.p), "events")

    @cached_property
    def baseline_backtest(self) -> DataFrame:
        return self.keep(self.backtest(), "backtest")

    def backtest(self, scenarios: dict[str, Params] | None = None) -> DataFrame:
        return backtest.backtest(self.baseline, self.panel, scenarios or {"baseline": self.p})
