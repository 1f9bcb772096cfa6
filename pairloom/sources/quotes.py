"""A Spark data source over a quote function, with batches of tickers and linear back-off.

``fetch(tickers, start, end)`` returns rows (ticker, session, open, high, low, close, volume); tickers
without rows in their batch, because it failed or lacks them, are tried again one by one, and so are empty answers.
There is no network in tests, which pass a function of their own.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pairloom.schemas import BARS


LOG = "ticker string, status string, method string, observations long, error string"


class Batch(InputPartition):
    def __init__(self, tickers: list[str]):
        self.tickers = tickers


class QuoteReader(DataSourceReader):
    def __init__(self, options: dict):
        module, _, name = options["fetch"].partition(":")
        self.module, self.name = module, name
        self.tickers = [t for t in options["tickers"].split(",") if t]
        self.size, self.retries, self.wait = int(options.get("batch", 25)), int(options.get("retries", 3)), float(options.get("wait", 5))
        self.log = options.get("log", "false").lower() == "true"
        self.start, self.end = options.get("start", "2000-01-01"), options.get("end")

    def partitions(self) -> list[Batch]:
        return [Batch(self.tickers[i : i + self.size]) for i in range(0, len(self.tickers), self.size)]

    def attempts(self, part: Batch) -> Iterator[tuple[list[tuple], tuple]]:
        """For each ticker its rows and its line of the log: ticker, status, method, observations, error."""
        fetch = getattr(importlib.import_module(self.module), self.name)
        error = None
        try:
            rows = list(fetch(part.tickers, self.start, self.end))
        except Exception as problem:  # the whole batch: each ticker is tried by itself
            if self.retries < 1:
                raise
            rows, error = [], f"batch: {problem}"
        for ticker in part.tickers:
            mine, method = [r for r in rows if r[0] == ticker], "batch"
            for attempt in range(1, self.retries + 1):
                if mine:
                    break
                method = "single"
                try:
                    mine, error = list(fetch([ticker], self.start, self.end)), "no rows"
                except Exception as problem:  # the log keeps what the last attempt said
                    error = f"{type(problem).__name__}: {problem}"
                if not mine:
                    time.sleep(self.wait * attempt if attempt < self.retries else 0)
            yield mine, (ticker, "success" if mine else "failed", method, len(mine), None if mine else error or "no rows")

    def read(self, part: Batch) -> Iterator[tuple]:
        for rows, line in self.attempts(part):
            if self.log:
                yield line
            else:
                yield from rows


class Quotes(DataSource):
    """spark.read.format("quotes").options(fetch="module:function", tickers="A,B").load()

    With log="true" the rows are the download log: every ticker with its status, how it came, and the error of the last
    attempt, so that what failed never drops out silently.
    """

    @classmethod
    def name(cls) -> str:
        return "quotes"

    def schema(self) -> str:
        return LOG if self.options.get("log", "false").lower() == "true" else BARS

    def reader(self, schema) -> DataSourceReader:
        return QuoteReader({k.lower(): v for k, v in self.options.items()})
