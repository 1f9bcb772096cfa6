import datetime as dt
from collections import Counter

from pairloom.sources.quotes import Batch, QuoteReader

CALLS = Counter()


def throttled(tickers, start, end):
    """A batch lacks C and D without failing; by itself D comes at the second try and C at none."""
    CALLS[tuple(tickers)] += 1
    have = [t for t in tickers if t in "AB"] if len(tickers) > 1 else tickers if tickers == ["D"] and CALLS["D",] == 2 else []
    return [(t, dt.date(2020, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0) for t in have]


def test_tickers_without_rows_are_retried():
    CALLS.clear()
    reader = QuoteReader({"fetch": f"{__name__}:throttled", "tickers": "A,B,C,D", "retries": "3", "wait": "0"})
    assert [r[0] for r in reader.read(Batch(["A", "B", "C", "D"]))] == ["A", "B", "D"]
    assert CALLS == {("A", "B", "C", "D"): 1, ("C",): 3, ("D",): 2}
