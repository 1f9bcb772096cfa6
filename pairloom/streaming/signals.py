"""Entry signals of pairs over a stream of z-scores, with one armed flag per pair and month as state.

Input: pair_id, month date, session date, z double, eligible boolean, and an event time. Rows of a trigger are put in
session order; a session at or before the last one seen is late and ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairloom.params import Params

OUTPUT = "pair_id string, month date, session date, z double"
STATE = "armed boolean, last date"


def arm(rows: pd.DataFrame, armed: bool, last, p: Params = Params()) -> tuple[list, bool, object]:
    """Signals of a pair's rows, the flag after them and the last session seen.

    A spread inside the entry boundary arms the pair; an armed pair signals between entry and stop and is then disarmed;
    a spread beyond the stop leaves the flag as it is.
    """
    out = []
    for r in rows.sort_values("session").itertuples():
        if last is not None and r.session <= last:
            continue
        last = r.session
        if r.z is None or pd.isna(r.z):
            continue
        if abs(r.z) < p.entry_z:
            armed = True
        elif armed and r.eligible and abs(r.z) < p.stop_z:
            out.append((r.session, float(r.z)))
            armed = False
    return out, armed, last


def entry_signals(z: DataFrame, event_time: str = "ts", delay: str = "7 days", p: Params = Params()) -> DataFrame:
    """pair_id, month, session, z of each first touch; state of a month goes when the watermark passes its last row."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        armed, last = state.get if state.exists else (True, None)
        found, armed, last = arm(pd.concat(list(frames)), armed, last, p)
        state.update((armed, last))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(last).timestamp() * 1000), state.getCurrentWatermarkMs()) + 40 * 86_400_000)
        yield pd.DataFrame([(key[0], key[1], *x) for x in found], columns=["pair_id", "month", "session", "z"])

    rows = z.withWatermark(event_time, delay).withColumn("month", F.trunc("session", "MM")) if "month" not in z.columns else z.withWatermark(event_time, delay)
    return rows.groupBy("pair_id", "month").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
