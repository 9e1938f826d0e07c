"""Stateful fold of an ordered stream of five-minute bars into exact hours.

The state of a symbol is its open hour. A bar of a later hour closes it, exactly once: with all
twelve slots it is a complete hour, else it is reported with the number of slots it had. Bars must
come in order of time; one that does not, or a slot that comes twice, raises. Checkpoints make a
restarted stream go on from its last committed batch, so replayed input gives the same hours.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.expressions import HOUR
from tidemark.operators.rollup import PER_HOUR, SLOT
from tidemark.shipping import ship_package

OUT = "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, volume double, slots int, complete boolean"
STATE = "hour long, last long, open double, high double, low double, close double, volume double, slots int"


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hours that the bars of one symbol close; the open hour stays in the state."""
    hour, last, o, h, lo, c, v, slots = state.get if state.exists else (None, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
    closed = []
    rows = pd.concat(list(batches))
    times = (rows["open_time"].to_numpy("datetime64[us]").astype("int64")).tolist()
    for at, x in zip(times, rows[["open", "high", "low", "close", "volume"]].to_numpy(float).tolist()):
        if last is not None and at <= last:
            raise ValueError(f"bars of {key[0]} are out of order: {at} after {last}")
        if at % SLOT:
            raise ValueError(f"a bar of {key[0]} off the grid: {at}")
        if hour is not None and at // HOUR != hour:
            closed.append((key[0], pd.Timestamp(hour * HOUR, unit="us"), o, h, lo, c, v, slots, slots == PER_HOUR))
            hour = None
        if hour is None:
            hour, o, h, lo, v, slots = at // HOUR, x[0], x[1], x[2], 0.0, 0
        h, lo, c, v, slots, last = max(h, x[1]), min(lo, x[2]), x[3], v + x[4], slots + 1, at
    if hour is not None:
        state.update((hour, last, o, h, lo, c, v, slots))
    yield pd.DataFrame(closed, columns=["symbol", "open_time", "open", "high", "low", "close", "volume", "slots", "complete"])


def ordered_hours(bars: DataFrame) -> DataFrame:
    """Append-mode hours of a stream (symbol, open_time, open, high, low, close, volume) in order of time."""
    ship_package(bars.sparkSession)
    return bars.groupBy("symbol").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
