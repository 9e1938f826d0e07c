"""Chunks of time: work on one long symbol that many tasks share.

A symbol's rows are cut into chunks of equal time. What looks back a bounded number of slots gets
the rows it looks back on from the chunks before (a halo); what remembers everything is a state
that a chunk changes by a small map, and the maps of the chunks are composed in order, one row a
chunk. No window, group or task holds a whole symbol.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR, micros

#: Slots of a chunk.
LENGTH = 4096


def in_chunk() -> WindowSpec:
    """Rows of a segment within a chunk and its halo, in time order."""
    return Window.partitionBy("symbol", "segment", "chunk").orderBy("open_time")


def with_halo(bars: DataFrame, slots: int, length: int = LENGTH, step_us: int = HOUR) -> DataFrame:
    """``bars`` with chunk and own: each row in its chunk (own), and again in chunks that begin within ``slots`` after it.

    A window over the last ``slots`` + 1 rows of a segment sees the same rows in each of its chunks.
    """
    d = bars.withColumn("_place", F.floor(micros("open_time") / F.lit(step_us)).cast("long")).withColumn("_home", F.expr(f"floor(_place / {length})").cast("long"))
    d = d.withColumn("chunk", F.explode(F.sequence("_home", F.expr(f"floor((_place + {slots}) / {length})").cast("long"))))
    return d.withColumn("own", F.col("chunk") == F.col("_home")).drop("_place", "_home")


def segment_numbers(bars: DataFrame, length: int = LENGTH, step_us: int = HOUR) -> DataFrame:
    """``bars`` with segment (from 0 in each symbol, new after every gap) and row (from 0 in each segment).

    Numbers are given within chunks; a table with one row a chunk then tells each chunk how many
    segments stand before it, whether it goes on with the last of them, and at which row.
    """
    us = micros("open_time")
    key = ["symbol", "_chunk"]
    d = bars.withColumn("_chunk", F.floor(us / F.lit(length * step_us)).cast("long"))
    inside = Window.partitionBy(*key).orderBy("open_time")
    d = d.withColumn("_part", F.sum(F.when(us - F.lag(us).over(inside) == step_us, 0).otherwise(1)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_place", F.row_number().over(Window.partitionBy(*key, "_part").orderBy("open_time")) - 1)
    ends = d.groupBy(*key).agg(F.min(us).alias("first"), F.max(us).alias("last"), F.max("_part").alias("parts"), F.max(F.struct("_part", "_place"))["_place"].alias("tail"))
    chain = Window.partitionBy("symbol").orderBy("_chunk")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.coalesce(F.col("first") - F.lag("last").over(chain) == step_us, F.lit(False))
    ends = ends.withColumn("_on", goes_on.cast("int"))
    ends = ends.withColumn("_island", F.sum(F.when((F.col("_on") == 1) & (F.col("parts") == 1), 0).otherwise(1)).over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = F.sum(F.col("tail") + 1).over(Window.partitionBy("symbol", "_island").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("_so_far", so_far).select(*key, (F.coalesce(F.sum(F.col("parts") - F.col("_on")).over(before), F.lit(0)) - F.col("_on")).alias("_base"), F.when(F.col("_on") == 1, F.lag("_so_far").over(chain)).otherwise(0).alias("_carried"))
    d = d.join(ends, key)
    row = F.col("_place") + F.when(F.col("_part") == 1, F.col("_carried")).otherwise(0)
    return d.withColumns({"segment": (F.col("_base") + F.col("_part") - 1).cast("long"), "row": row.cast("long")}).drop("_chunk", "_part", "_place", "_base", "_carried")


def scanned(maps: DataFrame, start: Callable[[], Any], after: Callable[[Any, dict], Any], schema: str) -> DataFrame:
    """(symbol, chunk, state): what the maps of all earlier chunks of a symbol make of ``start``.

    ``maps`` has one row a chunk; ``after`` applies a row of it to a state, in order of time. Where
    the chunk just before is missing, a chunk starts anew.
    """

    def fold(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("chunk")
        state, last, out = start(), None, []
        for m in d.to_dict("records"):
            if last is None or m["chunk"] != last + 1:
                state = start()
            out.append(state)
            state, last = after(state, m), m["chunk"]
        return pd.DataFrame({"symbol": d["symbol"], "chunk": d["chunk"], "state": pd.Series(out, index=d.index, dtype=object)})

    return maps.groupBy("symbol").applyInPandas(fold, f"symbol string, chunk long, state {schema}")
