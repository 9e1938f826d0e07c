"""Gap-free segments, grids and gap reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR, from_micros, micros
from tidemark.operators.chunks import LENGTH, segment_numbers
from tidemark.staging import staged


def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("open_time")


def consecutive(lag: int, step_us: int = HOUR, time: str = "open_time", over: WindowSpec | None = None) -> Column:
    """Whether the row ``lag`` rows before stands exactly ``lag`` steps earlier."""
    return micros(time) - F.lag(micros(time), lag).over(over or by_time()) == lag * step_us


def segments(bars: DataFrame, step_us: int = HOUR, length: int = LENGTH) -> DataFrame:
    """``bars`` (staged) with segment (from 0 in each symbol, new after every gap) and row (from 0 in each segment).

    Numbering reads the bars twice, so they are written first and not made twice.
    """
    return segment_numbers(staged(bars, "bars"), length, step_us)


def segment_lengths(bars: DataFrame) -> DataFrame:
    return segments(bars).groupBy("symbol", "segment").agg(F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time"), F.count("*").alias("bars"))


def grid_gaps(bars: DataFrame, step_us: int) -> DataFrame:
    """Maximal runs of missing slots between a symbol's first and last bar, with an ISO duration in minutes.

    The runs follow from neighbouring observed slots, so the grid itself is never built.
    """
    before = F.lag(micros("open_time")).over(by_time())
    d = bars.select("symbol", "open_time").distinct().select("symbol", micros("open_time").alias("us"), before.alias("before"))
    gaps = d.filter(F.col("us") - F.col("before") > step_us).withColumn("missing", F.expr(f"(us - before) div {step_us} - 1"))
    return gaps.select("symbol", from_micros(F.col("before") + step_us).alias("gap_start"), from_micros(F.col("us") - step_us).alias("gap_end"), "missing", F.format_string("PT%dM", F.expr(f"missing * {step_us} div 60000000")).alias("duration"))


def missing_slots(bars: DataFrame, step_us: int) -> DataFrame:
    """Every missing slot of the grid: the spine without the observed slots."""
    span = bars.groupBy("symbol").agg(F.min(micros("open_time")).alias("a"), F.max(micros("open_time")).alias("b"))
    spine = span.select("symbol", F.explode(F.sequence("a", "b", F.lit(step_us))).alias("us"))
    return spine.select("symbol", from_micros(F.col("us")).alias("slot")).join(bars.select("symbol", F.col("open_time").alias("slot")), ["symbol", "slot"], "left_anti")


def time_gaps(bars: DataFrame, expected_us: int | None = None) -> DataFrame:
    """Rows after a step longer than expected; the expected step of a symbol is its most frequent one unless given."""
    d = bars.select("symbol", "open_time").distinct().withColumn("step", micros("open_time") - F.lag(micros("open_time")).over(by_time())).filter("step > 0")
    if expected_us is None:
        counted = d.groupBy("symbol", "step").count()
        usual = counted.groupBy("symbol").agg(F.max_by("step", F.struct("count", -F.col("step"))).alias("expected"))
        d = d.join(usual, "symbol")
    else:
        d = d.withColumn("expected", F.lit(expected_us))
    return d.filter("step > expected").select("symbol", "open_time", F.expr("step div 60000000").alias("step_minutes"), F.expr("expected div 60000000").alias("expected_minutes"), F.expr("step div expected - 1").alias("missing"))


def nearest_grid(times: DataFrame, step_us: int) -> DataFrame:
    """(symbol, t) off the grid: its nearest slot, the signed offset, and what stands there.

    Statuses in order: TIE, OUTSIDE_EXPECTED_GRID, COLLIDES_WITH_EXISTING_GRID,
    AMBIGUOUS_SHARED_TARGET, UNIQUE_MISSING_GRID. Times that lie on the grid are not returned.
    """
    us = times.select("symbol", micros("t").alias("us"))
    edges = us.groupBy("symbol").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    rest = F.pmod("us", F.lit(step_us))
    d = us.withColumn("rest", rest).filter("rest <> 0").withColumn("tie", F.col("rest") * 2 == step_us)
    d = d.withColumn("target", F.when(F.col("rest") * 2 <= step_us, F.col("us") - F.col("rest")).otherwise(F.col("us") - F.col("rest") + step_us))
    on_grid = us.filter(rest == 0).select("symbol", F.col("us").alias("target"), F.lit(True).alias("taken")).distinct()
    d = d.join(on_grid, ["symbol", "target"], "left").join(F.broadcast(edges), "symbol")
    shared = F.count("*").over(Window.partitionBy("symbol", "target"))
    outside = (F.col("target") < F.col("first")) | (F.col("target") > F.col("last"))
    status = F.when(F.col("tie"), "TIE").when(outside, "OUTSIDE_EXPECTED_GRID").when(F.col("taken"), "COLLIDES_WITH_EXISTING_GRID").when(shared > 1, "AMBIGUOUS_SHARED_TARGET").otherwise("UNIQUE_MISSING_GRID")
    return d.select("symbol", from_micros(F.col("us")).alias("t"), from_micros(F.col("target")).alias("nearest"), (F.col("us") - F.col("target")).alias("offset_us"), status.alias("status"))
