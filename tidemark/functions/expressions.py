"""Column helpers shared by all operators. Missing values are NULL everywhere, never NaN."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12
HOUR = 3_600_000_000  # microseconds


def micros(t: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without time zone."""
    return F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def natural_log(x: Column) -> Column:
    """The C library's logarithm, NULL unless above 0.

    ``F.ln`` is Java's, whose last bit differs for some 7 % of ratios. Where equal returns (the last
    target, this hour's return) meet a threshold that is one of them, that bit decides the class.
    """

    @F.arrow_udf("double")
    def ln(v: pa.Array) -> pa.Array:  # local, so that it goes to the workers by value
        return pc.ln(v)

    return F.when(x > 0, ln(x.cast("double")))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that keep NULL (greatest and least alone would drop it)."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(float(low)))
    if high is not None:
        y = F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def true_or_false(x: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(x, F.lit(False))


def full(value: Column, counted: Column, over: WindowSpec, n: int) -> Column:
    """``value`` where the window holds ``n`` present values of ``counted``."""
    return F.when(F.count(counted).over(over) == n, value)


def safe_corr(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of pairwise present values; NULL where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    cov, sx, sy = (p.over(over) for p in parts) if over is not None else parts
    return F.when((sx > 0) & (sy > 0), F.try_divide(cov, sx * sy))


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """All double columns rounded; -0.0 becomes 0.0."""
    return df.select(*((F.round(F.col(c), places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))
