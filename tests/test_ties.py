"""Returns that equal the threshold of the labels: the last bit of a logarithm decides the class."""

import datetime as dt
import math

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.expressions import natural_log
from tidemark.plans import catalog


#: Cycles of hourly prices for which Java's logarithm puts the previous return on the other side of the threshold than C's.
CYCLES = (
    (233.66, 324.77, 98.11, 292.89, 77.69, 33.58, 103.28, 27.03),
    (457.9, 179.37, 150.89, 472.5, 302.63, 406.41, 14.82, 489.77),
    (107.2, 447.46, 190.34, 136.68, 199.07, 493.35, 79.42, 195.81),
    (250.34, 456.79, 98.34, 485.98, 71.08, 356.11, 304.47, 436.14),
    (128.51, 136.61, 98.35, 332.81, 138.23, 463.14, 143.49, 23.31),
)


def test_natural_log_is_the_c_library_s(spark):
    rng = np.random.default_rng(0)
    x = (rng.integers(1, 50000, 3000) / rng.integers(1, 50000, 3000)).tolist()
    d = spark.createDataFrame([(v,) for v in [*x, None, 0.0, -1.0]], "x double")
    got = {r.x: r.l for r in d.select("x", natural_log(F.col("x")).alias("l")).collect()}
    assert all(got[v] == math.log(v) for v in x)
    assert got[None] is None and got[0.0] is None and got[-1.0] is None


def test_confusion_of_repeated_prices(spark, tmp_path):
    """Eight hours of prices over and over: the threshold is one of the returns, and an hour later the previous return."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(hours=h, minutes=1), f"t{s}", prices[h % 8]) for s, prices in enumerate(CYCLES) for h in range(64)]
    d = pd.DataFrame(rows, columns=["ts", "event_type", "value"]).assign(event_id=range(len(rows)))
    spark.createDataFrame(d, "ts timestamp_ntz, event_type string, value double, event_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = sorted(duck.execute(catalog.oracle_sql()["confusion_matrix"]).fetchall())
    got = catalog.queries()["confusion_matrix"](spark, str(tmp_path)).select("symbol", "actual", "predicted", "n").collect()
    assert len(want) == 45 and sorted(map(tuple, got)) == want
