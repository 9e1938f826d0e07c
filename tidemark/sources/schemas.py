"""Explicit schemas of the market tables."""

from __future__ import annotations

from pyspark.sql import types as T

_D = T.DecimalType(38, 8)
_SUMS = ["volume", "quote_asset_volume"]
_TAKER = ["taker_buy_base_volume", "taker_buy_quote_volume"]

#: A raw archive row: twelve positional strings without a header.
RAW_FIELDS = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_asset_volume", "number_of_trades", "taker_buy_base_volume", "taker_buy_quote_volume", "ignore"]
RAW = T.StructType([T.StructField(n, T.StringType()) for n in RAW_FIELDS])

FIVE_MINUTES = T.StructType(
    [T.StructField("open_time", T.TimestampType(), False)]
    + [T.StructField(n, _D, False) for n in ("open", "high", "low", "close", "volume")]
    + [T.StructField("close_time", T.TimestampType(), False), T.StructField("quote_asset_volume", _D, False), T.StructField("number_of_trades", T.LongType(), False)]
    + [T.StructField(n, _D, False) for n in _TAKER]
    + [T.StructField("ignore", T.StringType(), False)]
)
HOURLY = T.StructType([f for f in FIVE_MINUTES.fields if f.name not in ("close_time", "ignore")])
