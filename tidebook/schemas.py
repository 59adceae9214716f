"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

BAR = T.StructType(
    [
        T.StructField("ts_event", T.LongType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

SERIES = ("venue", "symbol", "interval")

LAKE_BAR = T.StructType(
    BAR.fields
    + [
        T.StructField("venue", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("interval", T.StringType()),
        T.StructField("yyyymm", T.IntegerType()),
    ]
)

CLOSE_BAR = T.StructType(
    [T.StructField("ts", T.LongType()), T.StructField("close", T.DoubleType())]
)

FILL = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("side", T.LongType()),
        T.StructField("qty", T.DoubleType()),
        T.StructField("px", T.DoubleType()),
    ]
)

RAW_FRAME = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("ts_init", T.LongType())]
)
