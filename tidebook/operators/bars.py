"""Bars from ticks, coarser bars from bars, and synthetic markets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.values import int_div
from tidebook.operators.series import Series

OHLCV = ("open", "high", "low", "close", "volume")


def _ohlcv(first_by, last_by):
    return [
        F.min_by("price", first_by).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", last_by).alias("close"),
        F.sum("size").alias("volume"),
    ]


def time_bars(ticks: DataFrame, width_ns: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Tumbling OHLCV bars stamped with the window end; partial aggregation first."""
    end = (int_div(F.col("ts"), width_ns) + 1) * F.lit(width_ns)
    order = F.struct("ts", "seq")
    return ticks.groupBy(*keys, end.alias("ts_event")).agg(*_ohlcv(order, order))


#: The price of a quote that bars of each kind are made of.
QUOTE_PRICES = ("bid", "ask", "mid")


def quote_bars(
    quotes: DataFrame, width_ns: int, price: str, keys: tuple[str, ...] = ("symbol",)
) -> DataFrame:
    """Bars of a quote's bid, ask or mid; the volume is the size shown on that side, of both for a mid."""
    if price not in QUOTE_PRICES:
        raise ValueError(f"no quote price {price!r}")
    px = (F.col("bid") + F.col("ask")) / 2 if price == "mid" else F.col(price)
    size = F.col("bid_size") + F.col("ask_size") if price == "mid" else F.col(f"{price}_size")
    return time_bars(quotes.withColumns({"price": px, "size": size}), width_ns, keys)


def tick_bars(ticks: DataFrame, n: int, series: Series) -> DataFrame:
    """One bar per ``n`` ticks of a series; the incomplete tail is not emitted."""
    if n < 1:
        raise ValueError("a tick bar needs at least one tick")
    order = F.struct(*series.by)
    return (
        series.number(ticks, "_rn")
        .withColumn("bar_no", int_div(F.col("_rn"), n))
        .groupBy(*series.keys, "bar_no")
        .agg(F.max("ts").alias("ts_event"), *_ohlcv(order, order), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == n)
        .drop("_n")
    )


def resample(bars: DataFrame, factor: int, series: Series) -> DataFrame:
    """Merge every ``factor`` bars into one, stamped with the last; no partial tail."""
    if factor < 1:
        raise ValueError("resample factor must be positive")
    order = F.struct(*series.by)
    return (
        series.number(bars, "_rn")
        .withColumn("_g", int_div(F.col("_rn"), factor))
        .groupBy(*series.keys, "_g")
        .agg(
            F.max(series.by[0]).alias(series.by[0]),
            F.min_by("open", order).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", order).alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("_n"),
        )
        .where(F.col("_n") == factor)
        .drop("_n", "_g")
    )


def bars_from_closes(closes: DataFrame, volume: float = 10.0) -> DataFrame:
    """Bars whose four prices are the close."""
    return closes.withColumns(
        {
            "open": F.col("close"),
            "high": F.col("close"),
            "low": F.col("close"),
            "volume": F.lit(volume),
        }
    )


def to_ohlcv(df: DataFrame) -> DataFrame:
    """Accept (ts, close), (ts, o, h, l, c) or (ts, o, h, l, c, v) by column count."""
    c = df.columns
    names = {2: ["ts", "close"], 5: ["ts", "open", "high", "low", "close"]}
    if len(c) == 6:
        return df.toDF("ts", *OHLCV)
    if len(c) not in names:
        raise ValueError(f"bars must have 2, 5 or 6 columns, got {len(c)}")
    named = df.toDF(*names[len(c)])
    if len(c) == 2:
        named = bars_from_closes(named, 0.0)
    else:
        named = named.withColumn("volume", F.lit(0.0))
    return named.select("ts", *OHLCV)


def _sine(i, base, amp, period, trend):
    return base + amp * F.sin(F.lit(2.0 * math.pi) * i / period) + i * trend


def synthetic_closes(params: DataFrame, start_ns: int = 0, step_ns: int = 60_000_000_000) -> DataFrame:
    """Sine-plus-trend closes; one row of ``params`` per symbol.

    ``params``: symbol, n, base, amp, period, trend.
    """
    i = F.col("i").cast("double")
    return params.select(
        "symbol",
        "base",
        "amp",
        "period",
        "trend",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("i"),
    ).select(
        "symbol",
        "i",
        (F.lit(start_ns) + F.col("i") * F.lit(step_ns)).alias("ts_event"),
        _sine(i, F.col("base"), F.col("amp"), F.col("period"), F.col("trend")).alias("close"),
    )


def synthetic_ohlcv(
    params: DataFrame,
    start_ns: int = 0,
    step_ns: int = 60_000_000_000,
    wick: float = 0.004,
    volume: float = 100.0,
) -> DataFrame:
    """As ``synthetic_closes`` with open = previous close and symmetric wicks."""
    i = F.col("i").cast("double")
    prev = _sine(i - 1, F.col("base"), F.col("amp"), F.col("period"), F.col("trend"))
    rows = params.select(
        "*",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("i"),
    ).withColumn("close", _sine(i, F.col("base"), F.col("amp"), F.col("period"), F.col("trend")))
    rows = rows.withColumn("open", F.when(F.col("i") == 0, F.col("close")).otherwise(prev))
    return rows.select(
        "symbol",
        "i",
        (F.lit(start_ns) + F.col("i") * F.lit(step_ns)).alias("ts_event"),
        "open",
        (F.greatest("open", "close") * (1.0 + wick)).alias("high"),
        (F.least("open", "close") * (1.0 - wick)).alias("low"),
        "close",
        F.lit(volume).alias("volume"),
    )


def synthetic_market(spark: SparkSession, symbol: str, n: int, **kw) -> DataFrame:
    """Close series of one symbol with the usual test parameters."""
    defaults = dict(base=50_000.0, amp=1_500.0, period=40.0, trend=12.0)
    defaults.update(kw)
    params = spark.range(1).select(
        F.lit(symbol).alias("symbol"),
        F.lit(n).alias("n"),
        *[F.lit(float(v)).alias(k) for k, v in defaults.items()],
    )
    return synthetic_closes(params)


def quotes_from_bars(bars: DataFrame, spread_bps: float = 2.0) -> DataFrame:
    """One quote per bar: close plus and minus half the spread, half the volume each."""
    half = F.lit(spread_bps / 2.0 / 10_000.0)
    return bars.select(
        "symbol",
        "ts_event",
        (F.col("close") * (F.lit(1.0) - half)).alias("bid"),
        (F.col("close") * (F.lit(1.0) + half)).alias("ask"),
        (F.col("volume") / 2).alias("bid_size"),
        (F.col("volume") / 2).alias("ask_size"),
    )


def trades_from_bars(bars: DataFrame) -> DataFrame:
    """One print per bar at its close; an up or flat bar was bought."""
    return bars.select(
        "symbol",
        "ts_event",
        F.col("close").alias("price"),
        F.col("volume").alias("size"),
        F.when(F.col("close") >= F.col("open"), 1).otherwise(-1).cast("long").alias("aggressor"),
    )
