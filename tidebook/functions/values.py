"""Scalar rules for prices, quantities, money, identifiers and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000

# Supported bar intervals and their length in milliseconds.
INTERVAL_MS = {
    "1m": 60_000,
    "3m": 180_000,
    "5m": 300_000,
    "15m": 900_000,
    "30m": 1_800_000,
    "1h": 3_600_000,
    "2h": 7_200_000,
    "4h": 14_400_000,
    "6h": 21_600_000,
    "8h": 28_800_000,
    "12h": 43_200_000,
    "1d": 86_400_000,
}


def interval_to_ms(interval: str) -> int:
    """Length of a bar interval; unknown names are an error."""
    if interval not in INTERVAL_MS:
        raise ValueError(f"unsupported interval {interval!r}")
    return INTERVAL_MS[interval]


def interval_ms(interval: Column) -> Column:
    """Length of a bar interval held in a column; null when unknown."""
    pairs = [F.lit(x) for kv in INTERVAL_MS.items() for x in kv]
    return F.create_map(*pairs)[interval]


def bar_interval(step: Column, unit: Column) -> Column:
    """Interval name of a bar spec, e.g. (0, 'Minute') -> '1m'."""
    suffix = (
        F.when(unit == "Minute", "m").when(unit == "Hour", "h").when(unit == "Day", "d")
    )
    return F.when(
        suffix.isNotNull(), F.concat(F.greatest(step, F.lit(1)).cast("string"), suffix)
    )


def int_div(a: Column, width: int | Column) -> Column:
    """Floor division of longs; stays exact where doubles would not."""
    w = width if isinstance(width, Column) else F.lit(width)
    return F.call_function("div", a - F.pmod(a, w), w)


def is_finite(x: Column) -> Column:
    """True for a usable number: not null, not NaN, not infinite."""
    return (
        x.isNotNull()
        & ~F.isnan(x)
        & (F.abs(x) < F.lit(float("inf")))
    )


def quantize(x: Column, precision: int, half_even: bool = True) -> Column:
    """A double at a fixed number of decimals: halves go to the even neighbour, or else away from zero."""
    rounded = F.bround if half_even else F.round
    return rounded(x.cast("decimal(38,12)"), precision)


def value_error(x: Column, precision: int) -> Column:
    """Why a number cannot be a price or quantity; null when it can."""
    top = float(2**63 - 1) / 10.0**precision
    return (
        F.when(~is_finite(x), "not_finite")
        .when(x < 0, "negative")
        .when(x > top, "overflow")
    )


def split_values(df, column: str, precision: int):
    """(rows whose ``column`` is a price or quantity, rounded to ``precision``; all other rows as they came, with their ``problem``)."""
    problem = value_error(F.col(column), precision)
    good = df.where(problem.isNull()).withColumn(column, quantize(F.col(column), precision).cast("double"))
    return good, df.where(problem.isNotNull()).withColumn("problem", problem)


def nanos_to_timestamp(ns: Column) -> Column:
    """UTC timestamp of a nanosecond position (microsecond resolution)."""
    return F.timestamp_micros(int_div(ns, 1000))


def month_key(ns: Column) -> Column:
    """UTC month of a nanosecond position as the integer yyyymm."""
    t = F.timestamp_seconds(int_div(ns, NANOS))
    return (F.year(t) * 100 + F.month(t)).cast("int")


def month_key_of(ns: int) -> int:
    """``month_key`` of a Python integer, for partition predicates."""
    from datetime import datetime, timezone

    t = datetime.fromtimestamp(ns // NANOS, tz=timezone.utc)
    return t.year * 100 + t.month


def utc_text(ns: Column) -> Column:
    """UTC ISO text of a nanosecond position, ``-`` when there is none."""
    t = F.timestamp_seconds(int_div(ns, NANOS))
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("-"))


def bucket(ts: Column, width: int) -> Column:
    """Integer time bucket; a width of zero or less keeps the timestamp."""
    return int_div(ts, width) if width > 0 else ts


def mid_raw(bid_raw: Column, ask_raw: Column) -> Column:
    """Mid price in integer units, truncated."""
    return F.call_function("div", bid_raw + ask_raw, F.lit(2))


def instrument_symbol(instrument_id: Column) -> Column:
    """Part before the last dot of ``SYMBOL.VENUE``; null without a dot."""
    return F.nullif(F.regexp_extract(instrument_id, r"^(.*)\.([^.]*)$", 1), F.lit(""))


def instrument_venue(instrument_id: Column) -> Column:
    """Part after the last dot of ``SYMBOL.VENUE``; null without a dot."""
    return F.nullif(F.regexp_extract(instrument_id, r"^(.*)\.([^.]*)$", 2), F.lit(""))


def qualified_id(name: Column, default_venue: str) -> Column:
    """Complete a bare symbol with the default venue."""
    return F.when(name.contains("."), name).otherwise(
        F.concat_ws(".", name, F.lit(default_venue))
    )


def side_sign(side: Column) -> Column:
    """BUY/SELL text to +1/-1."""
    return F.when(F.upper(side) == "BUY", F.lit(1)).when(F.upper(side) == "SELL", F.lit(-1))


def side_name(sign: Column) -> Column:
    """Signed side to text; anything below zero sells."""
    return F.when(sign < 0, "SELL").otherwise("BUY")


def book_action(code: Column) -> Column:
    """Numeric book action code to its name; null when unknown."""
    return F.get(
        F.array(F.lit("Add"), F.lit("Update"), F.lit("Delete"), F.lit("Clear")),
        code.cast("int"),
    )


def padded_order_id(strategy: Column, seq: Column) -> Column:
    """Sortable client order id."""
    return F.concat_ws("-", strategy, F.lpad(seq.cast("string"), 20, "0"))


def is_call(right: Column) -> Column:
    """Option right text (call/c/put/p, any case); null when unknown."""
    r = F.lower(F.trim(right))
    return F.when(r.isin("call", "c"), F.lit(True)).when(r.isin("put", "p"), F.lit(False))


def fixed_text(x: Column, precision: int) -> Column:
    """Number as fixed-precision text for read views."""
    return x.cast(f"decimal(38,{precision})").cast("string")
