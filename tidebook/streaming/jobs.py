"""Streaming queries; each is a function from streaming input to streaming output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.values import int_div
from tidebook.operators.recurrence import decay_filter
from tidebook.operators.series import Series
from tidebook.streaming import processors as P
from tidebook.streaming.sources import with_event_time

#: So many consecutive order ids share a state: the bound of what an event makes the store read and write.
ORDERS_PER_STATE = 1024


def bars(ticks: DataFrame, width: str, delay: str) -> DataFrame:
    """Tumbling OHLCV bars, emitted once the watermark passes the window end."""
    order = F.struct("ts", "seq")
    timed = with_event_time(ticks, delay)
    agg = timed.groupBy(F.window("event_time", width), "symbol").agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"),
    )
    end = F.unix_micros("window.end") * 1000
    return agg.select(
        "symbol", end.alias("ts_event"), "open", "high", "low", "close", "volume"
    )


def latest(ticks: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Latest values per key (update mode): the cache of quotes, marks or states."""
    order = F.struct("ts", "seq")
    return ticks.groupBy(*keys).agg(
        F.max("ts").alias("ts"), *[F.max_by(c, order).alias(c) for c in columns]
    )


def distinct_fills(fills: DataFrame, key: str, delay: str | None = None) -> DataFrame:
    """First fill per trade id; with a delay the memory of ids is bounded."""
    if delay is None:
        return fills.dropDuplicates([key])
    return with_event_time(fills, delay).dropDuplicatesWithinWatermark([key])


def _stateful(df: DataFrame, keys: list[str], processor, initial=None, time_mode="None"):
    return df.groupBy(*keys).transformWithState(
        processor, processor.output, "append", time_mode, initial
    )


def _stateful_frames(df: DataFrame, keys: list[str], processor, time_mode="None"):
    return df.groupBy(*keys).transformWithStateInPandas(
        processor, processor.output, "append", time_mode
    )


def ema(ticks: DataFrame, period: int, history: DataFrame | None = None) -> DataFrame:
    """Exponential average per symbol, warm-started from ``history`` ticks."""
    start = None
    if history is not None:
        s = Series.of("symbol", ("ts", "seq"))
        past = decay_filter(history, s, "price", "y", 2.0 / (period + 1.0))
        start = past.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("n"), F.max_by("y", F.struct("ts", "seq")).alias("y")
        ).groupBy("symbol")
    return _stateful(ticks, ["symbol"], P.ExponentialFilter(period), start)


def positions(fills: DataFrame, symbols_per_state: int = 1) -> DataFrame:
    """Average-cost position after every fill.

    Many symbols of few fills each are faster with several consecutive ones to
    a state; those of a state are worked on by one task.
    """
    needed = fills.select("symbol", "ts", "seq", "side", "qty_raw", "px_raw", "fee_raw")
    grouped = needed.withColumn("_group", int_div(F.col("symbol"), symbols_per_state))
    return _stateful_frames(grouped, ["_group"], P.Positions())


def orders(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Order state after every event."""
    mode = "None" if keep_ms is None else "ProcessingTime"
    nulls = {n: F.col(v).isNull() for n, v in zip(P.Orders.NULLS, P.Orders.VALUES)}
    needed = events.select("client_order_id", "seq", "event", *P.Orders.VALUES)
    group = int_div(F.col("client_order_id"), ORDERS_PER_STATE)
    grouped = needed.withColumns({"_group": group, **nulls})
    out = _stateful_frames(grouped, ["_group"], P.Orders(keep_ms), mode)
    # A frame hands a NaN back as a null; these two are never null.
    return out.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("filled_qty", "leaves_qty")})


def books(deltas: DataFrame) -> DataFrame:
    """Top of book after every delta."""
    return _stateful(deltas, ["symbol"], P.Books())


def depth_resync(messages: DataFrame) -> DataFrame:
    """Outcome of every snapshot and diff, see ``DepthResync``."""
    return _stateful(messages, ["symbol"], P.DepthResync())


def account_monitor(telemetry: DataFrame, *limits: float) -> DataFrame:
    """One control event per account on its first breach."""
    return _stateful(telemetry, ["account"], P.AccountMonitor(*limits))


def kill_switch(control: DataFrame) -> DataFrame:
    """First engagement per account so far (update mode)."""
    engaged = control.where((F.col("kind") == "kill_switch") & F.col("engaged"))
    return engaged.groupBy("account").agg(F.min("ts").alias("engaged_at"))


def parse_telemetry(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed telemetry, malformed rows) of JSON messages."""
    schema = (
        "account bigint, ts bigint, seq bigint, equity double, gross_exposure double, "
        "net_exposure double, realized_pnl double, unrealized_pnl double"
    )
    parsed = raw.withColumn("d", F.from_json("text", schema))
    ok = F.col("d.account").isNotNull() & F.col("d.ts").isNotNull()
    return parsed.where(ok).select("d.*"), parsed.where(~F.coalesce(ok, F.lit(False))).select("text")


def quality_counters(frames: DataFrame, name: str = "frames") -> DataFrame:
    """Attach row and reject counters, reported with every progress event."""
    stream = F.get_json_object("text", "$.stream")
    return frames.observe(
        name,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(stream.isNull()).alias("malformed"),
    )
