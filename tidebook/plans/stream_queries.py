"""Streaming jobs run over the tables with an available-now trigger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.plans.book_queries import _AVG_OUT, _raw
from tidebook.plans.market import Market, r
from tidebook.plans.oracle_views import R, sql
from tidebook.plans.registry import query
from tidebook.plans.risk_queries import _BR, _FSM, _TOPS
from tidebook.plans.ta_queries import _EMA
from tidebook.session import shared_dir, staged
from tidebook.streaming import jobs
from tidebook.streaming.sources import file_stream, run_available_now

OHLCV = ["open", "high", "low", "close", "volume"]


LANDINGS, FILES = 3, 4
_ORDER = {"events": "event_id", "orders": "o_orderkey", "lineitem": "l_orderkey"}
#: Events are of few symbols, and a processor holds the rows of a symbol and micro-batch.
ROWS_PER_LANDING = {"event_id": 1_000_000}

#: Suppliers are many, of few fills each.
SYMBOLS_PER_STATE = 32


def _landed(spark: SparkSession, rows: DataFrame, order: str, last: DataFrame | None = None) -> DataFrame:
    """``rows`` as a stream that arrives in several micro-batches, in ``order``.

    Each range is written as so many files as a trigger takes, so a batch is a
    range; ``last`` arrives after all of them.  Batches become more, not longer,
    with the table where ``ROWS_PER_LANDING`` bounds them.
    """
    path = f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"
    landings = LANDINGS
    if order in ROWS_PER_LANDING:
        landings = max(LANDINGS, -(-rows.count() // ROWS_PER_LANDING[order]))
    shares = [i / landings for i in range(1, landings)]
    at = rows.agg(F.percentile_approx(order, shares, 100 * landings + 1000)).first()[0] or [0] * len(shares)
    o = F.col(order)
    ranges = [o <= at[0], *[(o > a) & (o <= b) for a, b in zip(at, at[1:])], o > at[-1]]
    for part in [*[rows.where(r) for r in ranges], *([last] if last is not None else [])]:
        part.repartition(FILES).write.mode("append").parquet(path)
    return file_stream(spark, path, rows.schema, max_files=FILES)


class StreamMarket(Market):
    """The same views with the tables as streams of several micro-batches."""

    def __init__(self, spark: SparkSession, sf_dir: str, closing: int | None = None):
        super().__init__(spark, sf_dir)
        self.closing = closing

    def table(self, name: str):
        rows = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return _landed(self.spark, rows, _ORDER[name], self._closing_rows(rows))

    def _closing_rows(self, rows: DataFrame) -> DataFrame | None:
        """Marks of another symbol ``closing`` hours after the last event, which end all windows."""
        if self.closing is None:
            return None
        newest = rows.orderBy(F.desc("ts")).limit(1)
        late = newest.withColumns(
            {
                "ts": (F.col("ts") + F.make_interval(hours=F.lit(self.closing))).cast(rows.schema["ts"].dataType),
                "event_type": F.lit("end of feed"),
            }
        )
        return late.select(rows.columns).withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(FILES)))).drop("_")


def _r(*cols: str, places: int = 6):
    return [r(c, places).alias(c) for c in cols]


@query(
    "stream_bars",
    sql(f"SELECT symbol, ts_event, {', '.join(f'{R(c)} AS {c}' for c in OHLCV)} FROM bars", "bars"),
)
def stream_bars(m: Market):
    """Hourly bars behind a ten-minute watermark; marks at the end of the feed close the last ones."""
    ticks = StreamMarket(m.spark, m.dir, closing=3).ticks
    out = run_available_now(jobs.bars(ticks, "1 hour", "10 minutes"))
    return out.select("symbol", "ts_event", *_r(*OHLCV))


@query(
    "stream_indicators",
    sql(
        _EMA.format(
            name="e",
            src="(SELECT symbol, seq AS ts, price AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM ticks)",
            a="(2.0::DOUBLE / 13)",
        )
        + f"SELECT symbol, ts AS seq, {R('CASE WHEN rn >= 12 THEN y END')} AS ema FROM e",
        "ticks",
    ),
)
def stream_indicators(m: Market):
    ticks = StreamMarket(m.spark, m.dir).ticks.select("symbol", "ts", "seq", "price")
    return run_available_now(jobs.ema(ticks, 12)).select("symbol", "seq", *_r("ema"))


@query("stream_positions", sql(_AVG_OUT, "fills"))
def stream_positions(m: Market):
    """Numbered fills land as a table and are consumed as a stream."""
    out = run_available_now(jobs.positions(_landed(m.spark, staged(_raw(m)), "seq"), SYMBOLS_PER_STATE))
    return out.select("symbol", "seq", "net_raw", "avg_raw", "realized_raw")


@query(
    "stream_orders",
    sql(_FSM + "SELECT client_order_id, seq, ok AS accepted, status FROM o", "order_events"),
)
def stream_orders(m: Market):
    events = StreamMarket(m.spark, m.dir).order_events
    out = run_available_now(jobs.orders(events))
    return out.select("client_order_id", "seq", "accepted", "status")


@query("stream_book", sql(_TOPS, "deltas"))
def stream_book(m: Market):
    deltas = StreamMarket(m.spark, m.dir).deltas
    out = run_available_now(jobs.books(deltas))
    return out.select("symbol", "seq", "applied", "bid", "ask", "levels")


@query(
    "stream_monitor",
    sql(
        _BR + "SELECT account, min(ts) AS ts, arg_min(array_to_string(b, ','), ts) AS limits FROM br WHERE len(b) > 0 GROUP BY 1",
        "telemetry",
    ),
)
def stream_monitor(m: Market):
    telemetry = StreamMarket(m.spark, m.dir).telemetry
    out = run_available_now(
        jobs.account_monitor(telemetry, 0.6, 60_000.0, 50_000.0, 30_000.0)
    )
    return out.select("account", "ts", "limits")


@query(
    "stream_latest_marks",
    sql(f"SELECT symbol, max(ts) AS ts, {R('last(price ORDER BY ts, seq)')} AS price FROM ticks GROUP BY 1", "ticks"),
)
def stream_latest_marks(m: Market):
    ticks = StreamMarket(m.spark, m.dir).ticks
    out = run_available_now(jobs.latest(ticks, ["symbol"], ["price"]), mode="update")
    # Update mode re-emits a key per batch; the newest emission is the cache.
    newest = out.groupBy("symbol").agg(F.max(F.struct("batch", "ts", "price")).alias("n"))
    return newest.select("symbol", F.col("n.ts").alias("ts"), r("n.price").alias("price"))


@query(
    "stream_fill_dedupe",
    "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS trade_id FROM lineitem",
)
def stream_fill_dedupe(m: Market):
    rows = StreamMarket(m.spark, m.dir).raw_fills
    ident = F.concat_ws("-", F.col("k1").cast("string"), F.col("k2").cast("string"))
    fills = rows.select(ident.alias("trade_id"), "symbol", "ts")
    return run_available_now(jobs.distinct_fills(fills, "trade_id")).select("trade_id")
