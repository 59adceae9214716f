"""Queries over a lake and files that are written first, and over operators at the edges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidebook.functions import values as V
from tidebook.operators import bars as B
from tidebook.operators import risk as RK
from tidebook.operators import signals as S
from tidebook.operators.series import Series
from tidebook.plans.book_queries import _trades
from tidebook.plans.lake_queries import _LAKE, MID, PRICES, _lake_rows
from tidebook.plans.market import DAY, HOUR, Market, r
from tidebook.plans.oracle_views import D, R, sql
from tidebook.plans.registry import query
from tidebook.plans.ta_queries import _marked
from tidebook.session import shared_dir, staged
from tidebook.sources import lake


def _prices(*cols: str):
    return [r(c).alias(c) for c in cols]


def _folder(m: Market, name: str) -> str:
    return f"{shared_dir(m.spark)}/{name}-{uuid.uuid4().hex}"


def _written(m: Market) -> str:
    """A lake that got all bars, then a late batch that rewrites the second half, some rows twice."""
    root = _folder(m, "lake")
    bars = _lake_rows(m).withColumn("batch_seq", F.col("ts_event"))
    lake.write_bars(m.spark, root, bars)
    late = bars.where(F.col("ts_event") > MID)
    once = late.withColumn("close", F.col("close") * 1.01)
    twice = late.where(F.col("volume") > 100).withColumns(
        {"close": F.col("close") * 1.02, "batch_seq": F.col("batch_seq") + 1}
    )
    lake.write_bars(m.spark, root, once.unionByName(twice))
    return root


_MERGED = f"""
WITH w AS (SELECT symbol, ts_event, open, high, low, volume,
 CASE WHEN ts_event <= {MID} THEN close WHEN volume > 100 THEN close * 1.02 ELSE close * 1.01 END AS close FROM bars)
"""
_OUT = ", ".join(f"{R(c)} AS {c}" for c in PRICES)


@query("lake_written_merge", sql(_MERGED + f"SELECT symbol, ts_event, {_OUT} FROM w", "bars"))
def lake_written_merge(m: Market):
    return lake.scan(m.spark, _written(m)).select("symbol", "ts_event", *_prices(*PRICES))


@query(
    "lake_written_range",
    sql(
        _MERGED
        + f"SELECT symbol, ts_event, {R('close')} AS close FROM w WHERE symbol = 'click' AND ts_event BETWEEN {MID - 5 * D} AND {MID + 3 * D}",
        "bars",
    ),
)
def lake_written_range(m: Market):
    out = lake.read_closes(
        m.spark, _written(m), "SIM", "click", "1h", start_ns=MID - 5 * DAY, end_ns=MID + 3 * DAY
    )
    return out.select("symbol", "ts_event", r("close").alias("close"))


@query("lake_written_series", sql(f'SELECT DISTINCT venue, symbol, "interval" FROM ({_LAKE})', "bars"))
def lake_written_series(m: Market):
    return lake.series(lake.scan(m.spark, _written(m)))


@query(
    "lake_written_coverage",
    sql(
        f"""
SELECT venue, symbol, "interval", count(*) AS n_rows, min(ts_event) AS start_ns, max(ts_event) AS end_ns,
 strftime(make_timestamp(min(ts_event) // 1000), '%Y-%m-%dT%H:%M:%SZ') AS start_utc,
 strftime(make_timestamp(max(ts_event) // 1000), '%Y-%m-%dT%H:%M:%SZ') AS end_utc
FROM ({_LAKE}) GROUP BY 1, 2, 3
""",
        "bars",
    ),
)
def lake_written_coverage(m: Market):
    return lake.coverage_text(lake.footer_coverage(m.spark, _written(m), "SIM"))


@query(
    "csv_bars",
    """
SELECT epoch_us(ts) * 1000 AS ts, round(value, 6) + 0.0 AS close FROM events WHERE event_id % 50 <> 7
""",
)
def csv_bars(m: Market):
    """Ticks as text with a broken row for every fiftieth, read back."""
    path = _folder(m, "csv")
    good = F.concat_ws(",", F.col("ts").cast("string"), F.col("price").cast("string"))
    line = F.when(F.col("seq") % 50 == 7, F.concat(F.lit("ts,"), F.col("symbol"))).otherwise(good)
    m.ticks.select(line.alias("value")).write.text(path)
    return lake.read_csv(m.spark, path).select("ts", r("close").alias("close"))


@query("typed_bars", sql(f"SELECT symbol AS instrument, ts_event, {R('close')} AS close FROM bars", "bars"))
def typed_bars(m: Market):
    path = _folder(m, "typed")
    lake.write_typed_bars(m.bars.withColumnRenamed("symbol", "instrument"), path)
    out = lake.read_typed_bars(m.spark, path)
    return out.select("instrument", "ts_event", r("close").alias("close"))


@query(
    "close_bars",
    """
SELECT epoch_us(ts) * 1000 AS ts, event_id AS seq, value AS open, value AS high, value AS low, value AS close, 10.0::DOUBLE AS volume FROM events
""",
)
def close_bars(m: Market):
    closes = m.ticks.select("ts", "seq", F.col("price").alias("close"))
    return B.bars_from_closes(closes).select("ts", "seq", *PRICES)


@query(
    "bar_shapes",
    sql(
        f"""
SELECT 2 AS width, ts_event AS ts, symbol, {R('close')} AS open, {R('close')} AS close, 0.0 AS volume FROM bars
UNION ALL SELECT 5, ts_event, symbol, {R('open')}, {R('close')}, 0.0 FROM bars
UNION ALL SELECT 6, ts_event, symbol, {R('open')}, {R('close')}, {R('volume')} FROM bars
""",
        "bars",
    ),
)
def bar_shapes(m: Market):
    """Bars of two, five and six columns; the symbol travels in the time as its code."""
    code = F.ascii(F.col("symbol")).cast("long")
    rows = m.bars.withColumn("ts", F.col("ts_event") + code)
    out = None
    for columns in (["ts", "close"], ["ts", *PRICES[:4]], ["ts", *PRICES]):
        part = B.to_ohlcv(rows.select(*columns)).withColumn("width", F.lit(len(columns)))
        out = part if out is None else out.unionByName(part)
    at = F.col("ts") % 1000
    names = {ord(n[0]): n for n in ("click", "error", "purchase", "signup", "view")}
    symbol = F.coalesce(*[F.when(at == k, F.lit(n)) for k, n in names.items()])
    return out.select(
        "width", (F.col("ts") - at).alias("ts"), symbol.alias("symbol"), *_prices("open", "close", "volume")
    )


@query(
    "position_mismatch",
    sql(
        f"""
WITH p AS (SELECT symbol, ts_event + CASE WHEN (ts_event // {3600 * 10**9}) % 40 = 0 THEN 1 ELSE 0 END AS ts_event FROM bars)
SELECT coalesce(b.symbol, p.symbol) AS symbol, coalesce(b.ts_event, p.ts_event) AS ts_event,
 CASE WHEN b.symbol IS NULL THEN 'no bar' ELSE 'no position' END AS problem
FROM bars b FULL JOIN p ON b.symbol = p.symbol AND b.ts_event = p.ts_event WHERE b.symbol IS NULL OR p.symbol IS NULL
""",
        "bars",
    ),
)
def position_mismatch(m: Market):
    hour = F.call_function("div", F.col("ts_event"), F.lit(HOUR))
    late = F.when(hour % 40 == 0, 1).otherwise(0)
    positions = m.bars.select("symbol", (F.col("ts_event") + late).alias("ts_event"))
    return S.check_lengths(m.bars, positions, ["symbol", "ts_event"])


@query(
    "screen_session",
    sql(
        f"""
SELECT symbol, count(*) AS n_points, count(*) FILTER (dpos <> 0) AS n_fills, {R('sum(abs(dpos)) FILTER (dpos <> 0)')} AS traded,
 {R('last(equity ORDER BY ts_event)', 4)} AS final_equity FROM equity GROUP BY 1
""",
        "equity",
    ),
)
def screen_session(m: Market):
    """Curve and fills of a vector backtest, counted."""
    curve, fills = S.to_session(_marked(m), m.bar_series)
    points = curve.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_points"), r(F.max_by("equity", "ts_event"), 4).alias("final_equity")
    )
    traded = fills.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_fills"), r(F.sum("qty")).alias("traded"))
    return points.join(traded, "symbol").select("symbol", "n_points", "n_fills", "traded", "final_equity")


_RIGHTS = ["call", "PUT", " C ", "p", "straddle"]


@query(
    "option_rights",
    f"""
SELECT p_partkey AS instrument, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS is_call FROM part
""",
)
def option_rights(m: Market):
    text = F.get(F.array(*[F.lit(x) for x in _RIGHTS]), (F.col("p_partkey") % 5).cast("int"))
    return m.table("part").select(F.col("p_partkey").alias("instrument"), V.is_call(text).alias("is_call"))


@query(
    "protection_halts",
    sql(
        f"""
WITH t AS (SELECT symbol, exit_ts AS ts, pnl FROM trades),
c AS (SELECT DISTINCT symbol, ts, count(*) FILTER (pnl < 0) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN {14 * D} PRECEDING AND CURRENT ROW) AS losses FROM t),
v AS (SELECT symbol, ts, 'losses' AS guard, losses >= 6 AS tripped, CASE WHEN losses >= 6 THEN ts + {3 * D} END AS until FROM c
 UNION ALL SELECT symbol, ts, 'single_loss', pnl < -20000, CASE WHEN pnl < -20000 THEN ts + {D} END FROM t),
a AS (SELECT *, max(until) OVER (PARTITION BY symbol ORDER BY ts RANGE UNBOUNDED PRECEDING) AS armed FROM v)
SELECT symbol, ts, coalesce(string_agg(DISTINCT CASE WHEN tripped THEN guard END, ',' ORDER BY CASE WHEN tripped THEN guard END), '') AS tripped_by,
 coalesce(ts < max(armed), false) AS halt FROM a GROUP BY 1, 2
""",
        "trades",
    ),
)
def protection_halts(m: Market):
    """A loss-count guard and a predicate guard, in one pipeline."""
    trades = staged(_trades(m).select("symbol", F.col("exit_ts").alias("ts"), "entry_ts", "pnl"))
    s = Series.of("symbol", ("ts", "entry_ts"), m.fill_cuts)
    by_ts = Series.of("symbol", "ts", m.fill_cuts)
    guards = {
        "losses": RK.stoploss_guard(trades, s, 6, 14 * 86_400, 3 * 86_400),
        "single_loss": RK.predicate_guard(trades, by_ts, F.col("pnl") < -20_000, 86_400),
    }
    out = RK.protections(guards, by_ts)
    return out.select("symbol", "ts", F.concat_ws(",", "tripped_by").alias("tripped_by"), "halt")
