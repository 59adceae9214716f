"""Joins on time, indicators, resampling, signals and vectorized backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.operators import bars as B
from tidebook.operators import indicators as T
from tidebook.operators import metrics as M
from tidebook.operators import portfolio as P
from tidebook.operators import signals as S
from tidebook.operators.asof import asof, asof_mark, mark_events
from tidebook.operators.execution import adapt_events, reference_price
from tidebook.operators.orders import new_submissions, reconcile, reconcile_fills
from tidebook.operators.instruments import lookup
from tidebook.operators.parity import align_curves, match_fills
from tidebook.operators.series import Series, measure_cuts
from tidebook.plans.market import HOUR, Market, r
from tidebook.plans.oracle_views import D, H, R, VIEWS, sql
from tidebook.plans.registry import query

OHLCV = ["open", "high", "low", "close", "volume"]


def _r(*cols: str):
    return [r(c).alias(c) for c in cols]


# -- joins ----------------------------------------------------------------

_ASOF = f"""
SELECT b.symbol, b.ts_event, {R('t.price')} AS mark
FROM bars b ASOF LEFT JOIN (SELECT symbol, ts, last(price ORDER BY seq) AS price FROM ticks GROUP BY 1, 2) t
 ON b.symbol = t.symbol AND b.ts_event - 5400000000000 >= t.ts
"""


def _mark(m: Market):
    probes = m.bars.withColumn("probe", F.col("ts_event") - F.lit(HOUR + HOUR // 2))
    return asof(
        probes, m.ticks, "symbol", left_at="probe", right_at="ts",
        values={"mark": "price"}, right_tie="seq", cuts=m.tick_cuts,
    ).select("symbol", "ts_event", *_r("mark"))


query("asof_backward_mark", sql(_ASOF, "bars"))(_mark)


@query("asof_backward_mark_blocked", sql(_ASOF, "bars"))
def asof_backward_mark_blocked(m: Market):
    """The same join with series cut into small blocks."""
    return _mark(Market(m.spark, m.dir, rows_per_block=700))


_KINDS = """
SELECT symbol, ts, 1 AS k, seq, price AS mark FROM ticks WHERE seq % 3 = 0
 UNION ALL SELECT symbol, ts, 0, seq, (bid + ask) / 2 FROM quotes WHERE seq % 3 <> 0
 UNION ALL SELECT symbol, ts_event, 2, 0, close FROM bars
"""


def _last_mark(events: str, asked: str) -> str:
    """The last mark at or before each asked row, over the union in the order of time, kind and sequence."""
    return f"""
WITH u AS (SELECT symbol, ts, k, seq, mark, NULL AS id FROM ({events}) UNION ALL SELECT symbol, ts, 9, 0, NULL, id FROM ({asked}))
SELECT id AS order_id, {R('mark')} AS mark FROM (
 SELECT id, last_value(mark IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, k, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mark FROM u)
WHERE id IS NOT NULL
"""


def _kinds(m: Market):
    return mark_events(m.ticks.where("seq % 3 = 0"), m.quotes.where("seq % 3 <> 0"), m.bars)


@query(
    "asof_mark_all_kinds",
    sql(_last_mark(_KINDS, f"SELECT symbol, ts_decision // {H} * {H} + order_id % 3 AS ts, order_id AS id FROM order_table"), "ticks", "quotes", "bars", "order_table"),
)
def asof_mark_all_kinds(m: Market):
    """Marks from quotes, trades and bars; a third of the orders is decided just when a bar closes."""
    whole = F.call_function("div", F.col("ts_decision"), F.lit(HOUR)) * HOUR
    asked = m.orders.select("symbol", "order_id", (whole + F.col("order_id") % 3).alias("at"))
    return asof_mark(asked, _kinds(m), left_at="at", cuts=m.tick_cuts).select("order_id", *_r("mark"))


@query(
    "asof_crowded_timestamp_blocked",
    sql(
        _last_mark(
            f"SELECT symbol, CASE WHEN seq % 2 = 0 THEN {17_050_000 * 100_000_000_000} ELSE ts END AS ts, 1 AS k, seq, price AS mark FROM ticks",
            f"SELECT symbol, CASE WHEN order_id % 4 < 2 THEN {17_050_000 * 100_000_000_000} ELSE ts_decision END AS ts, order_id AS id FROM order_table",
        ),
        "ticks",
        "order_table",
    ),
)
def asof_crowded_timestamp_blocked(m: Market):
    """Half of all trades and of all orders at one time: that time is cut along the trades' sequence."""
    hot = F.lit(17_050_000 * 100_000_000_000)
    trades = m.ticks.withColumn("ts", F.when(F.col("seq") % 2 == 0, hot).otherwise(F.col("ts")))
    asked = m.orders.select("symbol", "order_id", F.when(F.col("order_id") % 4 < 2, hot).otherwise(F.col("ts_decision")).alias("at"))
    events = mark_events(trades)
    cuts = measure_cuts(events, ["symbol"], "ts", 200, tie="tie")
    return asof_mark(asked, events, left_at="at", cuts=cuts).select("order_id", *_r("mark"))


_GRID = f"(SELECT symbol, ts // {6 * H} * {6 * H} AS g FROM ticks GROUP BY 1, 2)"


@query(
    "asof_nearest_snap",
    sql(
        f"""
SELECT t.symbol, t.seq, CASE WHEN p.g IS NULL THEN n.g WHEN n.g IS NULL THEN p.g
 WHEN n.g - t.ts < t.ts - p.g THEN n.g ELSE p.g END AS snapped
FROM ticks t ASOF LEFT JOIN {_GRID} p ON t.symbol = p.symbol AND t.ts >= p.g
ASOF LEFT JOIN {_GRID} n ON t.symbol = n.symbol AND t.ts < n.g
""",
        "ticks",
    ),
)
def asof_nearest_snap(m: Market):
    width = 6 * HOUR
    g = F.call_function("div", F.col("ts"), F.lit(width)) * width
    grid = m.ticks.select("symbol", g.alias("ts_event")).distinct()
    out = P.snap_fills(m.ticks, grid, ["symbol"], cuts=m.tick_cuts)
    return out.select("symbol", "seq", F.col("ts").alias("snapped"))


@query(
    "asof_forward_open",
    sql(
        f"""
SELECT t.symbol, t.seq, b.ts_event, {R('b.open')} AS open
FROM ticks t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.ts < b.ts_event
""",
        "bars",
    ),
)
def asof_forward_open(m: Market):
    out = asof(
        m.ticks, m.bars, "symbol", left_at="ts", right_at="ts_event", direction="forward",
        values={"ts_event": "@at", "open": "open"}, cuts=m.tick_cuts,
    )
    return out.select("symbol", "seq", "ts_event", *_r("open"))


@query(
    "reference_price",
    sql(
        f"""
SELECT o.order_id, {R('coalesce(CASE WHEN o.side > 0 THEN q.ask ELSE q.bid END, b.close)')} AS ref_px
FROM order_table o
ASOF LEFT JOIN (SELECT symbol, ts, last(bid ORDER BY seq) AS bid, last(ask ORDER BY seq) AS ask
  FROM (SELECT * REPLACE (ts + 259200000000000 AS ts) FROM quotes) GROUP BY 1, 2) q
 ON o.symbol = q.symbol AND o.ts_decision >= q.ts
ASOF LEFT JOIN bars b ON o.symbol = b.symbol AND o.ts_decision >= b.ts_event
""",
        "order_table",
        "quotes",
        "bars",
    ),
)
def reference_prices(m: Market):
    # Quotes start three days after the bars, so early orders look at a mark.
    quotes = m.quotes.withColumn("ts", F.col("ts") + 72 * HOUR)
    with_quote = asof(
        m.orders, quotes, "symbol", left_at="ts_decision", right_at="ts",
        values={"bid": "bid", "ask": "ask"}, right_tie="seq", cuts=m.tick_cuts,
    )
    with_mark = asof(
        with_quote, m.bars, "symbol", left_at="ts_decision", right_at="ts_event",
        values={"mark": "close"}, cuts=m.tick_cuts,
    )
    ref = reference_price(F.col("side"), F.col("bid"), F.col("ask"), F.col("mark"))
    return with_mark.select("order_id", r(ref).alias("ref_px"))


@query(
    "bars_with_fills",
    sql(
        f"""
SELECT b.symbol, b.ts_event, {R('coalesce(sum(f.side * f.qty), 0)')} AS net, count(f.seq) AS n
FROM fill_bars b LEFT JOIN (SELECT *, (ts // {30 * D} + 1) * {30 * D} AS t FROM fills) f
 ON f.symbol = b.symbol AND f.t = b.ts_event GROUP BY 1, 2
""",
        "fill_bars",
    ),
)
def bars_with_fills(m: Market):
    width = 30 * 24 * HOUR
    t = (F.call_function("div", F.col("ts"), F.lit(width)) + 1) * width
    flows = m.raw_fills.groupBy("symbol", t.alias("ts_event")).agg(
        F.sum(F.col("side") * F.col("qty")).alias("net"), F.count(F.lit(1)).alias("n")
    )
    return m.fill_bars.join(flows, ["symbol", "ts_event"], "left").select(
        "symbol", "ts_event", r(F.coalesce("net", F.lit(0.0))).alias("net"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


_SB = "SELECT symbol, ts, side, px * 1.00033333333 AS px, qty FROM fills WHERE order_id % 10 <> 9"


@query(
    "session_match",
    sql(
        f"""
WITH a AS (SELECT symbol, ts // {D} AS bucket, side, avg(px) AS px_a FROM fills GROUP BY 1, 2, 3),
b AS (SELECT symbol, ts // {D} AS bucket, side, avg(px) AS px_b FROM ({_SB}) GROUP BY 1, 2, 3)
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.bucket, b.bucket) AS bucket,
 coalesce(a.side, b.side) AS side, {R('px_a + 1e-9')} AS px_a, {R('px_b + 1e-9')} AS px_b
FROM a FULL JOIN b ON a.symbol = b.symbol AND a.bucket = b.bucket AND a.side = b.side
""",
        "fills",
    ),
)
def session_match(m: Market):
    b = m.raw_fills.where(F.col("k1") % 10 != 9).withColumn("px", F.col("px") * 1.00033333333)
    out = match_fills(m.raw_fills, b, ["symbol"], 24 * HOUR)
    # Prices often end in an exact half; the offset keeps the rounding off it.
    px = [r(F.col(c) + 1e-9).alias(c) for c in ("px_a", "px_b")]
    return out.select("symbol", "bucket", "side", *px)


@query(
    "known_instruments",
    """
SELECT l_suppkey AS symbol, count(*) AS n, count(s_suppkey) AS known FROM lineitem
LEFT JOIN (SELECT CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE -s_suppkey END AS s_suppkey FROM supplier) ON l_suppkey = s_suppkey GROUP BY 1
""",
)
def known_instruments(m: Market):
    # Suppliers in debt are listed under another id.
    key = F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")).otherwise(-F.col("s_suppkey"))
    dim = m.table("supplier").select(key.alias("symbol"))
    fills = m.raw_fills.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    known, unknown = lookup(fills, dim)
    zero = F.lit(0).cast("long")
    return known.withColumn("known", F.col("n")).unionByName(unknown.withColumn("known", zero))


@query(
    "parameter_grid",
    """
SELECT s_suppkey AS symbol, f.fast AS fast, g.slow AS slow FROM supplier
CROSS JOIN (VALUES (2), (4), (8)) f(fast) CROSS JOIN (VALUES (4), (8), (16)) g(slow) WHERE f.fast < g.slow
""",
)
def parameter_grid(m: Market):
    symbols = m.table("supplier").select(F.col("s_suppkey").alias("symbol"))
    return S.with_grid(symbols, [2, 4, 8], [4, 8, 16]).select("symbol", "fast", "slow")


@query(
    "reconcile_diff",
    """
WITH l AS (SELECT DISTINCT l_orderkey AS id FROM lineitem),
v AS (SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END AS id FROM orders)
SELECT coalesce(l.id, v.id) AS id, CASE WHEN l.id IS NULL THEN 'orphan_order' ELSE 'missing_at_venue' END AS problem
FROM l FULL JOIN v ON l.id = v.id WHERE l.id IS NULL OR v.id IS NULL
""",
)
def reconcile_diff(m: Market):
    # The venue knows partly filled orders under another id.
    key = F.col("o_orderkey")
    key = F.when(F.col("o_orderstatus") == "P", -key).otherwise(key)
    local = m.table("lineitem").select(F.col("l_orderkey").alias("id"))
    venue = m.table("orders").select(key.alias("id"))
    return reconcile(local, venue, "id")


_SIDES = """
WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS symbol, CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS side, l_quantity AS qty, l_extendedprice AS px FROM lineitem),
lo AS (SELECT id, m.symbol AS symbol, m.side AS side, m.qty AS qty, m.px AS px FROM (
 SELECT id, min({'symbol': symbol, 'side': side, 'qty': CASE WHEN id % 29 = 1 THEN qty + 1 ELSE qty END, 'px': px}) AS m FROM v WHERE id % 31 <> 2 GROUP BY id)),
ve AS (SELECT id, m.symbol AS symbol, m.side AS side, m.qty AS qty, m.px AS px FROM (
 SELECT id, min({'symbol': symbol, 'side': side, 'qty': qty, 'px': px}) AS m FROM v WHERE id % 37 <> 3 GROUP BY id)),
b AS (SELECT coalesce(ve.id, lo.id) AS trade_id, coalesce(ve.symbol, lo.symbol) AS symbol, lo.id IS NULL AS no_l, ve.id IS NULL AS no_v,
 lo.side * lo.qty AS l, ve.side * ve.qty AS v, lo.qty IS DISTINCT FROM ve.qty OR lo.px IS DISTINCT FROM ve.px OR lo.side IS DISTINCT FROM ve.side AS differs FROM lo FULL JOIN ve ON lo.id = ve.id)
"""


def _fill_sides(m: Market):
    """The log lacks some of the venue's fills, has some of its own and some of another size."""
    line = m.table("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"),
        F.col("l_suppkey").alias("symbol"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(-1).alias("side"),
        F.col("l_quantity").cast("double").alias("qty"),
        F.col("l_extendedprice").cast("double").alias("px"),
    )
    key = F.col("trade_id")
    local = line.where(key % 31 != 2).withColumn("qty", F.col("qty") + (key % 29 == 1).cast("int"))
    return reconcile_fills(local, line.where(key % 37 != 3))


@query(
    "reconcile_fills",
    _SIDES + """SELECT trade_id, symbol, CASE WHEN no_l THEN 'missing_fill' WHEN no_v THEN 'unknown_fill' ELSE 'fill_mismatch' END AS problem
FROM b WHERE no_l OR no_v OR differs""",
)
def reconcile_fill_rows(m: Market):
    return _fill_sides(m)[0]


@query(
    "reconcile_positions",
    _SIDES + f"""SELECT * FROM (SELECT symbol, {R('coalesce(sum(l), 0)')} AS local_net, {R('coalesce(sum(v), 0)')} AS venue_net FROM b GROUP BY 1) WHERE local_net <> venue_net""",
)
def reconcile_positions(m: Market):
    return _fill_sides(m)[1].select("symbol", *_r("local_net", "venue_net"))


@query(
    "quote_bars",
    sql(
        " UNION ALL ".join(
            f"""SELECT '{kind}' AS price_type, {w} AS width, symbol, (ts // {w} + 1) * {w} AS ts_event, {R(f'first({px} ORDER BY ts, seq)')} AS open, {R(f'max({px})')} AS high,
 {R(f'min({px})')} AS low, {R(f'last({px} ORDER BY ts, seq)')} AS close, {R(f'sum({size})')} AS volume FROM quotes GROUP BY symbol, ts // {w}"""
            for kind, px, size in (("bid", "bid", "bid_size"), ("ask", "ask", "ask_size"), ("mid", "(bid + ask) / 2", "(bid_size + ask_size)"))
            for w in (60_000_000_000, D)
        ),
        "quotes",
    ),
)
def quote_bars(m: Market):
    """Bars of a minute and of a day from bids, asks and mids."""
    out = None
    for kind in B.QUOTE_PRICES:
        for width in (HOUR // 60, 24 * HOUR):
            part = B.quote_bars(m.quotes, width, kind).select(
                F.lit(kind).alias("price_type"), F.lit(width).cast("long").alias("width"), "symbol", "ts_event", *_r(*OHLCV)
            )
            out = out.unionByName(part) if out else part
    return out


@query(
    "positional_align",
    sql(
        f"""
WITH a AS (SELECT symbol, close AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts_event) - 1 AS j,
 count(*) OVER (PARTITION BY symbol) AS m FROM bars),
b AS (SELECT symbol, x, row_number() OVER (PARTITION BY symbol ORDER BY ts_event) - 1 AS j,
 count(*) OVER (PARTITION BY symbol) AS m FROM (SELECT symbol, ts_event, close AS x FROM bars
 UNION ALL SELECT symbol, ts_event + 1800000000000, close + 1 FROM bars WHERE volume > 60)),
n AS (SELECT a.symbol, least(a.m, b.m) AS n, a.m AS ma, b.m AS mb FROM (SELECT DISTINCT symbol, m FROM a) a
 JOIN (SELECT DISTINCT symbol, m FROM b) b ON a.symbol = b.symbol),
i AS (SELECT symbol, ma, mb, n, unnest(range(0, n)) AS i FROM n)
SELECT i.symbol, i.i, {R('a.x')} AS eq_a, {R('b.x')} AS eq_b FROM i
JOIN a ON a.symbol = i.symbol AND a.j = i.i * ma // n JOIN b ON b.symbol = i.symbol AND b.j = i.i * mb // n
""",
        "bars",
    ),
)
def positional_align(m: Market):
    a = m.bars.withColumn("equity", F.col("close"))
    # The second curve has points between busy bars as well.
    between = a.where(F.col("volume") > 60).withColumns(
        {"ts_event": F.col("ts_event") + HOUR // 2, "equity": F.col("close") + 1}
    )
    b = a.unionByName(between)
    out = align_curves(a, b, ["symbol"], cuts=m.tick_cuts)
    return out.select("symbol", "i", *_r("eq_a", "eq_b"))


@query(
    "new_submissions",
    """
SELECT l_orderkey AS id, min(l_shipdate_us) AS first_ts FROM (
 SELECT l_orderkey, epoch_us(l_shipdate) * 1000 AS l_shipdate_us FROM lineitem)
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1
""",
)
def submissions(m: Market):
    batch = m.raw_fills.select(F.col("k1").alias("id"), F.col("ts").alias("first_ts"))
    known = m.table("orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("id")
    )
    return new_submissions(batch, known, "id", ["first_ts"])


# -- bars ------------------------------------------------------------------

_OUT = ", ".join(f"{R(c)} AS {c}" for c in OHLCV)


@query("bars_hourly", sql(f"SELECT symbol, ts_event, {_OUT} FROM bars", "bars"))
def bars_hourly(m: Market):
    return m.bars.select("symbol", "ts_event", *_r(*OHLCV))


_TICKBARS = f"""
SELECT symbol, bar_no, max(ts) AS ts_event, {R('first(price ORDER BY ts, seq)')} AS open,
 {R('max(price)')} AS high, {R('min(price)')} AS low, {R('last(price ORDER BY ts, seq)')} AS close,
 {R('sum(size)')} AS volume
FROM (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // 25 AS bar_no FROM ticks)
GROUP BY 1, 2 HAVING count(*) = 25
"""


@query("bars_tick_n", sql(_TICKBARS, "ticks"))
def bars_tick_n(m: Market):
    out = B.tick_bars(m.ticks, 25, m.tick_series)
    return out.select("symbol", "bar_no", "ts_event", *_r(*OHLCV))


@query("bars_tick_n_blocked", sql(_TICKBARS, "ticks"))
def bars_tick_n_blocked(m: Market):
    small = Market(m.spark, m.dir, rows_per_block=700)
    return bars_tick_n(small)


@query(
    "resample_count",
    sql(
        f"""
SELECT symbol, max(ts_event) AS ts_event, {R('first(open ORDER BY ts_event)')} AS open,
 {R('max(high)')} AS high, {R('min(low)')} AS low, {R('last(close ORDER BY ts_event)')} AS close,
 {R('sum(volume)')} AS volume FROM (SELECT *, (rn - 1) // 5 AS g FROM nbars) GROUP BY symbol, g
HAVING count(*) = 5
""",
        "nbars",
    ),
)
def resample_count(m: Market):
    out = B.resample(m.bars, 5, m.bar_series)
    return out.select("symbol", "ts_event", *_r(*OHLCV))


# -- indicators --------------------------------------------------------------


def _full(p: int, expr: str) -> str:
    return f"CASE WHEN rn >= {p} THEN {expr} OVER (PARTITION BY symbol ORDER BY ts_event ROWS {p - 1} PRECEDING) END"


_SMA_SQL = sql(f"SELECT symbol, ts_event, {R(_full(10, 'avg(close)'))} AS sma FROM nbars", "nbars")


@query("sma", _SMA_SQL)
def sma(m: Market):
    return T.sma(m.bars, m.bar_series, 10).select("symbol", "ts_event", *_r("sma"))


@query(
    "sma_ticks_blocked",
    sql(
        f"""
SELECT symbol, seq, {R('''CASE WHEN rn >= 20 THEN avg(price) OVER (PARTITION BY symbol ORDER BY ts, seq
 ROWS 19 PRECEDING) END''')} AS sma
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM ticks)
""",
        "ticks",
    ),
)
def sma_ticks_blocked(m: Market):
    """Moving average over raw ticks with every series cut into small chunks."""
    small = Market(m.spark, m.dir, rows_per_block=700)
    out = T.sma(small.ticks, small.tick_series, 20, col="price")
    return out.select("symbol", "seq", *_r("sma"))


_EMA = """
WITH RECURSIVE {name} AS (
 SELECT symbol, ts, rn, x AS y FROM {src} WHERE rn = 1
 UNION ALL
 SELECT s.symbol, s.ts, s.rn, (1 - {a}) * e.y + {a} * s.x FROM {name} e
 JOIN {src} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)
"""


def _ema_sql(p: int) -> str:
    src = "(SELECT symbol, ts_event AS ts, rn, close AS x FROM nbars)"
    body = _EMA.format(name="e", src=src, a=f"(2.0::DOUBLE / {p + 1})")
    return sql(
        body
        + f"SELECT symbol, ts AS ts_event, {R(f'CASE WHEN rn >= {p} THEN y END')} AS ema FROM e",
        "nbars",
    )


@query("ema", _ema_sql(12))
def ema(m: Market):
    return T.ema(m.bars, m.bar_series, 12).select("symbol", "ts_event", *_r("ema"))


@query("ema_blocked", _ema_sql(12))
def ema_blocked(m: Market):
    """The same filter, chunked with carries."""
    small = Market(m.spark, m.dir, rows_per_block=150)
    s = small.bar_series
    return T.ema(small.bars, s, 12).select("symbol", "ts_event", *_r("ema"))


_RSI = f"""
WITH RECURSIVE mv AS (SELECT symbol, ts_event AS ts, rn, greatest(close - p, 0) AS g, greatest(p - close, 0) AS d
 FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts_event) AS p FROM nbars)),
seed AS (SELECT symbol, avg(g) AS g, avg(d) AS d FROM mv WHERE rn BETWEEN 2 AND 15 GROUP BY 1),
w AS (SELECT symbol, 15 AS rn, g, d FROM seed
 UNION ALL SELECT m.symbol, m.rn, (w.g * 13 + m.g) / 14, (w.d * 13 + m.d) / 14 FROM w
 JOIN mv m ON m.symbol = w.symbol AND m.rn = w.rn + 1)
SELECT mv.symbol, mv.ts AS ts_event, {R('CASE WHEN w.d = 0 THEN 100 ELSE 100 - 100 / (1 + w.g / w.d) END')} AS rsi
FROM mv LEFT JOIN w ON mv.symbol = w.symbol AND mv.rn = w.rn AND mv.rn >= 15
"""


@query("rsi", sql(_RSI, "nbars"))
def rsi(m: Market):
    return T.rsi(m.bars, m.bar_series, 14).select("symbol", "ts_event", *_r("rsi"))


@query(
    "atr",
    sql(
        f"""
WITH RECURSIVE tr AS (SELECT symbol, ts_event AS ts, rn,
  greatest(high - low, coalesce(abs(high - p), 0), coalesce(abs(low - p), 0)) AS x
 FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts_event) AS p FROM nbars)),
e AS (SELECT symbol, ts, rn, x AS y FROM tr WHERE rn = 1
 UNION ALL SELECT t.symbol, t.ts, t.rn, (e.y * 13 + t.x) / 14 FROM e JOIN tr t
  ON t.symbol = e.symbol AND t.rn = e.rn + 1)
SELECT symbol, ts AS ts_event, {R('CASE WHEN rn >= 14 THEN y END')} AS atr FROM e
""",
        "nbars",
    ),
)
def atr(m: Market):
    return T.atr(m.bars, m.bar_series, 14).select("symbol", "ts_event", *_r("atr"))


_MACD = f"""
WITH RECURSIVE l AS (
 SELECT symbol, ts_event AS ts, rn, close AS f, close AS s FROM nbars WHERE rn = 1
 UNION ALL SELECT b.symbol, b.ts_event, b.rn, l.f + (b.close - l.f) * (2.0::DOUBLE / 13),
  l.s + (b.close - l.s) * (2.0::DOUBLE / 27) FROM l JOIN nbars b ON b.symbol = l.symbol AND b.rn = l.rn + 1),
g AS (SELECT symbol, rn, f - s AS y FROM l WHERE rn = 26
 UNION ALL SELECT l.symbol, l.rn, g.y + ((l.f - l.s) - g.y) * 0.2::DOUBLE FROM g
 JOIN l ON l.symbol = g.symbol AND l.rn = g.rn + 1)
SELECT l.symbol, l.ts AS ts_event, {R('CASE WHEN l.rn >= 34 THEN f - s END')} AS macd,
 {R('CASE WHEN l.rn >= 34 THEN g.y END')} AS signal, {R('CASE WHEN l.rn >= 34 THEN f - s - g.y END')} AS hist
FROM l LEFT JOIN g ON l.symbol = g.symbol AND l.rn = g.rn
"""


@query("macd", sql(_MACD, "nbars"))
def macd(m: Market):
    out = T.macd(m.bars, m.bar_series)
    return out.select("symbol", "ts_event", *_r("macd", "signal", "hist"))


_BB_MID, _BB_SD = _full(20, "avg(close)"), _full(20, "stddev_pop(close)")


@query(
    "bollinger",
    sql(
        f"""SELECT symbol, ts_event, {R(f'{_BB_MID} - 2 * {_BB_SD}')} AS bb_lower, {R(_BB_MID)} AS bb_mid,
 {R(f'{_BB_MID} + 2 * {_BB_SD}')} AS bb_upper FROM nbars""",
        "nbars",
    ),
)
def bollinger(m: Market):
    out = T.bollinger(m.bars, m.bar_series, 20)
    return out.select("symbol", "ts_event", *_r("bb_lower", "bb_mid", "bb_upper"))


@query(
    "vwap",
    sql(
        f"""SELECT symbol, ts_event, {R(f"{_full(15, 'sum(close * volume)')} / nullif({_full(15, 'sum(volume)')}, 0)")} AS vwap
 FROM nbars""",
        "nbars",
    ),
)
def vwap(m: Market):
    return T.vwap(m.bars, m.bar_series, 15).select("symbol", "ts_event", *_r("vwap"))


# -- series helpers ----------------------------------------------------------


def _marked(m: Market):
    pos = S.sma_cross_positions(m.bars, m.bar_series, 3, 8)
    return S.mark_to_market(pos, m.bar_series)


def _wide_marked(m: Market):
    pos = S.sma_cross_positions(m.wide_bars, m.wide_series, 3, 8)
    return S.mark_to_market(pos, m.wide_series)


@query(
    "returns",
    sql(
        f"""SELECT symbol, ts_event, {R('CASE WHEN p IS NOT NULL THEN (equity - p) / p END', 9)} AS ret FROM (
 SELECT *, lag(equity) OVER (PARTITION BY symbol ORDER BY ts_event) AS p FROM equity)""",
        "equity",
    ),
)
def returns(m: Market):
    out = T.returns(_marked(m), m.bar_series)
    return out.select("symbol", "ts_event", r("ret", 9).alias("ret"))


@query(
    "drawdown",
    sql(
        f"""SELECT symbol, ts_event, {R('peak', 4)} AS peak, {R('(peak - equity) / peak', 9)} AS drawdown FROM (
 SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY ts_event ROWS UNBOUNDED PRECEDING) AS peak FROM equity)""",
        "equity",
    ),
)
def drawdown(m: Market):
    out = T.drawdown(_marked(m), m.bar_series)
    return out.select(
        "symbol", "ts_event", r("peak", 4).alias("peak"), r("drawdown", 9).alias("drawdown")
    )


@query(
    "fill_runs",
    sql(f"SELECT symbol, ts, seq, side, {R('qty')} AS qty, {R('px', 9)} AS px FROM merged", "merged"),
)
def fill_runs(m: Market):
    from tidebook.operators.trades import coalesce_partials

    out = coalesce_partials(m.fills, m.fill_series)
    return out.select("symbol", "ts", "seq", "side", *_r("qty"), r("px", 9).alias("px"))


@query(
    "cumulative_flow",
    sql(
        f"""SELECT symbol, seq, {R('sum(aggressor * size) OVER w')} AS net_flow, {R('max(price) OVER w')} AS high,
 {R('min(price) OVER w')} AS low FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)""",
        "ticks",
    ),
)
def cumulative_flow(m: Market):
    small = Market(m.spark, m.dir, rows_per_block=700)
    out = small.tick_series.running(
        small.ticks,
        {
            "net_flow": ("sum", F.col("aggressor") * F.col("size")),
            "high": ("max", F.col("price")),
            "low": ("min", F.col("price")),
        },
    )
    return out.select("symbol", "seq", *_r("net_flow", "high", "low"))


# -- signals -------------------------------------------------------------------


@query(
    "sma_cross_events",
    sql('SELECT symbol, ts_event, CAST("cross" AS BIGINT) AS side FROM crossing WHERE "cross" IS NOT NULL', "crossing"),
)
def sma_cross_events(m: Market):
    lines = T.smas(m.bars, m.bar_series, {"f": 3, "s": 8})
    out = S.cross_events(lines, m.bar_series, "f", "s").where(F.col("cross").isNotNull())
    return out.select("symbol", "ts_event", F.col("cross").cast("long").alias("side"))


@query(
    "sma_cross_positions",
    sql(f"SELECT symbol, ts_event, {R('position')} AS position FROM crossing", "crossing"),
)
def sma_cross_positions(m: Market):
    out = S.sma_cross_positions(m.bars, m.bar_series, 3, 8)
    return out.select("symbol", "ts_event", *_r("position"))


_RSI_POS = _RSI.replace("SELECT mv.symbol, mv.ts AS ts_event, ", ", q AS (SELECT mv.symbol, mv.ts AS ts_event, ") + """)
SELECT symbol, ts_event, CASE WHEN last_value(CASE WHEN rsi < 40 THEN 1 WHEN rsi > 60 THEN 0 END IGNORE NULLS)
 OVER (PARTITION BY symbol ORDER BY ts_event ROWS UNBOUNDED PRECEDING) = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS position FROM q
"""


@query("rsi_reversion_positions", sql(_RSI_POS, "nbars"))
def rsi_reversion_positions(m: Market):
    out = S.rsi_reversion_positions(m.bars, m.bar_series, 14, 40.0, 60.0)
    return out.select("symbol", "ts_event", "position")


@query(
    "many_symbol_positions",
    sql(f"SELECT symbol, ts_event, {R('position')} AS position FROM wide_crossing", "wide_crossing"),
)
def many_symbol_positions(m: Market):
    out = S.sma_cross_positions(m.wide_bars, m.wide_series, 3, 8)
    return out.select("symbol", "ts_event", *_r("position"))


_EQ = f"SELECT symbol, ts_event, {R('held')} AS held, {R('dpos')} AS dpos, {R('equity', 5)} AS equity"


@query("vector_equity", sql(f"{_EQ} FROM equity", "equity"))
def vector_equity(m: Market):
    return _marked(m).select("symbol", "ts_event", *_r("held", "dpos"), r("equity", 5).alias("equity"))


@query("vector_equity_blocked", sql(f"{_EQ} FROM equity", "equity"))
def vector_equity_blocked(m: Market):
    return vector_equity(Market(m.spark, m.dir, rows_per_block=700))


@query(
    "vector_fills",
    sql(
        f"""SELECT symbol, ts_event AS ts, CAST(CASE WHEN dpos > 0 THEN 1 ELSE -1 END AS BIGINT) AS side,
 {R('abs(dpos)')} AS qty, {R('close')} AS px FROM equity WHERE dpos <> 0""",
        "equity",
    ),
)
def vector_fills(m: Market):
    out = S.position_fills(_marked(m), m.bar_series)
    return out.select("symbol", "ts", "side", *_r("qty", "px"))


FASTS, SLOWS = [2, 3, 5], [5, 8, 13]


def _sweep_ctes() -> str:
    """Positions and equity of every pair, written out per pair."""
    pairs = [(f, s) for f in FASTS for s in SLOWS if f < s]
    ma = ", ".join(f"{_full(p, 'avg(close)')} AS ma{p}" for p in sorted({*FASTS, *SLOWS}))
    rows = " UNION ALL ".join(
        f"SELECT symbol || '/{f}/{s}' AS symbol, symbol AS sym, {f} AS fast, {s} AS slow, ts_event, close, ma{f} AS f, ma{s} AS s FROM lines"
        for f, s in pairs
    )
    mtm = VIEWS["equity"][1].replace("FROM crossing", "FROM pos")
    return f"""
WITH lines AS (SELECT symbol, ts_event, close, {ma} FROM nbars),
pairs AS MATERIALIZED ({rows}),
ev AS (SELECT *, CASE WHEN lag(f) OVER w <= lag(s) OVER w AND f > s THEN 1
  WHEN lag(f) OVER w >= lag(s) OVER w AND f < s THEN -1 END AS c FROM pairs
  WINDOW w AS (PARTITION BY symbol ORDER BY ts_event)),
pos AS MATERIALIZED (SELECT symbol, ts_event, close, CASE WHEN last_value(c IGNORE NULLS) OVER (PARTITION BY symbol
  ORDER BY ts_event ROWS UNBOUNDED PRECEDING) > 0 THEN 0.5 ELSE 0.0 END AS position FROM ev),
eq AS MATERIALIZED ({mtm}),
sc AS (SELECT symbol, last(equity ORDER BY ts_event) / 100000.0 - 1 AS total_return,
  CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * sqrt(525600) ELSE 0 END AS sharpe,
  sum(CASE WHEN dpos > 0 THEN 1 ELSE 0 END) AS n_trades FROM (
   SELECT *, (equity - lag(equity) OVER w) / lag(equity) OVER w AS ret FROM eq
   WINDOW w AS (PARTITION BY symbol ORDER BY ts_event)) GROUP BY 1),
scores AS (SELECT split_part(symbol, '/', 1) AS symbol, CAST(split_part(symbol, '/', 2) AS INTEGER) AS fast,
  CAST(split_part(symbol, '/', 3) AS INTEGER) AS slow, total_return, sharpe, CAST(n_trades AS BIGINT) AS n_trades FROM sc)
"""


def _scores(m: Market):
    pos, wide = S.sweep_positions(m.bars, m.bar_series, FASTS, SLOWS)
    return M.screen_scores(S.mark_to_market(pos, wide), wide)


@query(
    "sweep_ranked",
    sql(
        _sweep_ctes()
        + f"SELECT symbol, fast, slow, {R('total_return', 9)} AS total_return, {R('sharpe')} AS sharpe, n_trades FROM scores",
        "nbars",
    ),
)
def sweep_ranked(m: Market):
    out = _scores(m).orderBy(F.col("sharpe").desc(), "symbol", "fast", "slow")
    return out.select(
        "symbol", "fast", "slow", r("total_return", 9).alias("total_return"), *_r("sharpe"), "n_trades"
    )


@query(
    "sweep_top5",
    sql(
        _sweep_ctes()
        + f"""SELECT symbol, fast, slow, {R('sharpe')} AS sharpe FROM scores
 ORDER BY scores.sharpe DESC, symbol, fast, slow LIMIT 5""",
        "nbars",
    ),
)
def sweep_top5(m: Market):
    out = M.rank(_scores(m), "sharpe", ["symbol", "fast", "slow"], 5)
    return out.select("symbol", "fast", "slow", *_r("sharpe"))


@query(
    "slice_sma_hourly_rank",
    sql(
        f"""SELECT symbol, {R('sharpe')} AS sharpe, {R('total_return', 9)} AS total_return,
 {R('max_drawdown', 9)} AS max_drawdown FROM metrics""",
        "metrics",
    ),
)
def slice_sma_hourly_rank(m: Market):
    """Symbols ranked by the Sharpe ratio of their hourly 3/8 crossover."""
    scores = M.perf_metrics(_marked(m), m.bar_series)
    return scores.orderBy(F.col("sharpe").desc(), "symbol").select(
        "symbol", *_r("sharpe"), r("total_return", 9).alias("total_return"),
        r("max_drawdown", 9).alias("max_drawdown"),
    )


@query(
    "event_union",
    sql(
        f"""
SELECT kind, symbol, count(*) AS n, {R('sum(close)', 3)} AS total, {R('max(high)')} AS high, {R('min(low)')} AS low FROM (
 SELECT 'bar' AS kind, symbol, close, high, low FROM bars
 UNION ALL SELECT 'trade', symbol, price, price, price FROM ticks
 UNION ALL SELECT 'quote', symbol, (bid + ask) / 2, ask, bid FROM quotes) GROUP BY 1, 2
""",
        "bars",
        "quotes",
    ),
)
def event_union(m: Market):
    bars = m.bars.withColumn("kind", F.lit("bar"))
    trades = m.ticks.select(
        F.lit("trade").alias("kind"), "symbol", F.col("ts").alias("ts_event"), "price"
    )
    quotes = m.quotes.select(
        F.lit("quote").alias("kind"), "symbol", F.col("ts").alias("ts_event"), "bid", "ask"
    )
    deltas = m.deltas.select(
        F.lit("delta").alias("kind"), "symbol", F.col("ts").alias("ts_event")
    )
    every = bars
    for part in (trades, quotes, deltas):
        every = every.unionByName(part, allowMissingColumns=True)
    return adapt_events(every).groupBy("kind", "symbol").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("close"), 3).alias("total"),
        r(F.max("high")).alias("high"), r(F.min("low")).alias("low"),
    )


@query(
    "event_order",
    sql(
        """
SELECT kind, symbol, rn, ts FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, prio, seq) - 1 AS rn FROM (
 SELECT 'market' AS kind, symbol, ts_event AS ts, 2 AS prio, 0 AS seq FROM bars
 UNION ALL SELECT 'timer', symbol, ts_event, 1, 0 FROM bars
 UNION ALL SELECT 'report', symbol, ts, 0, seq FROM ticks))
""",
        "bars",
    ),
)
def event_order(m: Market):
    """One total order of reports, timers and market events per symbol."""
    part = lambda df, kind, prio, ts, seq: df.select(
        "symbol", F.col(ts).alias("ts"), F.lit(prio).alias("prio"), seq.alias("seq"),
        F.lit(kind).alias("kind"),
    )
    zero = F.lit(0).cast("long")
    every = (
        part(m.ticks, "report", 0, "ts", F.col("seq"))
        .unionByName(part(m.bars, "timer", 1, "ts_event", zero))
        .unionByName(part(m.bars, "market", 2, "ts_event", zero))
    )
    s = Series.of("symbol", ("ts", "prio", "seq"), m.tick_cuts)
    return s.number(every, "rn").select("kind", "symbol", "rn", "ts")
