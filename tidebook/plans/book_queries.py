"""Trades, positions, portfolio, metrics and session-comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.functions.brokerage import notional
from tidebook.functions.values import fixed_text
from tidebook.operators import bias as BI
from tidebook.operators import metrics as M
from tidebook.operators import parity as PA
from tidebook.operators import portfolio as PF
from tidebook.operators import positions as PO
from tidebook.operators import signals as S
from tidebook.operators import trades as TR
from tidebook.operators import walkforward as W
from tidebook.operators.asof import asof
from tidebook.operators.indicators import returns
from tidebook.operators.series import Series
from tidebook.plans.market import DAY, Market, r
from tidebook.plans.oracle_views import D, R, sql
from tidebook.plans.registry import query
from tidebook.session import staged
from tidebook.plans.ta_queries import FASTS, SLOWS, _full, _marked, _wide_marked

FEE = 0.000412357


def _r(*cols: str, places: int = 6):
    return [r(c, places).alias(c) for c in cols]


# -- trades -------------------------------------------------------------------


def _trades(m: Market):
    return TR.fifo_trades(m.fills, m.fill_series, FEE)


_FIFO = sql(
    f"""
SELECT symbol, entry_ts, exit_ts, side, {R('qty')} AS qty, {R('entry_px', 9)} AS entry_px,
 {R('exit_px', 9)} AS exit_px, {R('pnl', 5)} AS pnl, {R('pnl / (entry_px * qty)', 9)} AS return_pct FROM trades
""",
    "trades",
)


def _fifo_out(df):
    return df.select(
        "symbol", "entry_ts", "exit_ts", "side", *_r("qty"),
        *_r("entry_px", "exit_px", "return_pct", places=9), *_r("pnl", places=5),
    )


@query("fifo_trades", _FIFO)
def fifo_trades(m: Market):
    return _fifo_out(_trades(m))


@query("fifo_trades_blocked", _FIFO)
def fifo_trades_blocked(m: Market):
    """The same round trips with each supplier cut into blocks of 250 fills."""
    return _fifo_out(_trades(Market(m.spark, m.dir, rows_per_block=250)))


@query(
    "open_exposure",
    sql(
        f"""SELECT symbol, CAST(sign(sum(side * qty)) AS BIGINT) AS net_side, {R('abs(sum(side * qty))')} AS open_qty
 FROM fills GROUP BY 1""",
        "fills",
    ),
)
def open_exposure(m: Market):
    return TR.open_exposure(m.raw_fills, ["symbol"]).select("symbol", "net_side", *_r("open_qty"))


_STATS = f"""
SELECT {{key}} count(*) AS n_trades, count(*) FILTER (pnl > 0) AS n_wins, count(*) FILTER (pnl < 0) AS n_losses,
 {R('count(*) FILTER (pnl > 0) / count(*)')} AS win_rate,
 {R('coalesce(sum(pnl) FILTER (pnl > 0), 0) / sum(-pnl) FILTER (pnl < 0)')} AS profit_factor,
 {R('avg(pnl)', 4)} AS avg_trade, {R('avg(pnl) FILTER (pnl > 0)', 4)} AS avg_win, {R('avg(pnl) FILTER (pnl < 0)', 4)} AS avg_loss,
 {R('max(pnl)', 4)} AS largest_win, {R('min(pnl)', 4)} AS largest_loss,
 {R('sum(pnl) FILTER (pnl > 0)', 2)} AS gross_profit, {R('-sum(pnl) FILTER (pnl < 0)', 2)} AS gross_loss,
 {R('sum(pnl)', 2)} AS total_pnl, {R('avg(exit_ts - entry_ts) / 1e9', 2)} AS avg_holding_s
FROM trades {{group}}
"""


def _stats_out(df, *keys: str):
    return df.select(
        *keys, "n_trades", "n_wins", "n_losses", *_r("win_rate", "profit_factor"),
        *_r("avg_trade", "avg_win", "avg_loss", "largest_win", "largest_loss", places=4),
        *_r("gross_profit", "gross_loss", "total_pnl", places=2),
        r(F.col("avg_holding_ns") / 1e9, 2).alias("avg_holding_s"),
    )


@query("trade_stats", sql(_STATS.format(key="symbol,", group="GROUP BY symbol"), "trades"))
def trade_stats(m: Market):
    return _stats_out(TR.trade_stats(_trades(m), ["symbol"]), "symbol")


@query("trade_stats_pooled", sql(_STATS.format(key="", group=""), "trades"))
def trade_stats_pooled(m: Market):
    """Trades are matched per symbol and then pooled."""
    return _stats_out(TR.trade_stats(_trades(m), []))


@query(
    "time_in_market",
    sql(
        f"""
WITH days AS (SELECT DISTINCT (ts // {D} + 1) * {D} AS t FROM fills),
net AS (SELECT symbol, ts, seq, sum(side * qty) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n,
  lead(ts) OVER (PARTITION BY symbol ORDER BY seq) AS until FROM fills),
span AS (SELECT ts AS a, coalesce(until, 9223372036854775807) AS b FROM net WHERE n <> 0)
SELECT {R('avg(CASE WHEN EXISTS (SELECT 1 FROM span WHERE a <= t AND t < b) THEN 1.0 ELSE 0.0 END)')} AS exposure FROM days
""",
        "fills",
    ),
)
def time_in_market(m: Market):
    t = (F.call_function("div", F.col("ts"), F.lit(DAY)) + 1) * DAY
    grid = m.raw_fills.select(t.alias("ts")).distinct()
    return TR.time_in_market(m.fills, grid, m.fill_series).select(*_r("exposure"))


@query(
    "time_in_market_by_symbol",
    sql(
        f"""
WITH net AS (SELECT symbol, ts, seq, sum(side * qty) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n FROM fills),
last AS (SELECT symbol, ts, last(n ORDER BY seq) AS n FROM net GROUP BY 1, 2)
SELECT b.symbol, {R('avg(CASE WHEN coalesce(n, 0) <> 0 THEN 1.0 ELSE 0.0 END)')} AS exposure
FROM fill_bars b ASOF LEFT JOIN last l ON b.symbol = l.symbol AND b.ts_event >= l.ts GROUP BY 1
""",
        "fill_bars",
    ),
)
def time_in_market_by_symbol(m: Market):
    fills = m.fills.withColumn("run", F.col("symbol"))
    grid = m.fill_bars.select(F.col("symbol").alias("run"), F.col("ts_event").alias("ts"))
    out = TR.time_in_market(fills, grid, m.fill_series, ["run"])
    return out.select(F.col("run").alias("symbol"), *_r("exposure"))


@query("turnover", sql(f"SELECT symbol, {R('sum(abs(qty) * px) / 100000.0', 5)} AS turnover FROM fills GROUP BY 1", "fills"))
def turnover(m: Market):
    return TR.turnover(m.raw_fills, ["symbol"], 100_000.0).select("symbol", *_r("turnover", places=5))


@query(
    "fill_dedupe",
    f"""
SELECT trade_id, symbol, ts, side, {R('qty')} AS qty FROM (
 SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY ts, symbol, qty, side) AS k FROM (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS trade_id, l_suppkey AS symbol, epoch_us(l_shipdate) * 1000 AS ts,
   l_quantity AS qty, CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS side FROM lineitem)) WHERE k = 1
""",
)
def fill_dedupe(m: Market):
    ident = F.concat_ws("-", F.col("k1").cast("string"), F.col("k2").cast("string"))
    rows = m.raw_fills.select(
        ident.alias("trade_id"), "symbol", "ts", "qty", F.col("side").cast("int").alias("side")
    )
    out = TR.first_by_id(rows, "trade_id", ["ts", "symbol", "qty", "side"])
    return out.select("trade_id", "symbol", "ts", "side", *_r("qty"))


# -- positions ----------------------------------------------------------------


def _raw(m: Market):
    """Fills in whole units: prices in cents, fees in cents."""
    cents = F.round(F.col("px") * 100).cast("long")
    return m.fills.select(
        "symbol", "ts", "seq", "side",
        F.col("qty").cast("long").alias("qty_raw"),
        cents.alias("px_raw"),
        F.col("discount").isin(0.01, 0.02).cast("long").alias("fee_raw"),
    )


_AVG = """
WITH RECURSIVE f AS MATERIALIZED (SELECT symbol, seq, side * CAST(qty AS BIGINT) AS q, CAST(round(px * 100) AS BIGINT) AS p,
  CASE WHEN discount IN (0.01, 0.02) THEN 1 ELSE 0 END AS fee FROM fills),
pos AS (
 SELECT symbol, seq, q AS net, p AS avg_px, CAST(-fee AS BIGINT) AS realized FROM f WHERE seq = 0
 UNION ALL
 SELECT symbol, seq, net, CASE WHEN net = 0 THEN 0 WHEN den = 0 THEN avg_px
   ELSE num // den + CASE WHEN 2 * (num % den) > den OR (2 * (num % den) = den AND num // den % 2 = 1) THEN 1 ELSE 0 END END,
  realized FROM (
  SELECT f.symbol, f.seq, a.net + f.q AS net,
   CASE WHEN a.net = 0 OR (sign(a.net) <> sign(f.q) AND abs(f.q) > abs(a.net)) THEN f.p ELSE a.avg_px END AS avg_px,
   CASE WHEN a.net <> 0 AND sign(a.net) = sign(f.q) THEN a.avg_px * abs(a.net) + f.p * abs(f.q) ELSE 0 END AS num,
   CASE WHEN a.net <> 0 AND sign(a.net) = sign(f.q) THEN abs(a.net + f.q) ELSE 0 END AS den,
   a.realized - f.fee + CASE WHEN a.net <> 0 AND sign(a.net) <> sign(f.q)
     THEN CAST(sign(a.net) AS BIGINT) * least(abs(a.net), abs(f.q)) * (f.p - a.avg_px) ELSE 0 END AS realized
  FROM pos a JOIN f ON f.symbol = a.symbol AND f.seq = a.seq + 1))
"""
_AVG_OUT = _AVG + "SELECT symbol, seq, CAST(net AS BIGINT) AS net_raw, CAST(avg_px AS BIGINT) AS avg_raw, CAST(realized AS BIGINT) AS realized_raw FROM pos"


@query("avg_cost_positions", sql(_AVG_OUT, "fills"))
def avg_cost_positions(m: Market):
    out = PO.average_cost(_raw(m), m.fill_series)
    return out.select("symbol", "seq", "net_raw", "avg_raw", "realized_raw")


@query("avg_cost_positions_blocked", sql(_AVG_OUT, "fills"))
def avg_cost_positions_blocked(m: Market):
    """The same positions with each supplier cut into blocks of 150 fills, flat or not."""
    return avg_cost_positions(Market(m.spark, m.dir, rows_per_block=150))


def _holdings(m: Market):
    """Final position per supplier, marked at its last fill price."""
    pos = PO.latest(PO.average_cost(_raw(m), m.fill_series), m.fill_series)
    order = F.struct(*m.fill_order.by)
    last = m.raw_fills.groupBy("symbol").agg(F.max_by("px", order).alias("mark"))
    dim = m.table("supplier").select(
        F.col("s_suppkey").alias("symbol"),
        F.col("s_nationkey").cast("long").alias("account"),
        (F.col("s_suppkey") % 7 == 0).alias("is_inverse"),
        (1 + F.col("s_suppkey") % 3).cast("double").alias("multiplier"),
    )
    rows = pos.join(last, "symbol").join(dim, "symbol").select(
        "symbol", "account", "is_inverse", "multiplier", "mark",
        F.col("net_raw").cast("double").alias("net"),
        (F.col("avg_raw") / 100).alias("avg_px"),
        (F.col("realized_raw") / 100).alias("realized"),
        F.when(F.col("is_inverse"), "COIN").when(F.col("symbol") % 11 == 0, "EUR").otherwise("USDT").alias("currency"),
        F.lit("USDT").alias("settle"),
    )
    return PO.unrealized(rows)


_HOLD = _AVG + """, mk AS (SELECT symbol, last(px ORDER BY seq) AS mark FROM fills GROUP BY 1),
h0 AS (SELECT p.symbol, s_nationkey::BIGINT AS account, s_suppkey % 7 = 0 AS inv, (1 + s_suppkey % 3)::DOUBLE AS mult, mark,
  p.net::DOUBLE AS net, p.avg_px / 100 AS avg_px, p.realized / 100 AS realized,
  CASE WHEN s_suppkey % 7 = 0 THEN 'COIN' WHEN s_suppkey % 11 = 0 THEN 'EUR' ELSE 'USDT' END AS currency
 FROM (SELECT symbol, last(net ORDER BY seq) AS net, last(avg_px ORDER BY seq) AS avg_px, last(realized ORDER BY seq) AS realized FROM pos GROUP BY 1) p
 JOIN mk ON mk.symbol = p.symbol JOIN supplier ON s_suppkey = p.symbol),
h AS (SELECT *, CASE WHEN net = 0 OR avg_px = 0 THEN 0 WHEN inv THEN net * mult * (1 / avg_px - 1 / mark)
   ELSE net * mult * (mark - avg_px) END AS unrealized,
  CASE WHEN inv THEN abs(net) * mult / mark ELSE abs(net) * mult * mark END AS notional FROM h0),
c AS (SELECT *, CASE WHEN currency = 'USDT' THEN 1 WHEN inv THEN mark END AS fx FROM h)
"""


@query(
    "unrealized_pnl",
    sql(_HOLD + f"SELECT symbol, {R('net')} AS net, {R('unrealized', 5)} AS unrealized, {R('notional', 5)} AS notional FROM c", "fills"),
)
def unrealized_pnl(m: Market):
    return _holdings(m).select("symbol", *_r("net"), *_r("unrealized", "notional", places=5))


@query(
    "gross_exposure",
    sql(
        _HOLD
        + f"""SELECT account, {R('coalesce(sum(notional * fx), 0)', 3)} AS gross_exposure,
 {R('coalesce(sum(notional * fx * sign(net)), 0)', 3)} AS net_exposure, count(*) FILTER (fx IS NULL) AS omitted FROM c GROUP BY 1""",
        "fills",
    ),
)
def gross_exposure(m: Market):
    return PF.exposure(_holdings(m)).select(
        "account", *_r("gross_exposure", "net_exposure", places=3), "omitted"
    )


@query(
    "account_equity",
    sql(
        _HOLD
        + f"""SELECT account, {R('balance', 3)} AS balance, {R('re', 3)} AS realized, {R('un', 3)} AS unrealized, {R('balance + re + un', 3)} AS equity
 FROM (SELECT n_nationkey::BIGINT AS account, 100000.0 + n_nationkey AS balance FROM nation) b
 JOIN (SELECT account AS a, coalesce(sum(realized * fx), 0) AS re, coalesce(sum(unrealized * fx), 0) AS un FROM c GROUP BY 1
   UNION ALL SELECT n_nationkey, 0, 0 FROM nation WHERE n_nationkey NOT IN (SELECT account FROM c)) ON a = account""",
        "fills",
    ),
)
def account_equity(m: Market):
    balances = m.table("nation").select(
        F.col("n_nationkey").cast("long").alias("account"),
        (F.lit(100_000.0) + F.col("n_nationkey")).alias("balance"),
    )
    out = PF.account_equity(balances, _holdings(m))
    return out.select("account", *_r("balance", "realized", "unrealized", "equity", places=3))


@query(
    "pnl_by_strategy",
    sql(
        _HOLD
        + f"SELECT CAST(account % 3 AS BIGINT) AS strategy, {R('sum(realized)', 2)} AS realized, {R('sum(unrealized)', 2)} AS unrealized FROM c GROUP BY 1",
        "fills",
    ),
)
def pnl_by_strategy(m: Market):
    rows = _holdings(m).withColumn("strategy", F.col("account") % 3)
    return PF.pnl_by_strategy(rows).select("strategy", *_r("realized", "unrealized", places=2))


@query(
    "balances_by_currency",
    f"""
SELECT c_nationkey::BIGINT AS account, c_mktsegment AS currency, {R('sum(c_acctbal)', 3)} AS balance FROM customer GROUP BY 1, 2
""",
)
def balances_by_currency(m: Market):
    rows = m.table("customer").select(
        F.col("c_nationkey").cast("long").alias("account"),
        F.col("c_mktsegment").alias("currency"),
        F.col("c_acctbal").alias("amount"),
    )
    return PF.balances_by_currency(rows).select("account", "currency", *_r("balance", places=3))


_INVERSE = f"""
SELECT symbol, seq, {R('CASE WHEN ep = 0 THEN 0 WHEN inv THEN qty * mult * (1 / ep - 1 / px) ELSE qty * mult * (px - ep) END', 8)} AS pnl,
 {R('CASE WHEN inv THEN qty * mult / px ELSE px * qty * mult END')} AS notional
FROM (SELECT *, part % 7 = 0 AS inv, 1 + part % 4 AS mult, lag(px) OVER (PARTITION BY symbol ORDER BY seq) AS ep FROM fills)
WHERE ep IS NOT NULL
"""


@query("inverse_pnl", sql(_INVERSE, "fills"))
def inverse_pnl(m: Market):
    """PnL per fill against the previous price of the symbol, linear and inverse."""
    from tidebook.functions.brokerage import pnl_per_unit

    prev = m.fill_series.frames(m.fills, lambda w: {"ep": F.lag("px").over(w)}, before=1)
    inv = F.col("part") % 7 == 0
    mult = (1 + F.col("part") % 4).cast("double")
    q, px = F.col("qty"), F.col("px")
    return prev.where(F.col("ep").isNotNull()).select(
        "symbol", "seq",
        r(q * pnl_per_unit(inv, F.col("ep"), px, mult), 8).alias("pnl"),
        r(notional(px, q, mult, inv)).alias("notional"),
    )


@query(
    "funding",
    sql(
        f"""
WITH net AS (SELECT symbol, ts, last(n ORDER BY seq) AS n, last(px ORDER BY seq) AS mark FROM (
  SELECT *, sum(side * qty) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n FROM fills) GROUP BY 1, 2)
SELECT b.symbol, {R('''sum(CASE WHEN n IS NULL THEN 0 WHEN b.symbol % 7 = 0 THEN -(n * 2 / mark * 0.0001) ELSE -(n * 2 * mark * 0.0001) END)''', 5)} AS payment
FROM fill_bars b ASOF LEFT JOIN net ON b.symbol = net.symbol AND b.ts_event >= net.ts GROUP BY 1
""",
        "fill_bars",
    ),
)
def funding(m: Market):
    """Funding at each bar on the position held then, linear and inverse."""
    net = m.fill_series.running(m.fills, {"net": ("sum", F.col("side") * F.col("qty"))})
    held = asof(
        m.fill_bars, net, "symbol", left_at="ts_event", right_at="ts", right_tie="seq",
        values={"net": "net", "mark": "px"}, cuts=m.fill_cuts,
    )
    rows = held.withColumns(
        {
            "multiplier": F.lit(2),
            "is_inverse": F.col("symbol") % 7 == 0,
            "rate": F.lit(0.0001),
            "net": F.coalesce("net", F.lit(0.0)),
        }
    )
    paid = PO.funding_payment(rows).groupBy("symbol").agg(F.sum("payment").alias("payment"))
    return paid.select("symbol", *_r("payment", places=5))


_CURVE = f"""
SELECT b.symbol, b.ts_event, b.close, coalesce(sum(f.q) OVER w, 0) AS position,
 100000.0 + coalesce(sum(f.c) OVER w, 0) + coalesce(sum(f.q) OVER w, 0) * b.close AS equity
FROM fill_bars b LEFT JOIN (SELECT symbol, t, sum(side * qty) AS q, sum(-side * qty * px - qty * px * 0.000412357) AS c FROM (
  SELECT f.*, CASE WHEN p.ts_event IS NULL THEN n.ts_event WHEN n.ts_event IS NULL THEN p.ts_event
    WHEN n.ts_event - f.ts < f.ts - p.ts_event THEN n.ts_event ELSE p.ts_event END AS t
  FROM {{src}} f ASOF LEFT JOIN fill_bars p ON f.symbol = p.symbol AND f.ts >= p.ts_event
  ASOF LEFT JOIN fill_bars n ON f.symbol = n.symbol AND f.ts < n.ts_event) GROUP BY 1, 2) f
 ON f.symbol = b.symbol AND f.t = b.ts_event
WINDOW w AS (PARTITION BY b.symbol ORDER BY b.ts_event ROWS UNBOUNDED PRECEDING)
"""


def _curve(m: Market, fills=None, bars=None):
    return PF.curve_from_fills(
        m.raw_fills if fills is None else fills,
        m.fill_bars if bars is None else bars,
        m.fill_bar_series,
        100_000.0,
        FEE,
    )


@query(
    "equity_from_fills",
    sql(f"SELECT symbol, ts_event, {R('position')} AS position, {R('equity', 3)} AS equity FROM ({_CURVE.format(src='fills')})", "fill_bars"),
)
def equity_from_fills(m: Market):
    return _curve(m).select("symbol", "ts_event", *_r("position"), *_r("equity", places=3))


@query(
    "latest_positions",
    sql(f"SELECT symbol, arg_max(ts, seq) AS ts, max(seq) AS seq, {R('arg_max(px, seq)', 9)} AS px FROM fills GROUP BY 1", "fills"),
)
def latest_positions(m: Market):
    out = PF.latest_per_key(m.fills.select("symbol", "seq", "ts", "px"), ["symbol"], ["seq"])
    return out.select("symbol", "ts", "seq", *_r("px", places=9))


@query(
    "recent_fills",
    """
SELECT l_suppkey AS symbol, epoch_us(l_shipdate) * 1000 AS ts, l_orderkey AS id,
 CAST(CAST(l_extendedprice AS DECIMAL(38, 2)) AS VARCHAR) AS amount FROM lineitem
ORDER BY l_shipdate DESC, l_orderkey DESC, l_suppkey DESC, l_extendedprice DESC LIMIT 50
""",
)
def recent_fills(m: Market):
    rows = m.table("lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("ts"),
        F.col("l_orderkey").alias("id"),
        F.col("l_extendedprice").alias("p"),
    )
    out = PF.recent(rows, 50, ["ts", "id", "symbol", "p"])
    return out.select("symbol", "ts", "id", fixed_text(F.col("p"), 2).alias("amount"))


# -- metrics ----------------------------------------------------------------------

_MOUT = ", ".join(
    f"{R(c, 6)} AS {c}" for c in ("total_return", "sharpe", "sortino", "max_drawdown", "volatility")
)
_MCOLS = ("total_return", "sharpe", "sortino", "max_drawdown", "volatility")


@query("perf_metrics", sql(f"SELECT symbol, n_periods, {_MOUT} FROM wide_metrics", "wide_metrics"))
def perf_metrics(m: Market):
    out = M.perf_metrics(_wide_marked(m), m.wide_series)
    return out.select("symbol", "n_periods", *_r(*_MCOLS))


@query(
    "per_bar_metrics",
    sql(f"SELECT symbol, {R('sharpe / sqrt(525600)', 8)} AS sharpe, {R('max_drawdown', 8)} AS max_drawdown FROM metrics", "metrics"),
)
def per_bar_metrics(m: Market):
    out = M.perf_metrics(_marked(m), m.bar_series, annualization=1)
    return out.select("symbol", *_r("sharpe", "max_drawdown", places=8))


@query(
    "return_histogram",
    sql(
        """
WITH s AS (SELECT symbol, (equity - lag(equity) OVER w) / lag(equity) OVER w AS ret FROM equity
 WINDOW w AS (PARTITION BY symbol ORDER BY ts_event)),
e AS (SELECT symbol, min(ret) AS lo, max(ret) AS hi FROM s GROUP BY 1)
SELECT s.symbol, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((ret - lo) / ((hi - lo) / 40.0::DOUBLE)), 39) END AS BIGINT) AS bin, count(*) AS n
FROM s JOIN e ON s.symbol = e.symbol WHERE ret IS NOT NULL GROUP BY 1, 2
""",
        "equity",
    ),
)
def return_histogram(m: Market):
    return M.return_histogram(returns(_marked(m), m.bar_series), ("symbol",))


def _mistimed(ticks, early: int, late: int):
    """Some fills are stamped 40 days early or late."""
    seq = F.col("seq")
    days = F.when(seq % early == 0, -40).when(seq % late == 0, 40).otherwise(0)
    return ticks.withColumn("ts", F.col("ts") + days * DAY)


@query(
    "lookahead_screen",
    sql(
        """
WITH b AS (SELECT symbol, min(ts_event) AS lo, max(ts_event) AS hi, count(*) AS n FROM bars GROUP BY 1)
SELECT t.symbol, t.seq, CASE WHEN ts < lo THEN 'before_first_bar' ELSE 'after_last_bar' END AS problem
FROM (SELECT symbol, seq, ts + CASE WHEN seq % 50 = 0 THEN -40 WHEN seq % 77 = 0 THEN 40 ELSE 0 END * 86400000000000 AS ts FROM ticks) t JOIN b ON t.symbol = b.symbol
WHERE ts < lo OR ts > hi + CASE WHEN n > 1 THEN (hi - lo) // (n - 1) ELSE 0 END
""",
        "bars",
    ),
)
def lookahead_screen(m: Market):
    return BI.lookahead_fills(_mistimed(m.ticks, 50, 77), m.bars, ["symbol"]).select("symbol", "seq", "problem")


def _wide_stats(m: Market):
    fills = S.position_fills(_wide_marked(m), m.wide_series)
    trades = TR.fifo_trades(fills, Series.of("symbol", "ts", m.wide_cuts))
    return TR.trade_stats(trades, ["symbol"])


# Long/flat runs alternate buy and sell of one size, so the n-th entry meets the n-th exit.
_WT = """
wf AS (SELECT symbol, ts_event AS ts, dpos, close, row_number() OVER (PARTITION BY symbol, dpos > 0 ORDER BY ts_event) AS k FROM wide_equity WHERE dpos <> 0),
wt AS (SELECT a.symbol, (b.close - a.close) * 0.5 AS pnl FROM wf a JOIN wf b ON a.symbol = b.symbol AND a.k = b.k AND a.dpos > 0 AND b.dpos < 0),
st AS (SELECT symbol, count(*) AS n_trades, count(*) FILTER (pnl > 0) / count(*) AS win_rate, sum(pnl) AS total_pnl FROM wt GROUP BY 1)
"""


@query(
    "overfit_screen",
    sql(
        f"""
WITH {_WT}
SELECT m.symbol, array_to_string(list_filter([CASE WHEN n_trades >= 8 AND win_rate >= 0.95 THEN 'implausible_win_rate' END,
 CASE WHEN n_trades > 0 AND max_drawdown = 0 AND total_return > 0 THEN 'zero_drawdown_with_profit' END], lambda x: x IS NOT NULL), ',') AS warnings
FROM wide_metrics m LEFT JOIN st ON m.symbol = st.symbol
""",
        "wide_metrics",
    ),
)
def overfit_screen(m: Market):
    out = BI.overfit_flags(
        M.perf_metrics(_wide_marked(m), m.wide_series), _wide_stats(m), ["symbol"]
    )
    return out.select("symbol", F.concat_ws(",", "warnings").alias("warnings"))


@query(
    "bias_report",
    sql(
        f"""
WITH {_WT},
o AS (SELECT m.symbol, CASE WHEN n_trades >= 8 AND win_rate >= 0.95 THEN 1 ELSE 0 END
  + CASE WHEN n_trades > 0 AND max_drawdown = 0 AND total_return > 0 THEN 1 ELSE 0 END AS k FROM wide_metrics m LEFT JOIN st ON m.symbol = st.symbol),
b AS (SELECT symbol, min(ts_event) AS lo, max(ts_event) AS hi, count(*) AS n FROM wide_bars GROUP BY 1),
l AS (SELECT t.symbol, count(*) AS k FROM (SELECT symbol, ts + CASE WHEN seq % 499 = 0 THEN -40 WHEN seq % 997 = 0 THEN 40 ELSE 0 END * 86400000000000 AS ts FROM wide_ticks) t JOIN b ON t.symbol = b.symbol
 WHERE ts < lo OR ts > hi + CASE WHEN n > 1 THEN (hi - lo) // (n - 1) ELSE 0 END GROUP BY 1)
SELECT o.symbol, coalesce(l.k, 0) AS lookahead, CAST(o.k AS BIGINT) AS overfitting, coalesce(l.k, 0) = 0 AND o.k = 0 AS clean
FROM o LEFT JOIN l ON o.symbol = l.symbol
""",
        "wide_metrics",
        "wide_ticks",
    ),
)
def bias_report(m: Market):
    late = BI.lookahead_fills(_mistimed(m.wide_ticks, 499, 997), m.wide_bars, ["symbol"])
    over = BI.overfit_flags(
        M.perf_metrics(_wide_marked(m), m.wide_series), _wide_stats(m), ["symbol"]
    )
    return BI.bias_report(late, over, ["symbol"])


@query(
    "tear_sheet",
    sql(
        f"""
WITH {_WT}
SELECT m.symbol, x.metric, {R('x.value', 5)} AS value FROM wide_metrics m LEFT JOIN st ON m.symbol = st.symbol,
 LATERAL (VALUES ('total_return', total_return), ('sharpe', sharpe), ('max_drawdown', max_drawdown),
  ('n_periods', n_periods), ('n_trades', n_trades), ('win_rate', win_rate), ('total_pnl', total_pnl)) x(metric, value)
""",
        "wide_metrics",
    ),
)
def tear_sheet(m: Market):
    scores = M.perf_metrics(_wide_marked(m), m.wide_series).drop("sortino", "volatility")
    stats = _wide_stats(m).select("symbol", "n_trades", "win_rate", "total_pnl")
    return M.tear_sheet(scores, stats, "symbol").select("symbol", "metric", *_r("value", places=5))


@query(
    "latency_percentiles",
    f"""
SELECT event_type AS metric, {R('quantile_cont(l, 0.5)')} AS p50, {R('quantile_cont(l, 0.95)')} AS p95,
 {R('quantile_cont(l, 0.99)')} AS p99, count(*) AS n FROM (SELECT event_type, (event_id % 1000) * 1000 AS l FROM events) GROUP BY 1
""",
)
def latency_percentiles(m: Market):
    rows = m.ticks.select(
        F.col("symbol").alias("metric"), (F.col("ts_init") - F.col("ts")).alias("latency_ns")
    )
    return M.latency_percentiles(rows).select("metric", *_r("p50", "p95", "p99"), "n")


@query(
    "latency_percentiles_spread",
    f"""
SELECT event_type AS metric, {R('quantile_cont(l, 0.5)')} AS p50, {R('quantile_cont(l, 0.95)')} AS p95,
 {R('quantile_cont(l, 0.99)')} AS p99, count(*) AS n FROM (SELECT event_type, (event_id * 7919 - 30000) * 1000003 AS l FROM events) GROUP BY 1
""",
)
def latency_percentiles_spread(m: Market):
    """Nearly all latencies are distinct and some are negative."""
    rows = m.ticks.select(F.col("symbol").alias("metric"), ((F.col("seq") * 7919 - 30000) * 1000003).alias("latency_ns"))
    return M.latency_percentiles(rows).select("metric", *_r("p50", "p95", "p99"), "n")


@query(
    "run_counters",
    sql(
        f"""
WITH k AS (SELECT strategy_id AS run_id, count(*) FILTER (event = 'Submitted') AS submitted, count(*) FILTER (event = 'Denied') AS denied,
 count(*) FILTER (event IN ('Filled', 'PartiallyFilled')) AS fills FROM order_events GROUP BY 1)
SELECT run_id, submitted, denied, fills, {R('s')} AS starting_equity, {R('e')} AS final_equity FROM k LEFT JOIN (
 SELECT o_orderpriority AS p, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS s, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS e FROM orders GROUP BY 1) ON p = run_id
""",
        "order_events",
    ),
)
def run_counters(m: Market):
    from tidebook.operators.orders import event_label

    events = m.order_events.select(
        F.col("strategy_id").alias("run_id"), event_label(F.col("event")).alias("kind")
    )
    curve = m.table("orders").select(
        F.col("o_orderpriority").alias("run_id"),
        F.struct("o_orderdate", "o_orderkey").alias("ts"),
        F.col("o_totalprice").alias("equity"),
    )
    out = M.run_counters(events, curve)
    return out.select("run_id", "submitted", "denied", "fills", *_r("starting_equity", "final_equity"))


# -- parity ---------------------------------------------------------------------------


def _session_b(m: Market):
    """The second session: worse prices, and every tenth order's fills are dropped."""
    return PA.perturb(m.raw_fills.where(F.col("k1") % 10 != 9), 10.0 / 3.0)


_PAR = f"""
WITH fb AS MATERIALIZED (SELECT * REPLACE (px * (1.0 + (10.0::DOUBLE / 3.0) / 1e4) AS px) FROM fills WHERE order_id % 10 <> 9),
ca AS MATERIALIZED ({_CURVE.format(src='fills')}), cb AS MATERIALIZED ({_CURVE.format(src='fb')}),
ka AS (SELECT symbol, ts // {30 * D} AS k, side, avg(px) AS px FROM fills GROUP BY 1, 2, 3),
kb AS (SELECT symbol, ts // {30 * D} AS k, side, avg(px) AS px FROM fb GROUP BY 1, 2, 3),
km AS (SELECT coalesce(ka.symbol, kb.symbol) AS symbol, ka.px AS a, kb.px AS b FROM ka FULL JOIN kb ON ka.symbol = kb.symbol AND ka.k = kb.k AND ka.side = kb.side),
t AS (SELECT symbol, 2.0 * count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / (count(a) + count(b)) AS sa, avg(abs(b - a) / a * 1e4) AS fd FROM km GROUP BY 1),
co AS (SELECT ca.symbol, corr(ca.equity, cb.equity) AS ec FROM ca JOIN cb ON ca.symbol = cb.symbol AND ca.ts_event = cb.ts_event GROUP BY 1),
ra AS (SELECT symbol, last(equity ORDER BY ts_event) / first(equity ORDER BY ts_event) - 1 AS x FROM ca GROUP BY 1),
rb AS (SELECT symbol, last(equity ORDER BY ts_event) / first(equity ORDER BY ts_event) - 1 AS x FROM cb GROUP BY 1),
pm AS (SELECT t.symbol, sa AS signal_agreement, fd AS fill_dev_bps, ec AS equity_corr, abs(ra.x - rb.x) AS return_diff
 FROM t JOIN co ON t.symbol = co.symbol JOIN ra ON t.symbol = ra.symbol JOIN rb ON t.symbol = rb.symbol)
"""


def _parity(m: Market):
    a, b = m.raw_fills, _session_b(m)
    bars = staged(m.fill_bars)  # the grid of both curves
    curves = _curve(m, a, bars), _curve(m, b, bars)
    return PA.parity_metrics(
        a, curves[0], b, curves[1], ["symbol"], bucket_ns=30 * DAY, cuts=m.fill_cuts
    )


_PNAMES = ("signal_agreement", "fill_dev_bps", "equity_corr", "return_diff")


@query(
    "parity_metrics",
    sql(_PAR + f"SELECT symbol, {', '.join(f'{R(c)} AS {c}' for c in _PNAMES)} FROM pm", "fill_bars"),
)
def parity_metrics(m: Market):
    return _parity(m).select("symbol", *_r(*_PNAMES))


@query(
    "parity_verdict",
    sql(
        _PAR
        + """SELECT symbol, array_to_string(list_filter([CASE WHEN signal_agreement < 0.8 THEN 'signal_agreement' END,
 CASE WHEN fill_dev_bps > 150 THEN 'fill_dev_bps' END, CASE WHEN equity_corr < 0.9 THEN 'equity_corr' END,
 CASE WHEN return_diff > 0.02 THEN 'return_diff' END], lambda x: x IS NOT NULL), ',') AS reasons,
 signal_agreement >= 0.8 AND fill_dev_bps <= 150 AND equity_corr >= 0.9 AND return_diff <= 0.02 AS passed FROM pm""",
        "fill_bars",
    ),
)
def parity_verdict(m: Market):
    gate = PA.Criterion(min_signal_agreement=0.8, max_fill_dev_bps=150.0)
    out = PA.verdict(_parity(m), gate)
    return out.select("symbol", F.concat_ws(",", "reasons").alias("reasons"), "passed")


@query(
    "cross_check",
    sql(
        _PAR
        + """SELECT symbol, array_to_string(list_filter([CASE WHEN signal_agreement < 1 THEN 'signal_timing_drift' END,
 CASE WHEN return_diff * 1e4 > 50 THEN 'return_drift' END], lambda x: x IS NOT NULL), ',') AS warnings FROM pm""",
        "fill_bars",
    ),
)
def cross_check(m: Market):
    return PA.cross_check(_parity(m)).select(
        "symbol", F.concat_ws(",", "warnings").alias("warnings")
    )


# -- walk-forward ------------------------------------------------------------------------

#: Pairs a grid of periods holds that aren't a fast and a slow one.
INVALID = [(p, p) for p in sorted({*FASTS, *SLOWS})] + [(s, f) for f in FASTS for s in SLOWS if f < s]

_ROLL = """
roll AS MATERIALIZED (SELECT symbol, ts_event, close, fold, CASE WHEN i - st < cut THEN 'train' ELSE 'test' END AS role FROM (
 SELECT *, greatest(CAST(floor((en - st) * 0.6) AS BIGINT), 1) AS cut FROM (
  SELECT *, fold * seg AS st, CASE WHEN fold = 3 THEN n ELSE fold * seg + seg END AS en FROM (
   SELECT *, least(i // seg, 3) AS fold FROM (
    SELECT symbol, ts_event, close, rn - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n,
     greatest(count(*) OVER (PARTITION BY symbol) // 4, 1) AS seg FROM nbars))))
 WHERE en - st >= 2 AND cut < en - st)
"""


@query(
    "splits_rolling",
    sql(f"WITH {_ROLL} SELECT symbol, ts_event, CAST(fold AS BIGINT) AS fold, role FROM roll", "nbars"),
)
def splits_rolling(m: Market):
    out = W.rolling_splits(m.bars, m.bar_series)
    return out.select("symbol", "ts_event", "fold", "role")


@query(
    "splits_anchored",
    sql(
        """
SELECT symbol, ts_event, fold, CASE WHEN i < (fold + 1) * seg THEN 'train' ELSE 'test' END AS role FROM (
 SELECT symbol, ts_event, rn - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n,
  greatest(count(*) OVER (PARTITION BY symbol) // 5, 1) AS seg FROM nbars)
CROSS JOIN (SELECT unnest(range(0, 4)) AS fold)
WHERE i < CASE WHEN fold = 3 THEN n ELSE (fold + 2) * seg END
""",
        "nbars",
    ),
)
def splits_anchored(m: Market):
    out = W.anchored_splits(m.bars, m.bar_series)
    return out.select("symbol", "ts_event", "fold", "role")


def _fold_scores(m: Market):
    """Sharpe of every SMA pair on every fold part, each part run from flat."""
    return _scores_of(W.rolling_splits(m.bars, m.bar_series), m)


def _scores_of(parts, m: Market):
    series = m.bar_series.within("fold", "role")
    pos, wide = S.sweep_positions(parts, series, FASTS, SLOWS)
    scores = M.screen_scores(S.mark_to_market(pos, wide), wide)
    combo = (F.col("fast") * 1000 + F.col("slow")).cast("long")
    return scores.withColumn("combo", combo).withColumnRenamed("sharpe", "score")


def _all_scores(m: Market):
    """Fold parts and the window of all bars in one pass."""
    return _scores_of(W.with_whole(W.rolling_splits(m.bars, m.bar_series), m.bars), m)


def _fold_ctes() -> str:
    pairs = [(f, s) for f in FASTS for s in SLOWS if f < s]
    full = lambda p: _full(p, "avg(close)").replace("PARTITION BY symbol", "PARTITION BY symbol, fold, role")
    ma = ", ".join(f"{full(p)} AS ma{p}" for p in sorted({*FASTS, *SLOWS}))
    rows = " UNION ALL ".join(
        f"SELECT symbol, fold, role, {f} AS fast, {s} AS slow, ts_event, close, ma{f} AS f, ma{s} AS s FROM lines"
        for f, s in pairs
    )
    w = "PARTITION BY symbol, fold, role, fast, slow ORDER BY ts_event"
    return f"""
WITH {_ROLL},
lines AS (SELECT symbol, fold, role, ts_event, close, {ma} FROM (
 SELECT *, row_number() OVER (PARTITION BY symbol, fold, role ORDER BY ts_event) AS rn FROM roll)),
pairs AS MATERIALIZED ({rows}),
ev AS (SELECT *, CASE WHEN lag(f) OVER w <= lag(s) OVER w AND f > s THEN 1
  WHEN lag(f) OVER w >= lag(s) OVER w AND f < s THEN -1 END AS c FROM pairs WINDOW w AS ({w})),
pos AS MATERIALIZED (SELECT *, CASE WHEN last_value(c IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING) > 0 THEN 0.5 ELSE 0.0 END AS position FROM ev),
st AS (SELECT *, coalesce(lag(position) OVER w, 0) - coalesce(lag(position, 2) OVER w, 0) AS dpos,
  coalesce(coalesce(lag(position, 2) OVER w, 0) * (close - lag(close) OVER w), 0) AS gain FROM pos WINDOW w AS ({w})),
eq AS MATERIALIZED (SELECT *, 100000.0 + sum(gain - abs(dpos) * close * 0.0004) OVER ({w} ROWS UNBOUNDED PRECEDING) AS equity FROM st),
scores AS MATERIALIZED (SELECT symbol, CAST(fold AS BIGINT) AS fold, role, fast, slow, CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * sqrt(525600) ELSE 0 END AS score FROM (
  SELECT *, (equity - lag(equity) OVER w) / lag(equity) OVER w AS ret FROM eq WINDOW w AS ({w})) GROUP BY ALL),
best AS MATERIALIZED (SELECT symbol, fold, fast, slow, score AS is_score FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY score DESC, fast, slow) AS k
  FROM scores WHERE role = 'train') WHERE k = 1),
chosen AS MATERIALIZED (SELECT b.*, s.score AS oos_score FROM best b LEFT JOIN scores s ON b.symbol = s.symbol AND b.fold = s.fold
  AND b.fast = s.fast AND b.slow = s.slow AND s.role = 'test')
"""


@query(
    "grid_best",
    sql(_fold_ctes() + f"SELECT symbol, fold, fast, slow, {R('is_score', 5)} AS score FROM best", "nbars"),
)
def grid_best(m: Market):
    train = _fold_scores(m).where(F.col("role") == "train")
    out = M.best_per_group(train, ["symbol", "fold"])
    return out.select("symbol", "fold", "fast", "slow", *_r("score", places=5))


@query(
    "walk_forward",
    sql(
        _fold_ctes()
        + f"""SELECT symbol, count(*) AS n_folds, {R('avg(is_score)', 5)} AS is_mean, {R('avg(oos_score)', 5)} AS oos_mean,
 {R('(avg(is_score) - avg(oos_score)) / abs(avg(is_score))', 5)} AS degradation FROM chosen GROUP BY 1""",
        "nbars",
    ),
)
def walk_forward(m: Market):
    folds = W.choose_in_sample(_fold_scores(m), ["symbol"])
    out = W.degradation(folds, ["symbol"])
    return out.select("symbol", "n_folds", *_r("is_mean", "oos_mean", "degradation", places=5))


def _whole_ctes() -> str:
    """The scores of the folds and of the window of all bars."""
    whole = ",\nroll AS MATERIALIZED (SELECT * FROM roll0 UNION ALL SELECT symbol, ts_event, close, -1, 'all' FROM nbars),\nlines AS"
    return _fold_ctes().replace("roll AS MATERIALIZED", "roll0 AS MATERIALIZED", 1).replace(",\nlines AS", whole, 1)


@query(
    "walk_forward_refit",
    sql(
        _whole_ctes()
        + f"""SELECT symbol, fast, slow, {R('score', 5)} AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, fast, slow) AS k FROM scores WHERE role = 'all') WHERE k = 1""",
        "nbars",
    ),
)
def walk_forward_refit(m: Market):
    """What a walk-forward run recommends: the parameters that are best on all bars."""
    return W.refit(_all_scores(m), ["symbol"]).select("symbol", "fast", "slow", *_r("score", places=5))


@query(
    "walk_forward_history",
    sql(
        _whole_ctes()
        + f"""SELECT symbol, fold, role, fast, slow, {R('score', 5)} AS score FROM scores WHERE role <> 'test'
 UNION ALL SELECT symbol, fold, role, f, s, '-Infinity'::DOUBLE FROM (SELECT DISTINCT symbol, fold, role FROM scores WHERE role <> 'test')
 CROSS JOIN (VALUES {', '.join(f'({f}, {s})' for f, s in INVALID)}) p(f, s)""",
        "nbars",
    ),
)
def walk_forward_history(m: Market):
    """Every trial; a fast period that isn't below the slow one can't be run."""
    out = W.history(_all_scores(m), ["symbol"], [{"fast": f, "slow": s} for f, s in INVALID])
    return out.select("symbol", "fold", "role", "fast", "slow", *_r("score", places=5))


@query(
    "cv_scores",
    sql(
        _fold_ctes()
        + f"SELECT symbol, fast, slow, {R('avg(score)', 5)} AS cv_score FROM scores WHERE role = 'test' GROUP BY 1, 2, 3",
        "nbars",
    ),
)
def cv_scores(m: Market):
    out = W.cv_scores(_fold_scores(m), ["symbol"], ["fast", "slow"])
    return out.select("symbol", "fast", "slow", *_r("cv_score", places=5))


