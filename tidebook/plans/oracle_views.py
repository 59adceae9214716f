"""The views of ``market`` as SQL for the checking engine."""

from __future__ import annotations

H = 3_600_000_000_000
D = 24 * H

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (needs, sql.strip())


_view(
    "ticks",
    """
SELECT event_type AS symbol, epoch_us(ts) * 1000 AS ts, event_id AS seq, value AS price,
       CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS size,
       CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS aggressor,
       epoch_us(ts) * 1000 + (event_id % 1000) * 1000 AS ts_init, user_id
FROM events
""",
)
_BARS = f"""
SELECT symbol, (ts // {H} + 1) * {H} AS ts_event,
       first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY ts, seq) AS close, sum(size) AS volume
FROM {{src}} GROUP BY 1, 2
"""
_view("bars", _BARS.format(src="ticks"), "ticks")
_view("nbars", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_event) AS rn FROM bars", "bars")
_view("wide_ticks", "SELECT * REPLACE ('U' || user_id AS symbol) FROM ticks", "ticks")
_view("wide_bars", _BARS.format(src="wide_ticks"), "wide_ticks")
_view(
    "quotes",
    """
SELECT symbol, ts, seq, price * (1 - 1e-4) AS bid, price * (1 + 1e-4) AS ask,
       size / 2 AS bid_size, size / 2 AS ask_size FROM ticks
""",
    "ticks",
)
_view(
    "deltas",
    """
SELECT symbol, ts, seq, aggressor AS side, CAST(floor(price) AS BIGINT) AS price,
       CASE WHEN size % 5 = 0 THEN 0.0 ELSE size END AS size,
       seq - CASE WHEN seq % 97 = 0 THEN 1000 ELSE 0 END AS sequence,
       CASE WHEN seq % 500 = 0 THEN 'Clear' ELSE 'Update' END AS action FROM ticks
""",
    "ticks",
)
_view(
    "order_table",
    f"""
SELECT seq AS order_id, symbol, ts AS ts_decision, ts + {2 * D} AS valid_to,
       CAST(CASE WHEN seq % 4 < 2 THEN 1 ELSE -1 END AS BIGINT) AS side,
       CASE seq % 3 WHEN 0 THEN 'market' WHEN 1 THEN 'limit' ELSE 'stop' END AS type,
       1 + CAST(size AS BIGINT) % 20 AS qty,
       CASE WHEN seq % 3 = 1 THEN CASE WHEN seq % 4 < 2 THEN CASE WHEN seq % 5 = 0 THEN ceil(price * 101) ELSE floor(price * 98) END
         ELSE CASE WHEN seq % 5 = 0 THEN floor(price * 99) ELSE ceil(price * 102) END END / 100.0 END AS "limit",
       CASE WHEN seq % 3 = 2 THEN CASE WHEN seq % 4 < 2 THEN price * 1.02 ELSE price * 0.98 END END AS "trigger",
       price AS ref
FROM ticks
""",
    "ticks",
)
_view(
    "life",
    """
SELECT o.*, b.ts_event, b.open, b.high, b.low, b.close, b.volume,
       row_number() OVER (PARTITION BY o.order_id ORDER BY b.ts_event) AS bar_no
FROM order_table o JOIN bars b ON b.symbol = o.symbol
 AND b.ts_event > o.ts_decision AND b.ts_event <= o.valid_to
""",
    "order_table",
    "bars",
)
_view(
    "telemetry",
    """
SELECT user_id AS account, epoch_us(ts) * 1000 AS ts, event_id AS seq,
       CASE WHEN event_type = 'view' THEN value * 1000.0 END AS equity,
       CASE WHEN event_type = 'click' THEN value * 1000.0 END AS gross_exposure,
       CASE WHEN event_type = 'purchase' THEN value * 1000.0 END AS net_exposure,
       CASE WHEN event_type = 'signup' THEN value * 1000.0 END AS realized_pnl,
       CASE WHEN event_type = 'error' THEN value * 1000.0 END AS unrealized_pnl
FROM events
""",
)
_view(
    "fills",
    """
SELECT l_suppkey AS symbol, epoch_us(l_shipdate) * 1000 AS ts,
       row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
           l_quantity, l_extendedprice, l_partkey,
           CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END) - 1 AS seq,
       CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS BIGINT) AS side,
       CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS qty,
       l_extendedprice / l_quantity AS px, l_returnflag AS flag, l_partkey AS part,
       l_discount AS discount, l_orderkey AS order_id
FROM lineitem
""",
)
_view(
    "fill_bars",
    f"""
SELECT symbol, (ts // {30 * D} + 1) * {30 * D} AS ts_event, last(px ORDER BY ts, seq) AS close
FROM fills GROUP BY 1, 2
""",
    "fills",
)
_view(
    "order_events",
    """
SELECT client_order_id, strategy_id, ts + (i - 1) * 1000000 AS ts, i - 1 AS seq, path[i] AS event,
       10.0 AS order_qty,
       CASE WHEN path[i] IN ('PartiallyFilled', 'Filled') THEN 5.0 END AS last_qty,
       CASE WHEN path[i] IN ('PartiallyFilled', 'Filled') THEN px / 100.0 + (i - 1) END AS last_px
FROM (
  SELECT *, unnest(range(1, len(path) + 1)) AS i FROM (
    SELECT o_orderkey AS client_order_id, o_orderpriority AS strategy_id,
           epoch_us(o_orderdate) * 1000 AS ts, o_totalprice AS px,
           ['Initialized', 'Submitted', 'Accepted']
           || CASE WHEN o_orderstatus = 'O' THEN [] ELSE ['PartiallyFilled'] END
           || CASE WHEN o_orderstatus = 'F' THEN ['Filled'] ELSE [] END
           || CASE WHEN o_orderkey % 40 = 0 THEN ['Accepted'] ELSE [] END AS path
    FROM orders))
""",
)
_view(
    "instruments",
    f"""
SELECT p_partkey AS instrument, CAST(1 + p_size % 10 AS DOUBLE) AS multiplier,
       p_size % 7 = 0 AS is_inverse, p_retailprice AS strike,
       CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS "right",
       1704844800000000000 + CAST(p_size AS BIGINT) * {D} AS expiry_ns,
       (['click', 'error', 'purchase', 'signup', 'view'])[1 + CAST(p_partkey % 5 AS INTEGER)] AS underlying,
       CAST(p_size AS BIGINT) AS p_size
FROM part
""",
)
# Positions of the hourly 3/8 cross and their marked equity, per symbol.
_CROSS = """
SELECT symbol, ts_event, close, position, f, s, "cross" FROM (
 SELECT *, CASE WHEN last_value("cross" IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_event
          ROWS UNBOUNDED PRECEDING) > 0 THEN 0.5 ELSE 0.0 END AS position FROM (
  SELECT *, CASE WHEN pf <= ps AND f > s THEN 1 WHEN pf >= ps AND f < s THEN -1 END AS "cross" FROM (
   SELECT *, lag(f) OVER w AS pf, lag(s) OVER w AS ps FROM (
    SELECT symbol, ts_event, close,
     CASE WHEN rn >= 3 THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts_event ROWS 2 PRECEDING) END AS f,
     CASE WHEN rn >= 8 THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts_event ROWS 7 PRECEDING) END AS s
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_event) AS rn FROM {src}))
   WINDOW w AS (PARTITION BY symbol ORDER BY ts_event))))
"""
_MTM = """
SELECT symbol, ts_event, close, held, dpos,
 100000.0 + sum(gain - abs(dpos) * close * 0.0004) OVER (PARTITION BY symbol ORDER BY ts_event
   ROWS UNBOUNDED PRECEDING) AS equity FROM (
 SELECT *, coalesce(held, 0) - coalesce(before, 0) AS dpos,
   coalesce(before * (close - pclose), 0) AS gain FROM (
  SELECT symbol, ts_event, close, coalesce(lag(position) OVER w, 0.0) AS held,
   coalesce(lag(position, 2) OVER w, 0.0) AS before, lag(close) OVER w AS pclose
  FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY ts_event)))
"""
_view("crossing", _CROSS.format(src="bars"), "bars")
_view("equity", _MTM.format(src="crossing"), "crossing")
_view("wide_crossing", _CROSS.format(src="wide_bars"), "wide_bars")
_view("wide_equity", _MTM.format(src="wide_crossing"), "wide_crossing")
_METRICS = """
SELECT symbol, n_periods,
 CASE WHEN n_periods >= 2 THEN coalesce(l / nullif(f, 0) - 1, 0) ELSE 0 END AS total_return,
 CASE WHEN n_periods >= 2 AND sd > 0 THEN mean / sd * sqrt(525600) ELSE 0 END AS sharpe,
 CASE WHEN n_periods >= 2 AND down > 0 THEN mean / down * sqrt(525600) ELSE 0 END AS sortino,
 CASE WHEN n_periods >= 2 THEN dd ELSE 0 END AS max_drawdown,
 CASE WHEN n_periods >= 2 THEN sd * sqrt(525600) ELSE 0 END AS volatility FROM (
 SELECT symbol, count(*) AS n_periods, first(equity ORDER BY ts_event) AS f,
  last(equity ORDER BY ts_event) AS l, avg(ret) AS mean, stddev_pop(ret) AS sd,
  sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) AS down, max(drawdown) AS dd FROM (
  SELECT *, CASE WHEN p IS NOT NULL THEN CASE WHEN p = 0 THEN 0 ELSE (equity - p) / p END END AS ret,
   CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END AS drawdown FROM (
   SELECT symbol, ts_event, equity, lag(equity) OVER w AS p,
    max(equity) OVER (PARTITION BY symbol ORDER BY ts_event ROWS UNBOUNDED PRECEDING) AS peak
   FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY ts_event))) GROUP BY symbol)
"""
_view("metrics", _METRICS.format(src="equity"), "equity")
_view("wide_metrics", _METRICS.format(src="wide_equity"), "wide_equity")
# FIFO lots on the axis of cumulative quantity, per supplier.
_view(
    "merged",
    """
SELECT symbol, min(ts) AS ts, min(seq) AS seq, first(side) AS side, sum(qty) AS qty, first(px) AS px
FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN side IS NOT DISTINCT FROM lag(side) OVER w
     AND px IS NOT DISTINCT FROM lag(px) OVER w THEN 0 ELSE 1 END AS fresh
  FROM fills WINDOW w AS (PARTITION BY symbol ORDER BY seq)))
GROUP BY symbol, run
""",
    "fills",
)
_view(
    "legs",
    """
SELECT *, sum(closing) OVER w AS cum_close, sum(qty - closing) OVER w AS cum_open FROM (
 SELECT *, CASE WHEN sign(net) = -side THEN least(abs(net), qty) ELSE 0 END AS closing FROM (
  SELECT *, coalesce(sum(side * qty) OVER (PARTITION BY symbol ORDER BY seq
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS net FROM merged))
WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING)
""",
    "merged",
)
_view(
    "lots",
    """
SELECT o.symbol, o.ts AS entry_ts, c.ts AS exit_ts, o.side, o.px AS entry_px, c.px AS exit_px,
 least(o.cum_open, c.cum_close) - greatest(o.cum_open - (o.qty - o.closing), c.cum_close - c.closing) AS qty
FROM (SELECT * FROM legs WHERE qty > closing) o
JOIN (SELECT * FROM legs WHERE closing > 0) c ON o.symbol = c.symbol
 AND o.cum_open - (o.qty - o.closing) < c.cum_close AND c.cum_close - c.closing < o.cum_open
""",
    "legs",
)
_view(
    "trades",
    """
SELECT *, (exit_px - entry_px) * qty * side - (entry_px + exit_px) * qty * 0.000412357 AS pnl FROM lots
""",
    "lots",
)


def R(expr: str, places: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {places}) + 0.0)"


def sql(body: str, *views: str) -> str:
    """``body`` preceded by the views it needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in VIEWS[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"
