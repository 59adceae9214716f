"""Raw venue JSON to typed rows.

Each parser takes a DataFrame with a ``text`` column and drops rows that do
not parse; ``rejects`` returns those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.values import int_div

# Message fields of the venue.
TRADE = "e string, E bigint, s string, t bigint, p string, q string, T bigint, m boolean"
BOOK_TICKER = "u bigint, s string, b string, B string, a string, A string"
DEPTH = (
    "e string, E bigint, s string, U bigint, u bigint, pu bigint, "
    "b array<array<string>>, a array<array<string>>"
)
SNAPSHOT = "lastUpdateId bigint, bids array<array<string>>, asks array<array<string>>"
EXEC = (
    "e string, x string, c string, i bigint, s string, S string, t bigint, L string, "
    "l string, n string, N string, m boolean, T bigint, r string"
)
OPEN_ORDER = "clientOrderId string, orderId bigint, symbol string, status string"
EXCHANGE_INFO = (
    "symbols array<struct<symbol:string,status:string,baseAsset:string,quoteAsset:string,"
    "filters:array<map<string,string>>>>"
)
NS_PER_MS = 1_000_000




def _fields(schema: str) -> list[tuple[str, str]]:
    """Top-level (name, type) pairs of a DDL string."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(tuple(schema[start:i].strip().split(" ", 1)))
            start = i + 1
    return out


def _parsed(df: DataFrame, schema: str) -> DataFrame:
    """Parse ``text`` into the struct ``d`` in one pass over the message.

    Venue field names differ only by case (``t``/``T``), which ``json_tuple``
    keeps apart whatever the session's case setting.
    """
    fields = _fields(schema)
    raw = [f"_j{i}" for i in range(len(fields))]
    opened = df.select("*", F.json_tuple("text", *[n for n, _ in fields]).alias(*raw))

    def typed(c: str, kind: str) -> Column:
        if kind.startswith(("array", "struct")):
            return F.from_json(c, kind)
        return F.col(c) if kind == "string" else F.col(c).try_cast(kind)

    cols = [typed(c, kind).alias(_alias(name)) for c, (name, kind) in zip(raw, fields)]
    return opened.withColumn("d", F.struct(*cols)).drop(*raw)


def _alias(name: str) -> str:
    """Upper-case single letters get a suffix so names differ without case."""
    return f"{name}_u" if len(name) == 1 and name.isupper() else name


def _num(c: Column) -> Column:
    return c.try_cast("double")


def split_frames(frames: DataFrame) -> dict[str, DataFrame]:
    """Route combined frames by stream suffix; the rest goes to ``rejects``.

    Returns tables with the inner message in ``text``.
    """
    opened = frames.select("*", F.json_tuple("text", "stream", "data").alias("stream", "_data"))
    s = F.col("stream")
    kind = (
        F.when(s.isNull() | F.col("_data").isNull(), "rejects")
        .when(s.endswith("@trade"), "trades")
        .when(s.endswith("@bookTicker"), "quotes")
        .when(s.contains("@depth"), "depth")
        .otherwise("rejects")
    )
    routed = opened.withColumn("_kind", kind)
    out = {}
    for name in ("trades", "quotes", "depth"):
        part = routed.where(F.col("_kind") == name)
        out[name] = part.withColumn("text", F.col("_data")).drop("_data", "_kind")
    out["rejects"] = routed.where(F.col("_kind") == "rejects").drop("_data", "_kind")
    return out


def _trades(df: DataFrame, *more: str) -> DataFrame:
    return _parsed(df, TRADE).select(
        *more,
        F.col("d.s").alias("symbol"),
        (F.col("d.T_u") * NS_PER_MS).alias("ts_event"),
        F.col("ts_init"),
        _num(F.col("d.p")).alias("price"),
        _num(F.col("d.q")).alias("size"),
        F.when(F.col("d.m"), "SELL").otherwise("BUY").alias("aggressor"),
        F.col("d.t").cast("string").alias("trade_id"),
    )


def trades(df: DataFrame) -> DataFrame:
    """Trade messages; the seller was aggressor when the buyer was maker."""
    return _trades(df).na.drop(subset=_NEEDED["trades"])


def _quotes(df: DataFrame, *more: str) -> DataFrame:
    return _parsed(df, BOOK_TICKER).select(
        *more,
        F.col("d.s").alias("symbol"),
        F.col("ts_init").alias("ts_event"),
        F.col("ts_init"),
        _num(F.col("d.b")).alias("bid"),
        _num(F.col("d.a")).alias("ask"),
        _num(F.col("d.B_u")).alias("bid_size"),
        _num(F.col("d.A_u")).alias("ask_size"),
    )


def quotes(df: DataFrame) -> DataFrame:
    """Best bid and ask; the message has no event time, so arrival time stands in."""
    return _quotes(df).na.drop(subset=_NEEDED["quotes"])


def _levels(side: int, col: str) -> Column:
    return F.transform(
        F.col(col),
        lambda lv, i: F.struct(
            F.lit(side).alias("side"),
            _num(F.get(lv, 0)).alias("price"),
            _num(F.get(lv, 1)).alias("size"),
            i.alias("level_no"),
        ),
    )


def _depth_updates(df: DataFrame, *more: str) -> DataFrame:
    both = F.concat(_levels(1, "d.b"), _levels(-1, "d.a"))
    return _parsed(df, DEPTH).select(
        *more,
        F.col("d.s").alias("symbol"),
        (F.col("d.E_u") * NS_PER_MS).alias("ts_event"),
        F.col("ts_init"),
        F.col("d.U_u").alias("first_id"),
        F.col("d.u").alias("last_id"),
        F.col("d.pu").alias("prev_id"),
        both.alias("levels"),
    )


def depth_updates(df: DataFrame) -> DataFrame:
    """Depth diffs with their update ids, levels still packed."""
    return _depth_updates(df).na.drop(subset=_NEEDED["depth"])


_NEEDED = {
    "trades": ["symbol", "ts_event", "price", "size", "trade_id"],
    "quotes": ["symbol", "bid", "ask", "bid_size", "ask_size"],
    "depth": ["symbol", "ts_event", "first_id", "last_id", "levels"],
}


def quarantine(parts: dict[str, DataFrame]) -> DataFrame:
    """Every frame of ``split_frames`` that gives no row: ``text``, ``ts_init`` and why.

    ``unrouted`` frames belong to no known stream; the others are named after
    the stream whose parser could not read them.
    """
    out = parts["rejects"].select("text", "ts_init", F.lit("unrouted").alias("problem"))
    for name, parse in (("trades", _trades), ("quotes", _quotes), ("depth", _depth_updates)):
        rows = parse(parts[name].withColumn("frame", F.col("text")), "frame")
        lost = ~F.coalesce(*[F.when(F.col(c).isNull(), False) for c in _NEEDED[name]], F.lit(True))
        out = out.unionByName(rows.where(lost).select(F.col("frame").alias("text"), "ts_init", F.lit(name).alias("problem")))
    return out


def depth_levels(updates: DataFrame) -> DataFrame:
    """One row per level, bids then asks; an empty level is deleted."""
    rows = updates.select(
        "symbol",
        "ts_event",
        "ts_init",
        F.col("last_id").alias("sequence"),
        F.posexplode("levels").alias("ord", "l"),
    )
    return rows.select(
        "symbol",
        "ts_event",
        "ts_init",
        "sequence",
        "ord",
        F.when(F.col("l.size") == 0, "Delete").otherwise("Update").alias("action"),
        F.col("l.side").alias("side"),
        F.col("l.price").alias("price"),
        F.col("l.size").alias("size"),
    )


def depth_snapshots(df: DataFrame) -> DataFrame:
    """Snapshot bodies to one ``Clear`` row and one ``Add`` row per level.

    Needs ``symbol`` and ``ts_event`` columns next to ``text``.
    """
    p = _parsed(df, SNAPSHOT).where(
        F.col("d.lastUpdateId").isNotNull()
        & F.col("d.bids").isNotNull()
        & F.col("d.asks").isNotNull()
    )
    clear = F.array(
        F.struct(
            F.lit(1).alias("side"),
            F.lit(0.0).alias("price"),
            F.lit(0.0).alias("size"),
            F.lit(-1).alias("level_no"),
        )
    )
    every = F.concat(clear, _levels(1, "d.bids"), _levels(-1, "d.asks"))
    return p.select(
        "symbol",
        "ts_event",
        F.col("d.lastUpdateId").alias("sequence"),
        F.posexplode(every).alias("ord", "l"),
    ).select(
        "symbol",
        "ts_event",
        "sequence",
        "ord",
        F.when(F.col("l.level_no") < 0, "Clear").otherwise("Add").alias("action"),
        F.col("l.side").alias("side"),
        F.col("l.price").alias("price"),
        F.col("l.size").alias("size"),
    )


def klines(df: DataFrame) -> DataFrame:
    """Pages of kline arrays to bars stamped with the close time.

    ``text`` is one JSON page; other columns are kept.  Overlapping pages are
    merged by the lake's last-write rule.
    """
    rows = df.withColumn("_k", F.explode(F.from_json("text", "array<array<string>>")))
    item = lambda i: F.get("_k", i)
    keep = [c for c in df.columns if c != "text"]
    return rows.select(
        *keep,
        (item(6).try_cast("bigint") * NS_PER_MS).alias("ts_event"),
        _num(item(1)).alias("open"),
        _num(item(2)).alias("high"),
        _num(item(3)).alias("low"),
        _num(item(4)).alias("close"),
        _num(item(5)).alias("volume"),
    ).na.drop(subset=["ts_event", "open", "high", "low", "close", "volume"])


def decimal_scale(text: Column) -> Column:
    """Decimals of an increment after trimming zeros: '0.00100' -> 3."""
    frac = F.regexp_extract(text, r"\.(\d*)$", 1)
    return F.length(F.regexp_replace(frac, "0+$", ""))


def instruments(
    df: DataFrame, venue: str, maker_fee: float = 0.001, taker_fee: float = 0.001
) -> DataFrame:
    """Exchange info to the instrument dimension; trading symbols only."""
    rows = (
        df.select(F.explode(F.from_json("text", EXCHANGE_INFO)["symbols"]).alias("y"))
        .where(
            (F.col("y.status") == "TRADING")
            & (F.length(F.coalesce("y.baseAsset", F.lit(""))) > 0)
            & (F.length(F.coalesce("y.quoteAsset", F.lit(""))) > 0)
        )
    )

    def field(kind: str, name: str) -> Column:
        hits = F.filter("y.filters", lambda f: f["filterType"] == kind)
        return F.get(hits, 0)[name]

    tick, step = field("PRICE_FILTER", "tickSize"), field("LOT_SIZE", "stepSize")
    floor = F.coalesce(field("NOTIONAL", "minNotional"), field("MIN_NOTIONAL", "minNotional"))
    return rows.select(
        F.concat_ws(".", F.col("y.symbol"), F.lit(venue)).alias("instrument"),
        F.col("y.baseAsset").alias("base"),
        F.col("y.quoteAsset").alias("quote"),
        decimal_scale(tick).alias("price_precision"),
        decimal_scale(step).alias("size_precision"),
        _num(tick).alias("price_increment"),
        _num(step).alias("size_increment"),
        F.nullif(_num(floor), F.lit(0.0)).alias("min_notional"),
        F.lit(maker_fee).alias("maker_fee"),
        F.lit(taker_fee).alias("taker_fee"),
    ).na.drop(subset=["price_increment", "size_increment"])


# Execution type to order event.
EXEC_EVENT = {
    "NEW": "Accepted",
    "TRADE": "Filled",
    "CANCELED": "Canceled",
    "REJECTED": "Rejected",
    "EXPIRED": "Expired",
}


def execution_reports(df: DataFrame) -> DataFrame:
    """Execution reports to order events; a trade carries its fill."""
    p = _parsed(df, EXEC)
    x = F.col("d.x")
    names = F.create_map(*[F.lit(v) for kv in EXEC_EVENT.items() for v in kv])
    trade = x == "TRADE"
    only = lambda c: F.when(trade, c)
    rows = p.where((F.col("d.e") == "executionReport") & F.col("d.c").isNotNull()).select(
        F.col("d.c").alias("client_order_id"),
        names[x].alias("event"),
        F.when(x.isin("NEW", "TRADE"), F.col("d.i").cast("string")).alias("venue_order_id"),
        F.when(x == "REJECTED", F.coalesce("d.r", F.lit("NONE"))).alias("reason"),
        only(F.col("d.t").cast("string")).alias("trade_id"),
        only(F.col("d.s")).alias("symbol"),
        only(F.when(F.col("d.S_u") == "BUY", 1).when(F.col("d.S_u") == "SELL", -1)).alias("side"),
        only(_num(F.col("d.L_u"))).alias("last_px"),
        only(_num(F.col("d.l"))).alias("last_qty"),
        only(F.coalesce(_num(F.col("d.n")), F.lit(0.0))).alias("fee"),
        only(F.coalesce("d.N_u", F.lit("USDT"))).alias("fee_currency"),
        only(F.when(F.col("d.m"), "maker").otherwise("taker")).alias("liquidity"),
        only(F.coalesce("d.T_u", F.lit(0)) * NS_PER_MS).alias("ts_event"),
    )
    fill_ok = (F.col("event") != "Filled") | (
        F.col("trade_id").isNotNull()
        & F.col("symbol").isNotNull()
        & F.col("side").isNotNull()
        & F.col("last_px").isNotNull()
        & F.col("last_qty").isNotNull()
    )
    accept_ok = ~F.col("event").isin("Accepted", "Filled") | F.col("venue_order_id").isNotNull()
    return rows.where(F.col("event").isNotNull() & fill_ok & accept_ok)


def open_orders(df: DataFrame) -> DataFrame:
    """Open-order rows as accepted orders, the venue's truth."""
    p = _parsed(df, OPEN_ORDER)
    return p.select(
        F.col("d.clientOrderId").alias("client_order_id"),
        F.col("d.orderId").cast("string").alias("venue_order_id"),
        F.lit("Accepted").alias("event"),
    ).na.drop(subset=["client_order_id", "venue_order_id"])


def subscribed(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events of subscribed (symbol, kind) pairs."""
    wanted = subscriptions.select("symbol", "kind").distinct()
    return events.join(wanted, ["symbol", "kind"], "left_semi")


def received_at(ts_ms: Column) -> Column:
    """Arrival milliseconds to nanoseconds."""
    return ts_ms * NS_PER_MS


def millis(ts_ns: Column) -> Column:
    """Nanoseconds to whole milliseconds."""
    return int_div(ts_ns, NS_PER_MS)
