"""Open-loop execution economics: order tables against market events.

Orders: ``order_id, symbol, ts_decision, valid_to, side, type, qty`` and,
by type, ``limit``, ``trigger``, ``offset``.  ``valid_to`` is the end of the
order's life (its cancel time, or the end of the market data).  Every function
returns fills with ``order_id, symbol, ts_event, ts, side, qty, px, liquidity``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.brokerage import CostModel
from tidebook.functions.values import int_div
from tidebook.operators.asof import asof
from tidebook.operators.bands import band_join, reach_join
from tidebook.operators.series import Cuts, Series, measure_cuts

HOUR_NS = 3_600_000_000_000


def adapt_events(events: DataFrame) -> DataFrame:
    """Bring bars, trades and quotes to one shape; book deltas do not price orders.

    A trade is its own range, a quote spans bid to ask and closes at the mid;
    neither carries volume, so neither caps a fill.
    """
    kind = F.col("kind")
    mid = (F.col("bid") + F.col("ask")) / 2

    def pick(bar: str, quote: Column) -> Column:
        return (
            F.when(kind == "bar", F.col(bar)).when(kind == "trade", F.col("price")).otherwise(quote)
        )

    return events.where(kind.isin("bar", "trade", "quote")).select(
        "symbol",
        "ts_event",
        "kind",
        pick("open", mid).alias("open"),
        pick("high", F.col("ask")).alias("high"),
        pick("low", F.col("bid")).alias("low"),
        pick("close", mid).alias("close"),
        F.when(kind == "bar", F.col("volume")).alias("volume"),
    )


def reference_price(side: Column, bid: Column, ask: Column, mark: Column) -> Column:
    """Buys look at the ask, sells at the bid, the mark when there is no quote."""
    return F.coalesce(F.when(side > 0, ask).otherwise(bid), mark)


def marketable(order_type: Column, side: Column, limit: Column, ref: Column) -> Column:
    """Market orders always; limits when the reference is at or inside the limit."""
    inside = F.when(side > 0, ref <= limit).otherwise(ref >= limit)
    return F.when(order_type == "market", F.lit(True)).otherwise(
        (order_type == "limit") & F.coalesce(inside, F.lit(False))
    )


def life_bars(orders: DataFrame, bars: DataFrame, bucket_ns: int = 24 * HOUR_NS) -> DataFrame:
    """Every bar inside each order's life, with the time of its first one."""
    pairs = band_join(
        orders,
        bars,
        ["symbol"],
        start="ts_decision",
        end="valid_to",
        at="ts_event",
        bucket_ns=bucket_ns,
    )
    w = Window.partitionBy("order_id").orderBy("ts_event")
    return pairs.withColumn("first_ts", F.first("ts_event").over(w))


def reach_bars(
    orders: DataFrame, bars: DataFrame, bucket_ns: int = 24 * HOUR_NS, cuts: Cuts | None = None
) -> DataFrame:
    """Bars of each order's life that reach its limit or trigger.

    Enough for resting orders, which ignore all other bars, and far fewer than
    ``life_bars`` when orders rest for long.
    """
    buy = F.col("side") > 0

    def reaches(low: Column, high: Column) -> Column:
        limit = F.when(buy, low <= F.col("limit")).otherwise(high >= F.col("limit"))
        trigger = F.when(buy, high >= F.col("trigger")).otherwise(low <= F.col("trigger"))
        no = F.lit(False)
        return F.coalesce(limit, no) | F.coalesce(trigger, no)

    dated = asof(
        orders,
        bars,
        ["symbol"],
        left_at="ts_decision",
        right_at="ts_event",
        values={"first_ts": "@at"},
        direction="forward",
        cuts=cuts,
    )
    return reach_join(
        dated,
        bars,
        ["symbol"],
        start="ts_decision",
        end="valid_to",
        at="ts_event",
        low="low",
        high="high",
        reaches=reaches,
        bucket_ns=bucket_ns,
    )


def allocate(pairs: DataFrame, model: CostModel, eligible: Column) -> DataFrame:
    """Spread each order's quantity over its eligible bars under the volume cap."""
    cap = F.coalesce(model.volume_cap(F.col("volume")), F.col("qty").cast("double"))
    rows = pairs.where(eligible).withColumn("_cap", cap)
    w = (
        Window.partitionBy("order_id")
        .orderBy("ts_event")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    used = F.coalesce(F.sum("_cap").over(w), F.lit(0.0))
    left = F.col("qty").cast("double") - used
    return (
        rows.withColumn("fill_qty", F.greatest(F.least(F.col("_cap"), left), F.lit(0.0)))
        .where(F.col("fill_qty") > 0)
        .drop("_cap")
    )


def _as_fills(
    rows: DataFrame,
    px: Column,
    liquidity: str,
    model: CostModel,
    takes: Column | None = None,
) -> DataFrame:
    kind = F.lit(liquidity)
    if takes is not None:
        kind = F.when(takes, F.lit("taker")).otherwise(kind)
    return rows.select(
        "order_id",
        "symbol",
        "ts_event",
        model.fill_time(F.col("ts_event")).alias("ts"),
        F.col("side").cast("long").alias("side"),
        F.col("fill_qty").alias("qty"),
        px.alias("px"),
        kind.alias("liquidity"),
    )


def next_open_fills(
    orders: DataFrame, events: DataFrame, model: CostModel, cuts: Cuts | None = None
) -> DataFrame:
    """First fill of a marketable order: the open of the first later event.

    Never look-ahead: a limit takes the open only if it was marketable against
    ``ref`` when it was decided.  It is never filled worse than its limit, and
    an open that gapped away fills nothing here.
    """
    hit = asof(
        orders,
        events,
        ["symbol"],
        left_at="ts_decision",
        right_at="ts_event",
        values={
            "ts_event": "@at",
            "open": "open",
            "high": "high",
            "low": "low",
            "volume": "volume",
        },
        direction="forward",
        cuts=cuts,
    ).where(F.col("ts_event").isNotNull() & (F.col("ts_event") <= F.col("valid_to")))
    buy = F.col("side") > 0
    hit = hit.where(marketable(F.col("type"), F.col("side"), F.col("limit"), F.col("ref")))
    still = F.col("limit").isNull() | F.when(buy, F.col("open") <= F.col("limit")).otherwise(
        F.col("open") >= F.col("limit")
    )
    raw = model.fill_price(F.col("side"), F.col("open"), F.col("low"), F.col("high"))
    px = F.when(F.col("limit").isNull(), raw).otherwise(
        F.when(buy, F.least(raw, F.col("limit"))).otherwise(F.greatest(raw, F.col("limit")))
    )
    qty = F.least(
        F.coalesce(model.volume_cap(F.col("volume")), F.col("qty").cast("double")),
        F.col("qty").cast("double"),
    )
    return _as_fills(hit.where(still).withColumn("fill_qty", qty), px, "taker", model)


def capacity_axis(bars: DataFrame, model: CostModel, cuts: Cuts | None = None) -> DataFrame:
    """``bars`` on the axis of what their symbol can fill.

    ``n`` numbers the bars of a symbol from 1, ``cap`` is the most a bar fills
    (null: no cap), ``lots`` the same in lots, ``room`` the lots of all bars up
    to and with this one, and ``free`` the number of the next bar without a cap.
    """
    cap = model.volume_cap(F.col("volume"))
    lots = F.coalesce(F.round(cap / F.lit(model.lot)).cast("long"), F.lit(0).cast("long"))
    series = Series.of("symbol", "ts_event", cuts)
    rows = bars.withColumns({"cap": cap, "lots": lots})
    rows = series.running(rows, {"n": ("count", F.lit(1)), "room": ("sum", F.col("lots"))})
    uncapped = F.when(F.col("cap").isNull(), F.col("n"))
    return series.running(rows, {"free": ("last", uncapped)}, reverse=True)


def capacity_fills(
    orders: DataFrame, bars: DataFrame, model: CostModel, cuts: Cuts | None = None
) -> DataFrame:
    """Market orders over several bars: the first at its open, the rest at the close.

    An order takes all of the room of its bars, so its last bar is where the
    room of its symbol reaches what was there at its decision plus its quantity:
    an as-of on the axis of capacity.  A bar without a cap fills what is left.
    Only bars that fill an order are ever paired with it.
    """
    axis = capacity_axis(bars, model, cuts)
    dated = asof(
        orders,
        axis.withColumn("before", F.col("room") - F.col("lots")),
        "symbol",
        left_at="ts_decision",
        right_at="ts_event",
        values={"first_n": "n", "before": "before", "free": "free"},
        direction="forward",
        cuts=cuts,
    ).where(F.col("first_n").isNotNull() & (F.col("qty") > 0))
    ended = asof(
        dated,
        axis,
        "symbol",
        left_at="valid_to",
        right_at="ts_event",
        values={"end_n": "n"},
        cuts=cuts,
    ).where(F.col("end_n") >= F.col("first_n"))
    need = F.ceil(F.col("qty").cast("double") / F.lit(model.lot) - F.lit(1e-9)).cast("long")
    capped = axis.where(F.col("cap").isNotNull())
    full = asof(
        ended.withColumn("_need", F.col("before") + need - 1),
        capped.select("symbol", "room", "n"),
        "symbol",
        left_at="_need",
        right_at="room",
        values={"full_n": "n"},
        direction="forward",
        cuts=measure_cuts(capped, ["symbol"], "room", cuts.rows_per_block) if cuts else None,
    )
    last = F.least("end_n", F.coalesce("full_n", "end_n"), F.coalesce("free", "end_n"))
    steps = full.withColumn("n", F.explode(F.sequence(F.col("first_n"), last)))
    rows = steps.drop("free").join(axis.drop("free"), ["symbol", "n"])
    used = (F.col("room") - F.col("lots") - F.col("before")).cast("double") * F.lit(model.lot)
    left = F.col("qty").cast("double") - used
    rows = rows.withColumn("fill_qty", F.least(F.coalesce("cap", left), left))
    ref = F.when(F.col("n") == F.col("first_n"), F.col("open")).otherwise(F.col("close"))
    px = model.fill_price(F.col("side"), ref, F.col("low"), F.col("high"))
    return _as_fills(rows.where(F.col("fill_qty") > 0), px, "taker", model)


def bars_in_life(orders: DataFrame, bars: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """``orders`` with ``n_bars``, the bars after the decision up to ``valid_to``: by their numbers, without pairing them."""
    numbered = Series.of("symbol", "ts_event", cuts).running(bars, {"_n": ("count", F.lit(1))})

    def at(df: DataFrame, column: str, name: str) -> DataFrame:
        return asof(df, numbered, "symbol", left_at=column, right_at="ts_event", values={name: "_n"}, cuts=cuts)

    both = at(at(orders, "ts_decision", "_from"), "valid_to", "_to")
    n = F.coalesce("_to", F.lit(0)) - F.coalesce("_from", F.lit(0))
    return both.withColumn("n_bars", F.greatest(n, F.lit(0)).cast("long")).drop("_from", "_to")


def market_fills(pairs: DataFrame, model: CostModel) -> DataFrame:
    """Market orders over several bars: the first at its open, the rest at the close."""
    rows = allocate(pairs.where(F.col("type") == "market"), model, F.lit(True))
    first = F.col("ts_event") == F.col("first_ts")
    ref = F.when(first, F.col("open")).otherwise(F.col("close"))
    px = model.fill_price(F.col("side"), ref, F.col("low"), F.col("high"))
    return _as_fills(rows, px, "taker", model)


def crossed(side: Column, limit: Column, low: Column, high: Column) -> Column:
    """The bar traded at or through a passive limit."""
    return F.when(side > 0, low <= limit).otherwise(high >= limit)


def limit_fills(pairs: DataFrame, model: CostModel, after: Column | None = None) -> DataFrame:
    """Limit orders over their life.

    One that was marketable at its decision (``ref`` against the limit) takes
    the first open if that is still inside the limit; everything else rests
    and fills at the limit on each bar that reaches it.  With ``after`` (a
    stop-limit's trigger) orders only rest.
    """
    decided = F.col("ts_decision")
    only_resting = after is not None
    after = decided if after is None else after
    side, limit = F.col("side"), F.col("limit")
    buy = side > 0
    takes = F.lit(False)
    if not only_resting and "ref" in pairs.columns:
        first = F.col("ts_event") == F.col("first_ts")
        takes = first & marketable(F.lit("limit"), side, limit, F.col("ref"))
    inside = F.when(buy, F.col("open") <= limit).otherwise(F.col("open") >= limit)
    rests = crossed(side, limit, F.col("low"), F.col("high")) & (F.col("ts_event") > after)
    rows = allocate(pairs, model, F.when(takes, inside).otherwise(rests))
    raw = model.fill_price(side, F.col("open"), F.col("low"), F.col("high"))
    capped = F.when(buy, F.least(raw, limit)).otherwise(F.greatest(raw, limit))
    fills = _as_fills(rows, F.when(takes, capped).otherwise(limit), "maker", model, takes)
    return fills


def queue_limit_fills(pairs: DataFrame, model: CostModel) -> DataFrame:
    """Passive limits behind a queue seeded on the first bar that reaches them.

    A touch pays its share into the queue first, trading through the level
    clears it.  Nothing fills before the queue is gone, so the queue in front
    of a bar is the seed less all earlier shares.
    """
    qty = F.col("qty").cast("double")
    buy = F.col("side") > 0
    through = F.when(buy, F.col("low") < F.col("limit")).otherwise(F.col("high") > F.col("limit"))
    touch = F.when(buy, F.col("low") == F.col("limit")).otherwise(F.col("high") == F.col("limit"))
    w = Window.partitionBy("order_id").orderBy("ts_event")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    share = F.least(F.coalesce(model.volume_cap(F.col("volume")), qty), qty)
    rows = pairs.where(through | touch).withColumns({"_thr": through, "_share": share})
    seed = F.first(model.queue_ahead(F.coalesce("volume", F.lit(0.0)))).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumns(
        {
            "_seed": seed,
            "_paid": F.coalesce(F.sum("_share").over(prior), F.lit(0.0)),
            "_swept": F.coalesce(F.max("_thr").over(prior), F.lit(False)),
        }
    )
    ahead = F.when(F.col("_swept") | F.col("_thr"), F.lit(0.0)).otherwise(
        F.greatest(F.col("_seed") - F.col("_paid"), F.lit(0.0))
    )
    free = F.col("_share") - F.least(F.col("_share"), ahead)
    rows = rows.withColumn("_free", free)
    used = F.coalesce(F.sum("_free").over(prior), F.lit(0.0))
    rows = rows.withColumn("fill_qty", F.greatest(F.least(F.col("_free"), qty - used), F.lit(0.0)))
    return _as_fills(rows.where(F.col("fill_qty") > 0), F.col("limit"), "maker", model)


def _triggered(side: Column, trigger: Column, low: Column, high: Column) -> Column:
    return F.when(side > 0, high >= trigger).otherwise(low <= trigger)


def _stop_out(rows: DataFrame, model: CostModel, trigger: Column) -> DataFrame:
    ref = F.when(F.col("side") > 0, F.greatest(trigger, F.col("low"))).otherwise(
        F.least(trigger, F.col("high"))
    )
    px = model.fill_price(F.col("side"), ref, F.col("low"), F.col("high"))
    return _as_fills(rows, px, "taker", model)


def stop_fills(pairs: DataFrame, model: CostModel) -> DataFrame:
    """Stop-market orders: every bar that trades at or past the trigger takes liquidity."""
    hit = _triggered(F.col("side"), F.col("trigger"), F.col("low"), F.col("high"))
    return _stop_out(allocate(pairs, model, hit), model, F.col("trigger"))


def stop_limit_fills(pairs: DataFrame, model: CostModel) -> DataFrame:
    """Stop-limits rest as passive limits from the bar after their trigger."""
    hit = F.when(
        _triggered(F.col("side"), F.col("trigger"), F.col("low"), F.col("high")),
        F.col("ts_event"),
    )
    whole = Window.partitionBy("order_id")
    rows = pairs.withColumn("hit_ts", F.min(hit).over(whole))
    return limit_fills(rows.where(F.col("hit_ts").isNotNull()), model, F.col("hit_ts"))


def _block_moves(bars: DataFrame, bucket_ns: int) -> DataFrame:
    """Per (symbol, bucket): extremes, the largest rise from an earlier low to a high, and the largest fall."""
    w = Window.partitionBy("symbol", "_b").orderBy("ts_event").rowsBetween(Window.unboundedPreceding, -1)
    rows = bars.withColumn("_b", int_div(F.col("ts_event"), bucket_ns))
    rows = rows.withColumns({"_rise": F.col("high") - F.min("low").over(w), "_fall": F.max("high").over(w) - F.col("low")})
    return rows.groupBy("symbol", "_b").agg(
        F.min("low").alias("_lo"), F.max("high").alias("_hi"), F.max("_rise").alias("_rise"), F.max("_fall").alias("_fall")
    )


def _passages(pairs: DataFrame, entry: Column, *group: str) -> DataFrame:
    """Each pair with ``_best`` before its bar and whether it is hit, as long as none of its group was."""
    w = Window.partitionBy("order_id", *group).orderBy("ts_event").rowsBetween(Window.unboundedPreceding, -1)
    rows = pairs.withColumn("_best", F.least(entry, F.min("_near").over(w)))
    return rows.withColumn("_hit", F.col("_far") >= F.col("_best") + F.col("offset"))


def first_passages(orders: DataFrame, bars: DataFrame, bucket_ns: int = 12 * HOUR_NS) -> DataFrame:
    """The first bar of each trailing stop's life that hits it, with the best price before.

    Prices are mirrored for sells (``_far`` is the side that triggers, ``_near``
    the side that tightens), so every order waits for a rise of ``offset`` over
    its best.  The bars of the bucket it is decided in are walked; of the later
    buckets only the extremes and the largest rise are read, which tell the first
    one that holds the passage, and only that one is opened.
    """
    buy = F.col("side") > 0
    near, far = (F.when(buy, F.col(x)).otherwise(-F.col(y)) for x, y in (("low", "high"), ("high", "low")))
    start = F.when(buy, F.col("anchor")).otherwise(-F.col("anchor")).cast("double")
    orders = orders.where((F.col("offset") > 0) & (F.col("valid_to") > F.col("ts_decision"))).withColumns(
        {"_best0": start, "_b": int_div(F.col("ts_decision"), bucket_ns), "_end": int_div(F.col("valid_to"), bucket_ns)}
    )
    placed = bars.withColumn("_b", int_div(F.col("ts_event"), bucket_ns))
    inside = (F.col("ts_event") > F.col("ts_decision")) & (F.col("ts_event") <= F.col("valid_to"))

    def opened(blocks: DataFrame) -> DataFrame:
        return blocks.join(placed, ["symbol", "_b"]).where(inside).withColumns({"_near": near, "_far": far})

    bar = F.struct("ts_event", "low", "high", "volume", F.col("_best").alias("best"))
    hit = F.min_by(bar, F.when(F.col("_hit"), F.col("ts_event"))).alias("hit")
    own = _passages(opened(orders), F.col("_best0")).groupBy("order_id").agg(hit, F.min("_near").alias("_low0"))
    dated = orders.join(own, "order_id", "left")

    # buckets after the first, by their extremes
    later = dated.where(F.col("hit").isNull() & (F.col("_end") > F.col("_b"))).drop("hit")
    later = later.withColumn("_b", F.explode(F.sequence(F.col("_b") + 1, F.col("_end"))))
    moves = later.join(_block_moves(bars, bucket_ns), ["symbol", "_b"])
    lowest = F.when(buy, F.col("_lo")).otherwise(-F.col("_hi"))
    highest = F.when(buy, F.col("_hi")).otherwise(-F.col("_lo"))
    rise = F.coalesce(F.when(buy, F.col("_rise")).otherwise(F.col("_fall")), F.lit(float("-inf")))
    w = Window.partitionBy("order_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    moves = moves.withColumn("_entry", F.least("_best0", "_low0", F.min(lowest).over(w)))
    # A rise is a difference, rounded once more than the comparison with a trigger: near ties are opened too.
    slack = F.abs(highest) * F.lit(1e-12)
    over = highest >= F.col("_entry") + F.col("offset")
    moves = moves.withColumns({"_maybe": over | (rise >= F.col("offset") - slack), "_sure": over | (rise >= F.col("offset") + slack)})
    sure = F.min(F.when(F.col("_sure"), F.col("_b"))).over(Window.partitionBy("order_id"))
    moves = moves.withColumn("_last", F.coalesce(sure, F.col("_end"))).where(F.col("_maybe") & (F.col("_b") <= F.col("_last")))
    found = _passages(opened(moves), F.col("_entry"), "_b").groupBy("order_id").agg(hit)
    hits = dated.where(F.col("hit").isNotNull()).select("order_id", "hit").unionByName(found.where(F.col("hit").isNotNull()))
    return orders.drop("_b", "_end", "_best0").join(hits, "order_id").select("*", "hit.*").drop("hit")


def trailing_fills(
    orders: DataFrame, bars: DataFrame, model: CostModel, bucket_ns: int = 12 * HOUR_NS
) -> DataFrame:
    """Trailing stops: the trigger follows the best price of un-hit bars.

    ``anchor`` is the mark at submission and ``offset`` the distance kept; an
    order without an offset rests inert.  A bar either hits the trigger and
    fills or tightens it.  The first hit comes from ``first_passages``; only
    what a volume cap leaves of an order is walked on, bar after bar.
    """
    qty = F.col("qty").cast("double")
    buy = F.col("side") > 0
    first = first_passages(orders, bars, bucket_ns).withColumn("_cap", F.coalesce(model.volume_cap(F.col("volume")), qty))
    first = first.withColumn("fill_qty", F.least("_cap", qty))
    shape = ["order_id", "symbol", "side", "ts_event", "low", "high", "fill_qty", "trigger"]
    mirrored = F.col("best") + F.col("offset")
    hits = first.withColumn("trigger", F.when(buy, mirrored).otherwise(-mirrored)).select(*shape)

    tails = first.where(F.col("fill_qty") < qty).select(
        "order_id", "symbol", "side", "offset", "best", "valid_to", qty.alias("qty"), (qty - F.col("fill_qty")).alias("_left"), F.col("ts_event").alias("_from")
    )
    capped = bars.select("symbol", "ts_event", "low", "high", model.volume_cap(F.col("volume")).alias("_cap"))
    pairs = band_join(tails, capped, ["symbol"], start="_from", end="valid_to", at="ts_event", bucket_ns=bucket_ns)
    bar = F.struct("ts_event", "low", "high", F.coalesce("_cap", "qty").alias("cap"))
    order = ["order_id", "symbol", "side", "offset", "best", "_left"]
    walks = pairs.groupBy(*order).agg(F.array_sort(F.collect_list(bar)).alias("_bars"))
    kind = "array<struct<ts_event: bigint, low: double, high: double, fill_qty: double, trigger: double>>"

    def step(state: Column, b: Column) -> Column:
        trigger = state["best"] + F.col("offset")
        far = F.when(buy, b["high"]).otherwise(-b["low"])
        near = F.when(buy, b["low"]).otherwise(-b["high"])
        hit = (far >= trigger) & (state["left"] > 0)
        fill = F.when(hit, F.least(b["cap"], state["left"])).otherwise(F.lit(0.0))
        row = F.struct(b["ts_event"].alias("ts_event"), b["low"].alias("low"), b["high"].alias("high"), fill.alias("fill_qty"), F.when(buy, trigger).otherwise(-trigger).alias("trigger"))
        fills = F.when(hit, F.concat(state["fills"], F.array(row).cast(kind))).otherwise(state["fills"])
        return F.struct((state["left"] - fill).alias("left"), F.when(hit, state["best"]).otherwise(F.least(state["best"], near)).alias("best"), fills.alias("fills"))

    none = F.struct(F.col("_left").alias("left"), F.col("best").alias("best"), F.array().cast(kind).alias("fills"))
    walked = walks.select("order_id", "symbol", "side", F.explode(F.aggregate("_bars", none, step, lambda state: state["fills"])).alias("_f"))
    return _stop_out(hits.unionByName(walked.select("order_id", "symbol", "side", "_f.*").select(*shape)), model, F.col("trigger"))


def unfillable(orders: DataFrame) -> DataFrame:
    """Orders no pricing rule applies to, with the reason."""
    known = F.col("type").isin("market", "limit", "stop", "stop_limit", "trailing")
    reason = (
        F.when(~known, "order type never fills")
        .when(F.col("type").isin("stop", "stop_limit") & F.col("trigger").isNull(), "no trigger")
        .when(F.col("type").isin("limit", "stop_limit") & F.col("limit").isNull(), "no limit")
    )
    return orders.withColumn("reason", reason).where(F.col("reason").isNotNull())


def charge_fees(fills: DataFrame, instruments: DataFrame, model: CostModel) -> DataFrame:
    """Maker or taker fee on each fill's notional in the settlement currency."""
    rate = F.when(F.col("liquidity") == "maker", F.col("maker_fee")).otherwise(F.col("taker_fee"))
    fee = model.fee(
        F.col("px"), F.col("qty"), F.col("multiplier").cast("double"), F.col("is_inverse"), rate
    )
    return fills.join(instruments, "symbol").withColumn("fee", fee)


def open_orders_at(orders: DataFrame, cancels: DataFrame) -> DataFrame:
    """Bound each order's life by its first cancel."""
    first = cancels.groupBy("order_id").agg(F.min("ts").alias("_cancel"))
    return (
        orders.join(first, "order_id", "left")
        .withColumn("valid_to", F.least("valid_to", "_cancel"))
        .drop("_cancel")
    )


