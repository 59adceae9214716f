"""Trades, positions, orders and execution against hand-computed and brute-force results."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tidebook.functions.brokerage import CostModel
from tidebook.operators import execution as X
from tidebook.operators import orders as OR
from tidebook.operators import portfolio as PF
from tidebook.operators import positions as PO
from tidebook.operators import trades as TR
from tidebook.operators.fold import reduce_groups
from tidebook.operators.series import Series, measure_cuts

FILL = "symbol string, ts long, seq long, side long, qty double, px double"
BY_TS = Series.of("symbol", ("ts", "seq"))


def fills(rows, data, symbol="X"):
    return rows(FILL, [(symbol, t, i, s, float(q), float(p)) for i, (t, s, q, p) in enumerate(data)])


def trip(df):
    return [
        (r.entry_ts, r.exit_ts, r.side, r.qty, r.entry_px, r.exit_px, r.pnl)
        for r in df.orderBy("entry_ts", "exit_ts").collect()
    ]


def test_one_round_trip_with_fees(rows):
    df = fills(rows, [(1, 1, 2, 100), (2, -1, 2, 110)])
    assert trip(TR.fifo_trades(df, BY_TS)) == [(1, 2, 1, 2.0, 100.0, 110.0, 20.0)]
    net = trip(TR.fifo_trades(df, BY_TS, fee_rate=0.01))[0][-1]
    assert net == pytest.approx(20.0 - 210.0 * 2 * 0.01)


def test_oldest_lot_closes_first(rows):
    df = fills(rows, [(1, 1, 2, 100), (2, 1, 1, 104), (3, -1, 2, 110)])
    assert trip(TR.fifo_trades(df, BY_TS)) == [(1, 3, 1, 2.0, 100.0, 110.0, 20.0)]
    left = TR.open_exposure(df, ["symbol"]).first()
    assert (left.net_side, left.open_qty) == (1, 1.0)


def test_flip_opens_the_residual(rows):
    df = fills(rows, [(1, 1, 1, 100), (2, -1, 2, 110), (3, 1, 1, 105)])
    assert trip(TR.fifo_trades(df, BY_TS)) == [
        (1, 2, 1, 1.0, 100.0, 110.0, 10.0),
        (2, 3, -1, 1.0, 110.0, 105.0, 5.0),
    ]


def test_partial_fills_count_once(rows):
    part = [(t, 1, 1, 100) for t in range(1, 6)]
    df = fills(rows, [*part, (9, -1, 5, 101)])
    assert trip(TR.fifo_trades(df, BY_TS)) == [(1, 9, 1, 5.0, 100.0, 101.0, 5.0)]
    assert TR.fifo_trades(df, BY_TS, coalesce=False).count() == 5


def test_symbols_never_match_each_other(rows):
    a = fills(rows, [(1, 1, 1, 100), (3, -1, 1, 101)], "AAA")
    b = fills(rows, [(2, 1, 1, 10_000), (4, -1, 1, 10_050)], "BBB")
    both = TR.fifo_trades(a.unionByName(b), BY_TS)
    single = TR.fifo_trades(a, BY_TS).unionByName(TR.fifo_trades(b, BY_TS))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, single.collect()))
    pooled = TR.trade_stats(both, []).first()
    assert (pooled.n_trades, pooled.total_pnl, pooled.profit_factor) == (2, 51.0, float("inf"))


def test_stats_without_trades(rows):
    df = TR.fifo_trades(fills(rows, [(1, 1, 1, 100)]), BY_TS)
    s = TR.trade_stats(df, []).first()
    assert s.n_trades == 0 and s.win_rate == 0.0 and s.profit_factor == 0.0


def _queue(data):
    lots, out = deque(), []
    for t, side, qty, px in data:
        while lots and lots[0][3] == -side and qty:
            lot = lots[0]
            m = min(lot[1], qty)
            out.append((lot[0], t, lot[3], float(m), float(lot[2]), float(px)))
            lot[1] -= m
            qty -= m
            if not lot[1]:
                lots.popleft()
        if qty:
            lots.append([t, qty, px, side])
    return sorted(out)


@pytest.mark.parametrize("rows_per_block", [10_000, 40])
def test_fifo_equals_a_queue(rows, rows_per_block):
    rnd = random.Random(11)
    data = [(t, rnd.choice([1, -1]), rnd.randint(1, 9), rnd.randint(90, 110)) for t in range(300)]
    df = fills(rows, data)
    cuts = measure_cuts(df, ("symbol",), "ts", rows_per_block=rows_per_block)
    got = TR.fifo_trades(df, Series.of("symbol", ("ts", "seq"), cuts), coalesce=False)
    assert sorted(t[:6] for t in trip(got)) == _queue(data)


def test_time_in_market(rows):
    a = fills(rows, [(10, 1, 1, 100), (30, -1, 1, 100)], "A")
    b = fills(rows, [(40, 1, 1, 100)], "B")
    grid = rows("ts long", [(5,), (10,), (20,), (30,), (40,), (50,)])
    out = TR.time_in_market(a.unionByName(b), grid, BY_TS).first().exposure
    assert out == pytest.approx(4 / 6)


def _avg(rows, data, cuts=None, **kw):
    schema = "symbol string, ts long, side long, qty_raw long, px_raw long, fee_raw long"
    df = rows(schema, [("X", t, *d) for t, d in enumerate(data)])
    if kw:
        df = df.withColumns({k: F.lit(v) for k, v in kw.items()})
    return df


def test_average_cost_rounds_half_even_at_each_step(rows):
    s = Series.of("symbol", "ts")
    data = [(1, 1, 100, 0), (1, 1, 101, 1), (1, 2, 103, 0), (-1, 1, 110, 0), (-1, 5, 90, 0)]
    out = PO.average_cost(_avg(rows, data), s).orderBy("ts").collect()
    # 100.5 -> 100 (even), then (2*100 + 2*103) / 4 = 101.5 -> 102 (even)
    assert [r.avg_raw for r in out] == [100, 100, 102, 102, 90]
    assert [r.net_raw for r in out] == [1, 2, 4, 3, -2]
    assert out[-1].realized_raw == -1 + 8 + 3 * (90 - 102)


def test_average_cost_split_at_flat(rows):
    rnd = random.Random(5)
    data = [(rnd.choice([1, -1]), rnd.randint(1, 3), rnd.randint(90, 110), 1) for _ in range(400)]
    df = _avg(rows, data)
    whole = PO.average_cost(df, Series.of("symbol", "ts")).collect()
    cuts = measure_cuts(df, ("symbol",), "ts", rows_per_block=30)
    split = PO.average_cost(df, Series.of("symbol", "ts", cuts)).collect()
    key = lambda r: (r.ts, r.net_raw, r.avg_raw, r.realized_raw)
    assert sorted(map(key, whole)) == sorted(map(key, split))


def test_inverse_realized_pnl(rows):
    df = _avg(
        rows, [(1, 100, 50_000_00, 0), (-1, 100, 55_000_00, 0)], is_inverse=True, multiplier=1
    )
    out = PO.average_cost(df, Series.of("symbol", "ts")).orderBy("ts").collect()[-1]
    want = 100 * (1 / 50_000 - 1 / 55_000)
    assert out.realized_raw / 1e8 == pytest.approx(want, abs=1e-8)


def test_funding_sign(rows):
    df = rows(
        "net double, mark double, multiplier int, is_inverse boolean, rate double",
        [(2.0, 100.0, 1, False, 0.01), (-2.0, 100.0, 1, False, 0.01), (100.0, 50.0, 1, True, 0.01)],
    )
    assert [r.payment for r in PO.funding_payment(df).collect()] == [-2.0, 2.0, -0.02]


def test_curve_snaps_late_fills_to_their_bar(rows):
    bars = rows("symbol string, ts_event long, close double", [("X", 60_000, 100.0), ("X", 120_000, 110.0)])
    df = rows("symbol string, ts long, side long, qty double, px double", [("X", 60_002, 1, 1.0, 100.0)])
    s = Series.of("symbol", "ts_event")
    out = PF.curve_from_fills(df, bars, s, 1000.0, fee_rate=0.0).orderBy("ts_event").collect()
    assert [(r.position, r.equity) for r in out] == [(1.0, 1000.0), (1.0, 1010.0)]


# -- orders --------------------------------------------------------------------

EVENT = "client_order_id long, seq long, event string, order_qty double, last_qty double, last_px double"
ORDER = Series.of("client_order_id", "seq")


def test_order_life_cycle(rows):
    data = [
        (1, 0, "Initialized", 10.0, None, None),
        (1, 1, "Submitted", None, None, None),
        (1, 2, "Accepted", None, None, None),
        (1, 3, "Filled", None, 4.0, 100.0),
        (1, 4, "Accepted", None, None, None),
        (1, 5, "PendingUpdate", None, None, None),
        (1, 6, "Updated", 6.0, None, None),
        (1, 7, "Filled", None, 2.0, 103.0),
        (1, 8, "Canceled", None, None, None),
        (2, 0, "Initialized", 5.0, None, None),
        (2, 1, "Denied", None, None, None),
        (2, 2, "Submitted", None, None, None),
        (3, 0, "Submitted", None, None, None),
    ]
    df = rows(EVENT, data)
    steps = {(r.client_order_id, r.seq): (r.accepted, r.status) for r in OR.order_steps(df, ORDER).collect()}
    assert steps[(1, 3)] == (True, "PartiallyFilled")
    assert steps[(1, 4)] == (False, "PartiallyFilled")
    assert steps[(1, 6)] == (True, "PartiallyFilled")
    assert steps[(1, 8)] == (False, "Filled")
    assert steps[(2, 2)] == (False, "Denied")
    assert steps[(3, 0)] == (False, "")
    states = {r.client_order_id: r for r in OR.order_states(df, ORDER).collect()}
    assert (states[1].filled_qty, states[1].leaves_qty, states[1].avg_px) == (6.0, 0.0, 101.0)
    assert OR.open_orders(OR.order_states(df, ORDER)).where("client_order_id < 3").count() == 0


def test_log_continues_its_sequence(rows):
    old = rows("client_order_id long, seq long", [(1, 0), (1, 1)])
    new = rows("client_order_id long, ts long, event string", [(1, 5, "a"), (1, 6, "b"), (2, 1, "c")])
    s = Series.of("client_order_id", "ts")
    got = {(r.client_order_id, r.event): r.seq for r in OR.number_events(new, s, old).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 3, (2, "c"): 0}


def test_fills_of_both_sides(rows):
    schema = "trade_id long, symbol string, side int, qty double, px double"
    local = rows(schema, [(1, "A", 1, 2.0, 10.0), (1, "A", 1, 2.0, 10.0), (2, "A", -1, 1.0, 11.0), (3, "B", 1, 5.0, 9.0)])
    venue = rows(schema, [(1, "A", 1, 2.0, 10.0), (2, "A", -1, 1.5, 11.0), (4, "B", 1, 5.0, 9.0)])
    problems, nets = OR.reconcile_fills(local, venue)
    assert {tuple(r) for r in problems.collect()} == {(2, "A", "fill_mismatch"), (3, "B", "unknown_fill"), (4, "B", "missing_fill")}
    assert {tuple(r) for r in nets.collect()} == {("A", 1.0, 0.5)}


@pytest.mark.parametrize("near", [64, 0])
def test_positions_that_are_never_flat_are_split(rows, monkeypatch, near):
    """Blocks of a position that only grows and shrinks, entered at the exact rounded average; a table too narrow gives way to the whole key."""
    rnd = random.Random(11)
    data, net = [], {"A": 0, "B": 0}
    for i in range(400):
        symbol = rnd.choice("AAAB")
        q = rnd.randint(1, 9) if net[symbol] < 12 or rnd.random() < 0.6 else -rnd.randint(1, 9)
        net[symbol] += q
        data.append((symbol, i, i, 1 if q > 0 else -1, abs(q), rnd.randint(90, 130), 0))
    df = rows("symbol string, ts long, seq long, side long, qty_raw long, px_raw long, fee_raw long", data)
    cuts = measure_cuts(df, ["symbol"], "ts", 40)
    folded = []
    inner = PO.fold_groups
    monkeypatch.setattr(PO, "fold_groups", lambda df, *a, **k: folded.append(df) or inner(df, *a, **k))
    monkeypatch.setattr(PO, "NEAR", near)
    want = {(r.symbol, r.seq): (r.net_raw, r.avg_raw, r.realized_raw) for r in PO.average_cost(df, BY_TS).collect()}
    got = {(r.symbol, r.seq): (r.net_raw, r.avg_raw, r.realized_raw) for r in PO.average_cost(df, Series.of("symbol", ("ts", "seq"), cuts)).collect()}
    assert got == want and all(n for n, *_ in list(want.values())[20:])
    if near:
        assert folded[-1].where("_block < 0").count() == 0 and folded[-1].where("symbol = 'A'").select("_block").distinct().count() > 4


def test_groups_stay_whole_behind_a_join_that_turns_into_a_broadcast(spark):
    """Spark then reads the rows by mapper, unless something asks for whole groups."""

    class Count:
        n = 0

        def take(self, v):
            self.n += len(v)

        def result(self):
            return (self.n,)

    few, own = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(few)
    spark.conf.set(few, "-1")
    spark.conf.set(own, "10m")
    try:
        rows = spark.range(0, 20_000, 1, 8).selectExpr("id % 5000 as k", "id as v")
        joined = rows.join(spark.range(5000).selectExpr("id as k", "id as x"), "k")
        out = [StructField("n", LongType())]
        reduced = reduce_groups(joined, ["k"], ["v"], Count, ("v",), tuple(out))
        assert "Window" in reduced._jdf.queryExecution().executedPlan().toString()
        found = reduced.collect()
    finally:
        spark.conf.set(few, before)
        spark.conf.unset(own)
    assert sorted(tuple(r) for r in found) == [(k, 4) for k in range(5000)]


def test_blocked_positions_gain_as_plain_ones(rows):
    """Linear and inverse fills, several blocks, positions that turn and amounts beyond 64 bits on the way."""
    rnd = random.Random(5)
    schema = "symbol string, ts long, seq long, side long, qty_raw long, px_raw long, fee_raw long, multiplier long, is_inverse boolean"
    data = [(s, i, i, rnd.choice((1, -1)), rnd.randint(1, 9), rnd.randint(90, 130) * big, rnd.randint(0, 2), 1 + (s == "B"), s == "B") for i in range(300) for s, big in (("A", 1), ("B", 1), ("C", 10**15))]
    df = rows(schema, data)
    cuts = measure_cuts(df, ["symbol"], "ts", 40)
    whole = PO.average_cost(df, BY_TS)
    split = PO.average_cost(df, Series.of("symbol", ("ts", "seq"), cuts)).select(*whole.columns)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.select(*split.columns).collect()))


# -- execution ------------------------------------------------------------------

BAR = "symbol string, ts_event long, open double, high double, low double, close double, volume double"
ORD = (
    "order_id long, symbol string, ts_decision long, valid_to long, side long, type string, qty long, "
    "limit double, trigger double, ref double, offset double, anchor double"
)
FREE = CostModel(slippage_bps=0.0, participation_rate=0.1, latency_ns=7)


def order(i, side, kind, qty, limit=None, trigger=None, ref=None, offset=None, anchor=None):
    return (i, "X", 0, 1000, side, kind, qty, limit, trigger, ref, offset, anchor)


def bar_table(rows, bars):
    return rows(BAR, [("X", i + 1, *map(float, x)) for i, x in enumerate(bars)])


def life(rows, orders, bars):
    return X.life_bars(rows(ORD, orders), bar_table(rows, bars), bucket_ns=100)


def got(df):
    return [(r.order_id, r.ts_event, r.qty, r.px, r.liquidity) for r in df.orderBy("order_id", "ts_event").collect()]


def test_market_order_open_then_close(rows):
    bars = [(100, 105, 95, 101, 40), (102, 106, 99, 104, 100)]
    out = got(X.market_fills(life(rows, [order(1, 1, "market", 10)], bars), FREE))
    assert out == [(1, 1, 4.0, 100.0, "taker"), (1, 2, 6.0, 104.0, "taker")]


def test_no_volume_no_cap(rows):
    out = got(X.market_fills(life(rows, [order(1, 1, "market", 10)], [(100, 100, 100, 100, 0)]), FREE))
    assert out == [(1, 1, 10.0, 100.0, "taker")]


def test_thin_bar_fills_one_lot(rows):
    out = got(X.market_fills(life(rows, [order(1, 1, "market", 3)], [(9, 9, 9, 9, 2)] * 4), FREE))
    assert [q for _, _, q, *_ in out] == [1.0, 1.0, 1.0]


def test_marketable_limit_gapped_away_rests(rows):
    bars = [(105, 106, 101, 104, 1000), (103, 104, 99, 100, 1000)]
    out = got(X.limit_fills(life(rows, [order(1, 1, "limit", 5, limit=102.0, ref=100.0)], bars), FREE))
    assert out == [(1, 2, 5.0, 102.0, "maker")]
    bars = [(101, 106, 101, 104, 1000)]
    out = got(X.limit_fills(life(rows, [order(1, 1, "limit", 5, limit=102.0, ref=100.0)], bars), FREE))
    assert out == [(1, 1, 5.0, 101.0, "taker")]


def test_queue_touch_waits_and_through_clears(rows):
    model = CostModel(slippage_bps=0.0, participation_rate=0.1, queue_ahead_factor=0.15)
    o = [order(1, 1, "limit", 30, limit=100.0)]
    touch, through = (101, 102, 100, 101, 100), (101, 102, 99, 101, 100)
    # queue 15: the first touch pays 10, the second 5 and fills 5, then 10 a bar
    out = got(X.queue_limit_fills(life(rows, o, [touch] * 5), model))
    assert [(t, q) for _, t, q, *_ in out] == [(2, 5.0), (3, 10.0), (4, 10.0), (5, 5.0)]
    out = got(X.queue_limit_fills(life(rows, o, [touch, through, touch]), model))
    assert [(t, q) for _, t, q, *_ in out] == [(2, 10.0), (3, 10.0)]


def test_stop_fills_at_worse_of_trigger_and_gap(rows):
    bars = [(100, 104, 99, 103, 1000), (107, 108, 106, 107, 1000)]
    out = got(X.stop_fills(life(rows, [order(1, 1, "stop", 5, trigger=105.0)], bars), FREE))
    assert out == [(1, 2, 5.0, 106.0, "taker")]


def test_stop_limit_rests_from_the_next_bar(rows):
    bars = [(100, 106, 99, 105, 1000), (106, 107, 105.5, 106, 1000), (105, 106, 104, 105, 1000)]
    o = [order(1, 1, "stop_limit", 5, limit=105.0, trigger=105.0)]
    assert got(X.stop_limit_fills(life(rows, o, bars).drop("ref"), FREE)) == [(1, 3, 5.0, 105.0, "maker")]


def test_trailing_stop_ratchets(rows):
    bars = [(100, 104, 99, 104, 20), (104, 110, 103, 109, 20), (109, 109, 104, 105, 20), (105, 120, 90, 100, 20)]
    o = [order(1, -1, "trailing", 4, offset=5.0, anchor=100.0), order(2, -1, "trailing", 4, anchor=100.0)]
    out = got(X.trailing_fills(rows(ORD, o), bar_table(rows, bars), FREE, bucket_ns=2))
    # trigger 95, 99, then 105: hit on bar 3, and again with the unmoved trigger on bar 4
    assert out == [(1, 3, 2.0, 105.0, "taker"), (1, 4, 2.0, 105.0, "taker")]


def random_market(seed, n_bars=70, n_orders=60):
    rnd = random.Random(seed)
    bars, px = [], 100.0
    for _ in range(n_bars):
        o, px = px, px + rnd.choice([-2.0, -1.0, 0.0, 1.0, 2.0])
        bars.append((o, max(o, px) + 1, min(o, px) - 1, px, rnd.choice([0, 10, 20, 50, 90])))
    orders = [
        (i, "X", rnd.randrange(0, n_bars - 10), rnd.randrange(n_bars - 40, n_bars + 20), rnd.choice([1, -1]), "x", rnd.randint(1, 30), None, None, None, float(rnd.randint(1, 9)), 100.0 + rnd.randint(-4, 4))
        for i in range(n_orders)
    ]
    return bars, orders


@pytest.mark.parametrize("block", [None, 9])
def test_capacity_fills_are_those_of_all_bars(rows, block):
    """The axis of capacity gives the fills that walking every bar of a life gives."""
    bars, orders = random_market(5)
    orders = [(*o[:5], "market", *o[6:]) for o in orders]
    table, asked = bar_table(rows, bars), rows(ORD, orders)
    cuts = measure_cuts(table, ["symbol"], "ts_event", block) if block else None
    want = got(X.market_fills(X.life_bars(asked, table, bucket_ns=8), FREE))
    assert got(X.capacity_fills(asked, table, FREE, cuts)) == want and len(want) > 100
    free = CostModel(slippage_bps=0.0, participation_rate=0.0, latency_ns=7)
    assert got(X.capacity_fills(asked, table, free, cuts)) == got(X.market_fills(X.life_bars(asked, table, bucket_ns=8), free))
    seen = {r.order_id: r.n_bars for r in X.bars_in_life(asked, table, cuts).collect()}
    assert seen == {o[0]: sum(o[2] < t <= o[3] for t in range(1, len(bars) + 1)) for o in orders}


def test_only_bars_that_fill_are_paired(spark, rows):
    """No plan of the capacity fills expands a life into its bars."""
    bars, orders = random_market(6)
    plan = X.capacity_fills(rows(ORD, orders), bar_table(rows, bars), FREE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "sequence(first_n" in plan


def test_precision_of_each_instrument(rows):
    bars = [(100.1249, 101, 99, 100, 0)]
    model = CostModel(slippage_bps=0.0, price_precision="decimals", fee_precision="decimals")
    orders = rows(ORD + ", decimals int", [(*order(i, 1, "market", 1), d) for i, d in enumerate([0, 2, 3, None])])
    out = X.capacity_fills(orders, bar_table(rows, bars), model).collect()
    assert {r.order_id: r.px for r in out} == {0: 100.0, 1: 100.12, 2: 100.125, 3: 100.1249}
    fills = rows("symbol string, px double, qty double, liquidity string", [("A", 10.0, 1.2345, "maker"), ("B", 10.0, 1.2345, "maker")])
    dims = rows("symbol string, multiplier long, is_inverse boolean, maker_fee double, taker_fee double, decimals int", [("A", 1, False, 0.1, 0.2, 1), ("B", 1, False, 0.1, 0.2, 3)])
    assert {r.symbol: r.fee for r in X.charge_fees(fills, dims, model).collect()} == {"A": 1.2, "B": 1.234}
    with pytest.raises(Exception, match="decimals out of range"):
        X.capacity_fills(orders.withColumn("decimals", F.lit(40)), bar_table(rows, bars), model).collect()


def test_halves_of_the_last_decimal(rows):
    bars = [(0.5, 1, 0, 0, 0), (2.5, 3, 0, 0, 0)]
    late = order(1, 1, "market", 1)
    orders = rows(ORD, [order(0, 1, "market", 1), (*late[:2], 1, *late[3:])])
    for even, want in ((True, {0: 0.0, 1: 2.0}), (False, {0: 1.0, 1: 3.0})):
        model = CostModel(slippage_bps=0.0, price_precision=0, half_even=even)
        out = X.next_open_fills(orders, bar_table(rows, bars), model).collect()
        assert {r.order_id: r.px for r in out} == want


def walked_trails(bars, orders):
    out = []
    for i, _, start, end, side, _, qty, _, _, _, offset, anchor in orders:
        left, best = float(qty), anchor
        for t, (_, high, low, _, volume) in enumerate(bars, 1):
            if start < t <= end and left > 0:
                trigger = best + offset * side
                if high >= trigger if side > 0 else low <= trigger:
                    fill = min(left, max(volume // 10, 1) if volume else qty)
                    left -= fill
                    out.append((i, t, fill, max(trigger, low) if side > 0 else min(trigger, high), "taker"))
                else:
                    best = min(best, low) if side > 0 else max(best, high)
    return sorted(out)


@pytest.mark.parametrize("bucket", [1, 4, 15, 1000])
def test_trailing_fills_are_those_of_a_walk(rows, bucket):
    for seed in (7, 8):
        bars, orders = random_market(seed)
        out = got(X.trailing_fills(rows(ORD, orders), bar_table(rows, bars), FREE, bucket_ns=bucket))
        assert out == walked_trails(bars, orders) and len(out) > 60


def test_trailing_stops_open_few_bars_and_no_python(spark, rows):
    bars, orders = random_market(9)
    frame = X.trailing_fills(rows(ORD, orders), bar_table(rows, bars), FREE)
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString() and "Arrow" not in frame._jdf.queryExecution().executedPlan().toString()


def test_reach_bars_change_no_fill(rows):
    rnd = random.Random(8)
    bars, px = [], 100.0
    for _ in range(60):
        o, px = px, px + rnd.choice([-2.0, -1.0, 0.0, 1.0, 2.0])
        bars.append((o, max(o, px) + 1, min(o, px) - 1, px, rnd.choice([10, 20, 50])))
    orders = [
        (i, "X", rnd.randrange(0, 40), rnd.randrange(41, 90), rnd.choice([1, -1]), kind, rnd.randint(1, 9),
         None if kind == "stop" else px_, None if kind == "limit" else px_ + 1, 100.0, None, None)
        for i in range(60)
        for kind in [rnd.choice(["limit", "stop", "stop_limit"])]
        for px_ in [float(rnd.randint(92, 108))]
    ]
    o = rows(ORD, orders)
    b = rows(BAR, [("X", i + 1, *map(float, x)) for i, x in enumerate(bars)])
    model = CostModel(queue_ahead_factor=0.3)
    whole, few = X.life_bars(o, b, bucket_ns=16), X.reach_bars(o, b, bucket_ns=4)
    assert few.count() < whole.count()
    for kind, fn in (("limit", X.limit_fills), ("limit", X.queue_limit_fills), ("stop", X.stop_fills), ("stop_limit", X.stop_limit_fills)):
        one = lambda df: got(fn(df.where(F.col("type") == kind), model))  # noqa: E731, B023
        assert one(whole) == one(few) != []


def test_slippage_range_part_stops_at_the_extreme(rows):
    model = CostModel(slippage_bps=10.0, range_impact=10.0)
    df = rows("side long, ref double, low double, high double", [(1, 100.0, 90.0, 101.0), (-1, 100.0, 90.0, 101.0), (1, 101.0, 90.0, 101.0)])
    px = df.select(model.fill_price(*[F.col(c) for c in ("side", "ref", "low", "high")]).alias("p"))
    assert [round(r.p, 6) for r in px.collect()] == [101.0, 90.0, 101.101]


def test_unfillable_types(rows):
    df = rows(ORD, [order(1, 1, "if_touched", 1), order(2, 1, "stop", 1), order(3, 1, "market", 1)])
    assert {r.order_id for r in X.unfillable(df).collect()} == {1, 2}


def test_tick_events_carry_no_volume(rows):
    schema = "symbol string, ts_event long, kind string, open double, high double, low double, close double, volume double, price double, bid double, ask double"
    df = rows(schema, [
        ("X", 1, "trade", None, None, None, None, None, 94.0, None, None),
        ("X", 2, "quote", None, None, None, None, None, None, 99.0, 101.0),
        ("X", 3, "delta", None, None, None, None, None, None, None, None),
    ])
    out = {r.kind: (r.low, r.high, r.close, r.volume) for r in X.adapt_events(df).collect()}
    assert out == {"trade": (94.0, 94.0, 94.0, None), "quote": (99.0, 101.0, 100.0, None)}


@pytest.fixture
def fills_of_a_long_key(spark):
    data = [("X", i, i, 1 if i * 7 % 5 < 3 else -1, float(1 + i % 3), 100.0 + i // 2 % 4) for i in range(120)]
    df = spark.createDataFrame(data, "symbol string, ts long, seq long, side long, qty double, px double")
    return df, Series.of("symbol", ("ts", "seq"), measure_cuts(df, ["symbol"], "ts", 20)), Series.of("symbol", ("ts", "seq"))


def test_fifo_of_a_split_series_stages_what_it_needs(spark, fills_of_a_long_key, monkeypatch):
    """Columns that round trips don't need are neither staged nor numbered again."""
    from tidebook.operators import series as SE

    df, series, whole = fills_of_a_long_key
    seen = []
    kept = SE.staged
    monkeypatch.setattr(SE, "staged", lambda d: seen.append(d.columns) or kept(d))
    got = TR.fifo_trades(df.withColumn("note", F.lit("x")), series)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, TR.fifo_trades(df, whole).collect()))
    assert seen and not any("note" in c for c in seen) and len(seen) <= 4
