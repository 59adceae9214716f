"""Metrics, screens, parity, walk-forward, options, risk and books."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidebook.operators import bias as BI
from tidebook.operators import book as BK
from tidebook.operators import metrics as M
from tidebook.operators import options as OP
from tidebook.operators import parity as PA
from tidebook.operators import risk as RK
from tidebook.operators import signals as S
from tidebook.operators import walkforward as W
from tidebook.operators.series import Series, measure_cuts

CURVE = "run string, ts_event long, equity double"
RUN = Series.of("run", "ts_event")


def curve(rows, values, run="r"):
    return rows(CURVE, [(run, i, float(v)) for i, v in enumerate(values)])


def test_metrics_by_hand(rows):
    m = M.perf_metrics(curve(rows, [100, 110, 99, 108.9]), RUN, annualization=1).first()
    rets = [0.1, -0.1, 0.1]
    mean = sum(rets) / 3
    sd = math.sqrt(sum((x - mean) ** 2 for x in rets) / 3)
    assert m.total_return == pytest.approx(0.089)
    assert m.sharpe == pytest.approx(mean / sd)
    assert m.sortino == pytest.approx(mean / 0.1)
    assert m.max_drawdown == pytest.approx(0.1)
    short = M.perf_metrics(curve(rows, [100]), RUN).first()
    assert (short.total_return, short.sharpe, short.n_periods) == (0.0, 0.0, 1)


def test_percentiles_interpolate(rows):
    df = rows("metric string, latency_ns long", [("a", v) for v in (10, 20, 20, 40)] + [("b", 5)])
    out = {r.metric: (r.p50, r.n) for r in M.latency_percentiles(df).collect()}
    assert out == {"a": (20.0, 4), "b": (5.0, 1)}


@pytest.mark.parametrize("digit", [8, 16, 32])
def test_percentiles_of_any_long(rows, digit):
    rnd = random.Random(digit)
    values = {g: [rnd.choice([rnd.randint(-9, 9), rnd.randint(-(2**62), 2**62), 5]) for _ in range(n)] for g, n in (("a", 301), ("b", 2), (None, 40))}
    wanted = [(g, rank) for g, own in values.items() if g for rank in (0, 1, len(own) // 2, len(own) - 1)]
    df = rows("metric string, latency_ns long", [(g, v) for g, own in values.items() for v in own] + [("a", None)])
    found = M.values_at_ranks(df, "metric", "latency_ns", rows("metric string, rank long", sorted(set(wanted))), digit)
    assert {(r.metric, r["rank"], r.latency_ns) for r in found.collect()} == {(g, k, sorted(values[g])[k]) for g, k in wanted}


def test_percentiles_of_ten_million_distinct_values(spark):
    rows = spark.range(10_000_000).select(F.lit("m").alias("metric"), (F.col("id") * 7919 % 10_000_019 * 1000).alias("latency_ns"))
    frame = M.latency_percentiles(rows)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 6  # one scan a round and those of the totals
    values = sorted(i * 7919 % 10_000_019 * 1000 for i in range(10_000_000))
    (got,) = frame.collect()
    for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        x = p * (len(values) - 1)
        low, high = values[int(x)], values[min(int(x) + 1, len(values) - 1)]
        assert got[name] == pytest.approx(low + (high - low) * (x - int(x)))


def test_refit_on_all_rows_and_history(rows):
    scores = rows(
        "k string, fold long, role string, combo long, fast int, slow int, score double",
        [("x", f, role, c, 2 + c, 9, s) for f, role, c, s in [(0, "train", 0, 1.0), (0, "train", 1, 2.0), (0, "test", 0, 5.0), (0, "test", 1, 0.0), (-1, "all", 0, 3.0), (-1, "all", 1, 2.5)]],
    )
    (best,) = W.refit(scores, ["k"]).collect()
    assert (best.k, best.fast, best.score) == ("x", 2, 3.0)
    trials = {(r.fold, r.role, r.fast, r.slow): r.score for r in W.history(scores, ["k"], [{"fast": 9, "slow": 9}]).collect()}
    bad = float("-inf")
    assert trials == {(0, "train", 2, 9): 1.0, (0, "train", 3, 9): 2.0, (-1, "all", 2, 9): 3.0, (-1, "all", 3, 9): 2.5, (0, "train", 9, 9): bad, (-1, "all", 9, 9): bad}
    parts = rows("k string, fold long, role string, v int", [("x", 0, "train", 1)])
    assert {(r.fold, r.role, r.v) for r in W.with_whole(parts, rows("k string, v int", [("x", 1), ("x", 2)])).collect()} == {(0, "train", 1), (-1, "all", 1), (-1, "all", 2)}


def test_lookahead_and_overfit(rows):
    bars = rows("k int, ts_event long", [(1, 100), (1, 200), (1, 300)])
    fills = rows("k int, ts long", [(1, 99), (1, 100), (1, 400), (1, 401)])
    got = {r.ts: r.problem for r in BI.lookahead_fills(fills, bars, ["k"]).collect()}
    assert got == {99: "before_first_bar", 401: "after_last_bar"}
    m = rows("k int, total_return double, max_drawdown double", [(1, 0.1, 0.0), (2, 0.1, 0.1)])
    s = rows("k int, n_trades long, win_rate double", [(1, 8, 0.95), (2, 7, 1.0)])
    flags = {r.k: r.warnings for r in BI.overfit_flags(m, s, ["k"]).collect()}
    assert flags == {1: ["implausible_win_rate", "zero_drawdown_with_profit"], 2: []}


SESSION = "k int, ts long, side long, qty double, px double"
FILLS = [(1, 60, 1, 1.0, 100.0), (1, 180, -1, 1.0, 101.0), (1, 300, 1, 1.0, 102.0)]
EQ = [(1, i * 60, 100_000.0 + 40 * i) for i in range(6)]


def parity(rows, fills_b, eq_b=EQ):
    a, b = rows(SESSION, FILLS), rows(SESSION, fills_b)
    ca, cb = (rows("k int, ts_event long, equity double", e) for e in (EQ, eq_b))
    return PA.verdict(PA.parity_metrics(a, ca, b, cb, ["k"], bucket_ns=60)).first()


def test_parity_verdicts(rows):
    same = parity(rows, FILLS)
    assert same.passed and same.signal_agreement == 1.0 and same.equity_corr == pytest.approx(1.0)
    near = parity(rows, [(k, t, s, q, p * 1.0002) for k, t, s, q, p in FILLS])
    assert near.passed and near.fill_dev_bps == pytest.approx(2.0)
    far = parity(rows, [(k, t, s, q, p * 1.005) for k, t, s, q, p in FILLS])
    assert far.reasons == ["fill_dev_bps"]
    dropped = parity(rows, FILLS[:2])
    assert dropped.signal_agreement == pytest.approx(0.8) and "signal_agreement" in dropped.reasons
    flat = parity(rows, FILLS, [(1, i, 5.0) for i in range(3)])
    assert flat.equity_corr == 0.0 and not flat.passed


def test_rolling_and_anchored_splits(rows):
    df = rows("symbol string, ts_event long", [("X", i) for i in range(103)])
    s = Series.of("symbol", "ts_event")
    roll = W.rolling_splits(df, s).groupBy("fold", "role").count().collect()
    assert {(r.fold, r.role): r["count"] for r in roll} == {
        (0, "train"): 15, (0, "test"): 10, (1, "train"): 15, (1, "test"): 10,
        (2, "train"): 15, (2, "test"): 10, (3, "train"): 16, (3, "test"): 12,
    }
    anch = W.anchored_splits(df, s).groupBy("fold", "role").count().collect()
    assert {(r.fold, r.role): r["count"] for r in anch} == {
        (i, role): n for i in range(4)
        for role, n in (("train", 20 * (i + 1)), ("test", 20 if i < 3 else 23))
    }
    tiny = rows("symbol string, ts_event long", [("X", 0)])
    assert W.rolling_splits(tiny, s).count() == 0


def test_grid_choice(rows):
    inf, nan = float("inf"), float("nan")
    df = rows("g int, combo long, score double", [(1, 0, 2.0), (1, 1, 3.0), (1, 2, 3.0), (1, 3, inf), (2, 0, nan), (2, 1, -inf)])
    assert {r.g: r.combo for r in M.best_per_group(df, ["g"]).collect()} == {1: 1, 2: 0}
    d = W.degradation(rows("k int, is_score double, oos_score double", [(1, 2.0, 1.0), (1, nan, 2.0)]), ["k"]).first()
    assert (d.is_mean, d.oos_mean, d.degradation, d.n_folds) == (2.0, 1.5, 0.25, 2)
    zero = W.degradation(rows("k int, is_score double, oos_score double", [(1, 0.0, 1.0)]), ["k"]).first()
    assert math.isnan(zero.degradation)


def test_user_signal_and_objective(rows):
    bars = rows("symbol string, ts_event long, close double", [("X", i, float(i % 5)) for i in range(40)])
    s = Series.of("symbol", "ts_event")
    fn = lambda pdf: (pdf["close"] > pdf["close"].shift(1)).astype(float)
    whole = S.signal_function(bars, s, fn, 1).orderBy("ts_event").collect()
    cuts = measure_cuts(bars, ("symbol",), "ts_event", rows_per_block=7)
    split = S.signal_function(bars, Series.of("symbol", "ts_event", cuts), fn, 1).orderBy("ts_event").collect()
    assert [r.position for r in whole] == [r.position for r in split]
    parts = W.rolling_splits(bars, s, 2)
    scores = W.objective_scores(parts, ["symbol"], [{"k": 1}, {"k": 2}], lambda p, pdf: p["k"] * pdf["close"].sum(), "ts_event")
    assert scores.count() == 8


def test_length_mismatch_is_reported(rows):
    a = rows("s string, t long", [("X", 1), ("X", 2)])
    b = rows("s string, t long", [("X", 2), ("X", 3)])
    out = {(r.t, r.problem) for r in S.check_lengths(a, b, ["s", "t"]).collect()}
    assert out == {(1, "no position"), (3, "no bar")}


def test_cross_holds_on_touch_and_starts_flat(rows):
    lines = rows("symbol string, ts_event long, f double, s double", [("X", i, float(f), float(s)) for i, (f, s) in enumerate([(2, 1), (1, 1), (2, 1), (1, 1), (0, 1), (2, 1)])] )
    x = Series.of("symbol", "ts_event")
    held = S.hold_last(S.cross_events(lines, x, "f", "s"), x, "cross").orderBy("ts_event").collect()
    assert [r.state for r in held] == [None, None, 1, 1, -1, 1]


# -- options --------------------------------------------------------------------

CHAIN = "spot double, strike double, t_years double, rate double, vol double, is_call boolean"


def test_textbook_prices_and_parity(rows):
    df = rows(CHAIN, [(100.0, 100.0, 1.0, 0.05, 0.2, True), (100.0, 100.0, 1.0, 0.05, 0.2, False), (110.0, 100.0, 0.0, 0.05, 0.2, True)])
    call, put, dead = (r.price for r in OP.price_chain(df).collect())
    assert call == pytest.approx(10.4506, abs=1e-3) and put == pytest.approx(5.5735, abs=1e-3)
    assert call - put == pytest.approx(100 - 100 * math.exp(-0.05), abs=1e-6)
    assert dead == 10.0
    g = OP.chain_greeks(df).collect()
    assert g[0].delta - g[1].delta == pytest.approx(1.0, abs=1e-6) and g[0].gamma == g[1].gamma
    assert g[2].delta == 0.0


def test_implied_vol_round_trip(rows):
    data = [(s, 100.0, t, 0.03, v, c) for s in (60.0, 100.0, 140.0) for t in (0.1, 1.0) for v in (0.1, 0.5, 1.5) for c in (True, False)]
    priced = OP.price_chain(rows(CHAIN, data))
    # near-worthless prices carry no volatility information
    out = OP.implied_vol(priced.where("price > 0.01")).withColumn("d", F.abs(F.col("iv") - F.col("vol")))
    time_value = "price - greatest(case when is_call then spot - strike * exp(-rate * t_years) else strike * exp(-rate * t_years) - spot end, 0) > 0.001"
    assert out.where(time_value).agg(F.max("d")).first()[0] < 1e-4
    bad = rows("price double, " + CHAIN, [(5.0, 120.0, 100.0, 1.0, 0.0, 0.2, True), (0.0, 100.0, 100.0, 1.0, 0.0, 0.2, True)])
    assert [r.iv for r in OP.implied_vol(bad).collect()] == [None, None]


def test_settlement(rows):
    schema = "instrument string, underlying string, net double, expiry_ns long, strike double, is_call boolean, is_option boolean, own_mark double"
    pos = rows(schema, [
        ("C", "U", 2.0, 100, 50.0, True, True, 1.0), ("SELF", "SELF", -1.0, 100, 50.0, False, True, 45.0),
        ("F", "U", 1.0, 100, None, None, False, 61.0), ("FLAT", "U", 0.0, 100, 50.0, True, True, 1.0),
    ])
    marks = rows("symbol string, ts_event long, close double", [("U", 90, 58.0), ("U", 101, 99.0)])
    out = {r.instrument: (r.side, r.qty, r.px, r.fee) for r in OP.settle_at_expiry(pos, marks).collect()}
    assert out == {"C": (-1, 2.0, 8.0, 0.0), "SELF": (1, 1.0, 5.0, 0.0), "F": (-1, 1.0, 61.0, 0.0)}


# -- risk ------------------------------------------------------------------------


def test_deny_order_and_unlimited(rows):
    schema = (
        "id int, killed boolean, ref_px double, multiplier double, position double, gross double, equity double, "
        "expiry_ns long, ts_decision long, side long, qty double, min_notional double, max_order_notional double, "
        "max_position_qty double, max_gross double, leverage double"
    )
    base = dict(killed=False, ref_px=10.0, multiplier=1.0, position=5.0, gross=50.0, equity=100.0, expiry_ns=None, ts_decision=5, side=1, qty=1.0, min_notional=None, max_order_notional=None, max_position_qty=None, max_gross=None, leverage=None)
    cases = [
        ({}, None), ({"killed": True, "expiry_ns": 1}, "expired"), ({"killed": True, "min_notional": 11.0}, "kill_switch"), ({"expiry_ns": 5}, "expired"),
        ({"min_notional": 11.0}, "min_notional"), ({"max_order_notional": 9.0, "max_gross": 1.0}, "max_order_notional"),
        ({"max_position_qty": 5.5}, "max_position"), ({"max_gross": 49.0}, "max_gross_exposure"),
        ({"leverage": 1.0, "qty": 6.0}, "insufficient_margin"), ({"leverage": 1.0, "qty": 5.0}, None),
        ({"leverage": 1.0, "side": -1, "qty": 5.0}, None),
    ]
    data = [(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)]
    got = {r.id: r.reason for r in RK.deny_reason(rows(schema, data)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_protections(rows):
    s = Series.of("k", ("ts", "seq"))
    day = 86_400_000_000_000
    data = [(1, i * day, i, p) for i, p in enumerate([-1.0, -1.0, 1.0, -1.0, 5.0, 5.0])]
    out = {r.ts // day: (r.losses, r.tripped) for r in RK.stoploss_guard(rows("k int, ts long, seq long, pnl double", data), s, 2, 2 * 86_400, 10).collect()}
    assert out == {0: (1, False), 1: (2, True), 2: (2, True), 3: (2, True), 4: (1, False), 5: (1, False)}
    eq = rows("k int, ts long, seq long, equity double", [(1, 0, 0, 100.0), (1, 1, 1, 70.0), (1, 2, 2, 90.0)])
    guard = RK.drawdown_guard(eq, s, 0.2, 1)
    halted = RK.should_halt(RK.cooldown(guard, s)).orderBy("ts").collect()
    assert [(r.tripped, r.cooling, r.halt) for r in halted] == [(False, False, False), (True, False, True), (False, True, True)]


def test_account_trips_once(rows):
    schema = "account int, ts long, seq long, equity double, gross_exposure double, net_exposure double, realized_pnl double, unrealized_pnl double"
    data = [(1, i, i, *v, None, None, None) for i, v in enumerate([(100.0, None), (None, 200.0), (85.0, None), (70.0, None), (None, 5000.0)])]
    states = RK.account_state(rows(schema, data), Series.of("account", ("ts", "seq")))
    hit = RK.first_trip(RK.account_breaches(states, 0.25, 1000.0, 1e9, 1e9), "account", ["ts", "seq"]).collect()
    assert [(r.ts, r.limits) for r in hit] == [(3, "max_drawdown")]


# -- books -----------------------------------------------------------------------

DELTA = "symbol string, ts long, seq long, side int, price double, size double, sequence long, action string"


def _brute(deltas):
    book, last, out = {1: {}, -1: {}}, None, []
    for _, ts, seq, side, price, size, sequence, action in deltas:
        if action == "Clear":
            book, last = {1: {}, -1: {}}, sequence
        elif last is None or sequence >= last:
            last = sequence
            if action == "Delete" or size <= 0:
                book[side].pop(price, None)
            else:
                book[side][price] = size
        out.append((seq, max(book[1], default=None), min(book[-1], default=None)))
    return out, {(s, p): q for s in book for p, q in book[s].items()}


@pytest.mark.parametrize("rows_per_block", [10_000, 25])
def test_books_match_a_sequential_book(rows, rows_per_block):
    rnd = random.Random(2)
    data = [
        ("X", i // 3, i, rnd.choice([1, -1]), float(rnd.randint(90, 99)), float(rnd.randint(0, 3)), i - rnd.choice([0, 0, 0, 9]),
         "Clear" if i % 41 == 40 else rnd.choice(["Add", "Update", "Delete"]))
        for i in range(250)
    ]
    df = rows(DELTA, data)
    s = Series.of("symbol", ("ts", "seq"), measure_cuts(df, ("symbol",), "ts", rows_per_block=rows_per_block))
    want, levels = _brute(data)
    got = BK.book_series(df, s).orderBy("seq").collect()
    assert [(r.seq, r.bid, r.ask) for r in got] == want
    end = {(r.side, r.price): r.size for r in BK.book_at(df, s).collect()}
    assert end == levels
    until = {(r.side, r.price): r.size for r in BK.book_at(df, s, until=50).collect()}
    assert until == _brute([d for d in data if d[1] <= 50])[1]


def test_snapshot_continuity(rows):
    schema = "symbol string, arrival long, kind string, first_id long, last_id long, prev_id long"
    data = [
        ("X", 0, "snapshot", None, 100, None), ("X", 1, "diff", 90, 99, None), ("X", 2, "diff", 99, 105, None),
        ("X", 3, "diff", 106, 110, 105), ("X", 4, "diff", 109, 115, 108), ("X", 5, "snapshot", None, 120, None),
        ("X", 6, "diff", 130, 140, None), ("X", 7, "diff", 119, 125, None), ("X", 8, "diff", 126, 127, None),
    ]
    out = BK.snapshot_continuity(rows(schema, data), Series.of("symbol", "arrival")).orderBy("arrival").collect()
    assert [r.outcome for r in out] == ["snapshot", "skipped", "applied", "applied", "resync", "snapshot", "resync", "applied", "applied"]
