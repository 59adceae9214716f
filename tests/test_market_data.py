"""Lake, readers, message normalizers and instrument rules."""

import json

import pytest
from pyspark.sql import functions as F

from tidebook.functions import values as V
from tidebook.operators import bars as B
from tidebook.operators import instruments as I
from tidebook.operators.series import Series
from tidebook.sources import lake, normalize

DAY = 86_400 * V.NANOS
JAN31 = 1_706_659_200 * V.NANOS  # 2024-01-31
BAR = (
    "venue string, symbol string, interval string, ts_event long, open double, high double, "
    "low double, close double, volume double, batch_seq long"
)


def bar(ts, close, symbol="BTC", interval="1m", batch=0):
    return ("V", symbol, interval, ts, close, close, close, close, 1.0, batch)


def test_lake_round_trip(spark, rows, tmp_path):
    root = str(tmp_path / "lake")
    first = [bar(JAN31 + i * DAY // 2, float(i)) for i in range(5)]
    assert lake.write_bars(spark, root, rows(BAR, first)) == 5
    # last write wins, within a batch too; only the touched month counts
    again = [bar(JAN31, 50.0, batch=1), bar(JAN31, 60.0, batch=2)]
    assert lake.write_bars(spark, root, rows(BAR, again)) == 2
    assert lake.write_bars(spark, root, rows(BAR, again)) == 2
    lake.write_bars(spark, root, rows(BAR, [bar(JAN31, 7.0, "ETH", "5m")]))
    out = lake.read(spark, root, "V", "BTC", "1m").orderBy("ts_event").collect()
    assert [r.close for r in out] == [60.0, 1.0, 2.0, 3.0, 4.0]
    months = {r.yyyymm for r in lake.scan(spark, root).select("yyyymm").distinct().collect()}
    assert months == {202401, 202402}
    footers = lake.footer_coverage(spark, root, "V")
    assert "PushedAggregation: [COUNT(*), MIN(ts_event), MAX(ts_event)]" in footers._jdf.queryExecution().executedPlan().toString()
    assert sorted(footers.collect()) == sorted(lake.coverage(lake.scan(spark, root)).collect())
    assert lake.footer_coverage(spark, str(tmp_path / "none")).count() == 0
    cover = {(r.symbol, r.n_rows, r.start_utc) for r in lake.catalog(lake.scan(spark, root), "V").collect()}
    assert cover == {("BTC", 5, "2024-01-31T00:00:00Z"), ("ETH", 1, "2024-01-31T00:00:00Z")}
    assert {r.symbol for r in lake.symbols(lake.scan(spark, root), "V").collect()} == {"BTC", "ETH"}
    bounded = lake.read_closes(spark, root, "V", "BTC", "1m", start_ns=JAN31 + DAY, end_ns=JAN31 + 2 * DAY)
    assert {r.close for r in bounded.collect()} == {2.0, 3.0, 4.0}
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "yyyymm" in filters[:600] and "ReadSchema: struct<ts_event:bigint,close:double>" in plan


def test_missing_lake_is_empty(spark, tmp_path):
    assert lake.read(spark, str(tmp_path / "none"), "V").count() == 0


def test_csv_skips_bad_rows(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text("ts,close\n1,100.5\nbad,1\n2,x\n3,101\n4\n")
    out = [(r.ts, r.close) for r in lake.read_csv(spark, str(path)).orderBy("ts").collect()]
    assert out == [(1, 100.5), (3, 101.0)]
    assert lake.from_rows(spark, [(1, 2)]).first().close == 2.0


def test_typed_bars_round_trip(spark, rows, tmp_path):
    df = rows("instrument string, ts_event long, close double", [("A.V", 5, 1.0), ("A.V", 4, 2.0)])
    path = str(tmp_path / "typed")
    lake.write_typed_bars(df, path)
    assert lake.read_typed_bars(spark, path).schema["ts_event"].dataType.typeName() == "long"
    assert lake.read_typed_bars(spark, path).count() == 2


def test_bar_shapes(rows):
    assert B.to_ohlcv(rows("a long, b double", [(1, 2.0)])).first() == (1, 2.0, 2.0, 2.0, 2.0, 0.0)
    five = rows("a long, b double, c double, d double, e double", [(1, 1.0, 2.0, 0.5, 1.5)])
    assert B.to_ohlcv(five).first().volume == 0.0
    with pytest.raises(ValueError):
        B.to_ohlcv(rows("a long, b double, c double", [(1, 2.0, 3.0)]))


def test_resample_drops_the_tail(rows):
    df = rows(
        "symbol string, ts_event long, open double, high double, low double, close double, volume double",
        [("X", i, float(i), i + 1.0, i - 1.0, i + 0.5, 10.0) for i in range(1, 8)],
    )
    out = B.resample(df, 3, Series.of("symbol", "ts_event")).orderBy("ts_event").collect()
    assert [tuple(r)[1:] for r in out] == [(3, 1.0, 4.0, 0.0, 3.5, 30.0), (6, 4.0, 7.0, 3.0, 6.5, 30.0)]
    with pytest.raises(ValueError):
        B.resample(df, 0, Series.of("symbol", "ts_event"))


def test_synthetic_first_open_is_its_close(spark):
    params = spark.range(1).selectExpr("'S' symbol", "5 n", "100d base", "2d amp", "40d period", "1d trend")
    out = B.synthetic_ohlcv(params).orderBy("i").collect()
    assert out[0].open == out[0].close == 100.0 and out[1].open == out[0].close


# -- messages -------------------------------------------------------------------


def frames(rows, *messages):
    data = [(m if isinstance(m, str) else json.dumps(m), 9_000_000) for m in messages]
    return rows("text string, ts_init long", data)


TRADE = {"e": "trade", "E": 5, "s": "BTCUSDT", "t": 7, "p": "100.5", "q": "0.25", "T": 6, "m": True}


def test_routing_and_rejects(rows):
    parts = normalize.split_frames(
        frames(
            rows,
            {"stream": "btcusdt@trade", "data": TRADE},
            {"stream": "btcusdt@bookTicker", "data": {"u": 1, "s": "BTCUSDT", "b": "1", "B": "2", "a": "3", "A": "4"}},
            {"stream": "btcusdt@depth@100ms", "data": {"e": "depthUpdate", "E": 5, "s": "BTCUSDT", "U": 1, "u": 2, "pu": 0, "b": [["1", "2"], ["1.5", "0"]], "a": [["3", "4"]]}},
            {"result": None, "id": 1},
            {"stream": "btcusdt@kline", "data": {}},
            "{broken",
        )
    )
    assert parts["rejects"].count() == 3
    t = normalize.trades(parts["trades"]).first()
    assert (t.symbol, t.price, t.size, t.aggressor, t.trade_id) == ("BTCUSDT", 100.5, 0.25, "SELL", "7")
    assert (t.ts_event, t.ts_init) == (6_000_000, 9_000_000)
    q = normalize.quotes(parts["quotes"]).first()
    assert (q.bid, q.bid_size, q.ask, q.ask_size, q.ts_event) == (1.0, 2.0, 3.0, 4.0, 9_000_000)
    u = normalize.depth_updates(parts["depth"])
    assert (u.first().first_id, u.first().last_id, u.first().prev_id) == (1, 2, 0)
    lv = [(r.side, r.price, r.action) for r in normalize.depth_levels(u).orderBy("ord").collect()]
    assert lv == [(1, 1.0, "Update"), (1, 1.5, "Delete"), (-1, 3.0, "Update")]


def test_incomplete_messages_are_dropped(rows):
    broken = {k: v for k, v in TRADE.items() if k != "p"}
    no_maker_flag = {k: v for k, v in TRADE.items() if k != "m"}
    out = normalize.trades(frames(rows, broken, {**TRADE, "q": "x"}, no_maker_flag)).collect()
    assert [r.aggressor for r in out] == ["BUY"]


def test_snapshot_rows(rows):
    body = json.dumps({"lastUpdateId": 10, "bids": [["1", "2"]], "asks": [["3", "4"], ["5", "6"]]})
    df = rows("symbol string, ts_event long, text string", [("X", 1, body), ("X", 2, "{}")])
    out = [(r.action, r.side, r.price, r.sequence) for r in normalize.depth_snapshots(df).orderBy("ord").collect()]
    assert out == [("Clear", 1, 0.0, 10), ("Add", 1, 1.0, 10), ("Add", -1, 3.0, 10), ("Add", -1, 5.0, 10)]


def test_kline_pages(rows):
    k = [0, "1", "3", "0.5", "2", "10", 59_999, "x", 1, "a", "b", "0"]
    out = normalize.klines(rows("symbol string, text string", [("X", json.dumps([k, k[:4]]))])).collect()
    assert [tuple(r) for r in out] == [("X", 59_999_000_000, 1.0, 3.0, 0.5, 2.0, 10.0)]


def test_exchange_info(rows):
    sym = lambda name, status="TRADING", **f: {
        "symbol": name, "status": status, "baseAsset": "B", "quoteAsset": "Q",
        "filters": [
            {"filterType": "PRICE_FILTER", "tickSize": "0.01000000"},
            {"filterType": "LOT_SIZE", "stepSize": "1.00000000"},
            *[{"filterType": k, "minNotional": v} for k, v in f.items()],
        ],
    }
    doc = {"symbols": [sym("A", NOTIONAL="5", MIN_NOTIONAL="9"), sym("B", MIN_NOTIONAL="0.0"), sym("C", "BREAK")]}
    out = {r.instrument: r for r in normalize.instruments(frames(rows, doc), "SIM").collect()}
    assert set(out) == {"A.SIM", "B.SIM"}
    assert (out["A.SIM"].price_precision, out["A.SIM"].size_precision, out["A.SIM"].min_notional) == (2, 0, 5.0)
    assert out["B.SIM"].min_notional is None


def test_execution_reports(rows):
    base = {"e": "executionReport", "c": "o1", "i": 5}
    fill = {**base, "x": "TRADE", "s": "X", "S": "SELL", "t": 3, "L": "10", "l": "2", "T": 4}
    out = normalize.execution_reports(
        frames(rows, {**base, "x": "NEW"}, fill, {**fill, "S": "?"}, {**base, "x": "REJECTED"}, {**base, "x": "REPLACED"}, {"e": "other", "x": "NEW", "c": "z"})
    ).collect()
    by = {r.event: r for r in out}
    assert sorted(by) == ["Accepted", "Filled", "Rejected"] and len(out) == 3
    f = by["Filled"]
    assert (f.side, f.last_px, f.last_qty, f.fee, f.fee_currency, f.liquidity, f.ts_event) == (-1, 10.0, 2.0, 0.0, "USDT", "taker", 4_000_000)
    assert by["Rejected"].reason == "NONE"


# -- values ---------------------------------------------------------------------


def test_identifiers_and_numbers(rows):
    df = rows("id string, x double", [("A.B.SIM", 2.5), ("BARE", float("nan")), ("C.V", -1.0)])
    out = df.select(
        V.instrument_symbol(F.col("id")).alias("s"), V.instrument_venue(F.col("id")).alias("v"),
        V.qualified_id(F.col("id"), "SIM").alias("q"), V.value_error(F.col("x"), 0).alias("e"),
    ).collect()
    assert [tuple(r) for r in out] == [
        ("A.B", "SIM", "A.B.SIM", None), (None, None, "BARE.SIM", "not_finite"), ("C", "V", "C.V", "negative"),
    ]
    half = rows("x double", [(0.5,), (1.5,), (2.5,)]).select(V.quantize(F.col("x"), 0).cast("int").alias("q"))
    assert [r.q for r in half.collect()] == [0, 2, 2]
    with pytest.raises(ValueError):
        V.interval_to_ms("7m")
    assert V.interval_to_ms("1d") == 86_400_000


def test_nanoseconds_stay_exact(rows):
    edge = 1_704_067_200 * V.NANOS
    out = rows("t long", [(edge - 1,), (edge,)]).select(
        V.bucket(F.col("t"), 3600 * V.NANOS).alias("b"), V.month_key(F.col("t")).alias("m")
    ).collect()
    assert out[1].b == out[0].b + 1 and [r.m for r in out] == [202312, 202401]


def test_text_helpers(rows):
    df = rows("a string, n long, t long", [("s1", 7, None)])
    out = df.select(
        V.padded_order_id(F.col("a"), F.col("n")).alias("id"), V.utc_text(F.col("t")).alias("t"),
        V.is_call(F.lit("P")).alias("p"), V.is_call(F.lit("Call")).alias("c"), V.is_call(F.lit("x")).alias("x"),
        V.fixed_text(F.lit(1.5), 4).alias("f"),
    ).first()
    assert out.id == "s1-" + "7".rjust(20, "0") and out.t == "-" and out.f == "1.5000"
    assert (out.p, out.c, out.x) == (False, True, None)


def test_instrument_rules(rows):
    schema = "instrument string, asset_class string, expiry_ns long, strike double, right string, underlying string"
    df = rows(schema, [("a", "spot", None, None, None, None), ("b", "future", None, None, None, None), ("c", "option", 1, 2.0, "call", None), ("d", "bond", None, None, None, None)])
    got = {r.instrument: r.violations for r in I.violations(df).collect()}
    assert got == {"a": [], "b": ["future_without_expiry"], "c": ["option_without_underlying"], "d": ["unknown_class"]}
