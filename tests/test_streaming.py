"""Streams over several micro-batches end where the batch operators end."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidebook.operators.bars import time_bars
from tidebook.operators.book import book_series
from tidebook.operators.indicators import ema
from tidebook.operators.orders import order_steps
from tidebook.operators.positions import average_cost
from tidebook.operators.series import Series
from tidebook.sources import lake
from tidebook.streaming import jobs
from tidebook.streaming import sources as SS

S = 1_000_000_000
TICK = "symbol string, ts long, seq long, price double, size double"


@pytest.fixture
def landed(spark, tmp_path):
    """Write rows as several files and stream them one file per trigger."""

    def land(schema, data, parts=3, name="in"):
        df = spark.createDataFrame(data, schema)
        path = str(tmp_path / name)
        step = -(-len(data) // parts)
        for i in range(parts):
            chunk = data[i * step : (i + 1) * step]
            spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)
        return df, SS.file_stream(spark, path, df.schema, max_files=1)

    return land


def bag(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def ticks(n=240):
    rnd = random.Random(1)
    return [(rnd.choice("AB"), (1000 + i * 20) * S, i, round(rnd.uniform(90, 110), 2), 1.0) for i in range(n)]


def test_bars_are_final_behind_the_watermark(landed):
    data = ticks()
    df, stream = landed(TICK, data)
    out = SS.run_available_now(jobs.bars(stream, "1 minute", "2 minutes"))
    done = max(t[1] for t in data) - 120 * S
    want = time_bars(df, 60 * S).where(F.col("ts_event") <= done)
    cols = ("symbol", "ts_event", "open", "high", "low", "close", "volume")
    assert bag(out, *cols) == bag(want, *cols)


def test_late_ticks_are_dropped(landed):
    data = ticks(90)
    late = ("A", 0, 10_000, 500.0, 1.0)
    _, stream = landed(TICK, [*data, late, late, late], parts=3)
    out = SS.run_available_now(jobs.bars(stream, "1 minute", "1 minute"))
    assert out.where("high = 500").count() == 0


def test_indicator_warm_start(spark, landed):
    data = ticks()
    cut = 100
    df, stream = landed(TICK, data[cut:])
    history = spark.createDataFrame(data[:cut], TICK)
    out = SS.run_available_now(jobs.ema(stream, 5, history))
    want = ema(history.unionByName(df), Series.of("symbol", ("ts", "seq")), 5, col="price")
    a = {r.seq: r.ema for r in out.collect()}
    b = {r.seq: r.ema for r in want.where(F.col("seq") >= cut).collect()}
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_positions_and_orders(landed):
    rnd = random.Random(4)
    schema = "symbol long, ts long, seq long, side long, qty_raw long, px_raw long, fee_raw long"
    data = [(rnd.randint(1, 3), i, i, rnd.choice([1, -1]), rnd.randint(1, 4), rnd.randint(90, 110), 1) for i in range(200)]
    df, stream = landed(schema, data)
    cols = ("symbol", "seq", "net_raw", "avg_raw", "realized_raw")
    want = average_cost(df, Series.of("symbol", ("ts", "seq")))
    assert bag(SS.run_available_now(jobs.positions(stream)), *cols) == bag(want, *cols)

    schema = "client_order_id long, seq long, event string, order_qty double, last_qty double, last_px double"
    names = ["Initialized", "Submitted", "Accepted", "Filled", "Accepted", "Canceled"]
    data = [(i % 7, n, e, 5.0, 2.0, 10.0) for n, e in enumerate(names) for i in range(7)]
    df, stream = landed(schema, data, name="orders")
    cols = ("client_order_id", "seq", "accepted", "status", "filled_qty")
    want = order_steps(df, Series.of("client_order_id", "seq"))
    assert bag(SS.run_available_now(jobs.orders(stream)), *cols) == bag(want, *cols)


def test_books(landed):
    rnd = random.Random(9)
    schema = "symbol string, ts long, seq long, side int, price double, size double, sequence long, action string"
    data = [("X", i, i, rnd.choice([1, -1]), float(rnd.randint(90, 95)), float(rnd.randint(0, 2)), i, "Clear" if i % 50 == 49 else "Update") for i in range(150)]
    df, stream = landed(schema, data)
    cols = ("symbol", "seq", "applied", "bid", "bid_size", "ask", "ask_size", "levels")
    want = book_series(df, Series.of("symbol", ("ts", "seq")))
    assert bag(SS.run_available_now(jobs.books(stream)), *cols) == bag(want, *cols)


def test_resync_buffers_until_the_snapshot(landed):
    schema = "symbol string, arrival long, kind string, first_id long, last_id long, prev_id long"
    data = [
        ("X", 0, "diff", 90, 99, None), ("X", 1, "diff", 99, 105, None),
        ("X", 2, "snapshot", None, 100, None), ("X", 3, "diff", 106, 110, 105),
        ("X", 4, "diff", 120, 125, 119), ("X", 5, "diff", 126, 130, 125), ("X", 6, "snapshot", None, 119, None),
    ]
    _, stream = landed(schema, data, parts=4)
    out = SS.run_available_now(jobs.depth_resync(stream))
    got = {}
    for r in out.orderBy("batch").collect():
        got.setdefault(r.arrival, []).append(r.outcome)
    assert got == {
        0: ["buffered", "skipped"], 1: ["buffered", "applied"], 2: ["snapshot"], 3: ["applied"],
        4: ["resync", "applied"], 5: ["buffered", "applied"], 6: ["snapshot"],
    }


def test_monitor_trips_once_across_batches(landed):
    schema = "account long, ts long, seq long, equity double, gross_exposure double, net_exposure double"
    data = [(1, i, i, *v, None) for i, v in enumerate([(100.0, None), (None, 200.0), (85.0, None), (70.0, None), (None, 5000.0), (10.0, None)])]
    _, stream = landed(schema, data)
    out = SS.run_available_now(jobs.account_monitor(stream, 0.25, 1000.0, 1e9, 1e9)).collect()
    assert [(r.ts, r.limits) for r in out] == [(3, "max_drawdown")]


def test_lake_sink_replays_safely(spark, landed, tmp_path):
    schema = "venue string, symbol string, interval string, ts_event long, open double, high double, low double, close double, volume double"
    data = [("V", "X", "1m", i % 4 * S, *[float(i)] * 5) for i in range(8)]
    _, stream = landed(schema, data, parts=2)
    root = str(tmp_path / "lake")
    sink = SS.lake_sink(root)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    again = spark.createDataFrame(data[4:], schema)
    sink(again, 1)
    out = lake.read(spark, root, "V", "X", "1m").orderBy("ts_event").collect()
    assert [r.close for r in out] == [4.0, 5.0, 6.0, 7.0]


def test_frames_fan_out_and_counters(spark, tmp_path):
    trade = {"stream": "x@trade", "data": {"s": "X", "t": 1, "p": "1", "q": "2", "T": 3}}
    src = tmp_path / "frames"
    src.mkdir()
    lines = [json.dumps({"text": json.dumps(trade), "ts_init": 1}), json.dumps({"text": "{broken", "ts_init": 1})]
    (src / "a.json").write_text("\n".join(lines))
    frames = SS.frame_stream(spark, str(src))
    assert SS.run_available_now(SS.market_streams(frames)["trades"]).first().price == 1.0
    root = str(tmp_path / "routes")
    routes = {"ok": F.col("text").contains("stream"), "bad": ~F.col("text").contains("stream")}
    counted = jobs.quality_counters(SS.frame_stream(spark, str(src)))
    query = counted.writeStream.foreachBatch(SS.fan_out(routes, root)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(f"{root}/ok").count() == spark.read.parquet(f"{root}/bad").count() == 1
    seen = [p.observedMetrics["frames"] for p in query.recentProgress if "frames" in p.observedMetrics]
    assert any((m["rows"], m["malformed"]) == (2, 1) for m in seen)


def test_malformed_telemetry_is_set_aside(rows):
    good = json.dumps({"account": 1, "ts": 5, "equity": 2.0})
    ok, bad = jobs.parse_telemetry(rows("text string", [(good,), ("{",), ("{}",)]))
    assert ok.first().equity == 2.0 and bad.count() == 2


def test_latest_dedupe_and_kill_switch(landed):
    df, stream = landed(TICK, ticks(60))
    out = SS.run_available_now(jobs.latest(stream, ["symbol"], ["price"]), mode="update")
    newest = {r.symbol: r.price for r in out.orderBy("batch").collect()}
    want = {r.symbol: r.p for r in df.groupBy("symbol").agg(F.max_by("price", "seq").alias("p")).collect()}
    assert newest == want
    _, again = landed(TICK, [*ticks(20), *ticks(20)], name="dup")
    named = again.withColumn("trade_id", F.col("seq"))
    assert SS.run_available_now(jobs.distinct_fills(named, "trade_id", "1 hour")).count() == 20
    _, control = landed("account long, ts long, kind string, engaged boolean", [(1, 5, "kill_switch", False), (1, 7, "kill_switch", True), (1, 6, "pause", True), (1, 9, "kill_switch", True)], name="ctl")
    last = SS.run_available_now(jobs.kill_switch(control), mode="update").orderBy(F.col("batch").desc()).first()
    assert last.engaged_at == 7


def test_batches_of_few_symbols_are_bounded(spark, monkeypatch):
    """A longer table of events comes in more micro-batches, not in longer ones."""
    from tidebook.plans import stream_queries as Q

    monkeypatch.setattr(Q, "ROWS_PER_LANDING", {"event_id": 200}, raising=False)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id")
    out = Q.run_available_now(Q._landed(spark, events, "event_id"))
    counts = [r["count"] for r in out.groupBy("batch").count().collect()]
    assert sum(counts) == events.count() == 1000 and max(counts) < 250


def test_neighbouring_orders_share_a_state(landed):
    """Their events come in several batches; nulls and NaN stay apart."""
    schema = "client_order_id long, seq long, event string, order_qty double, last_qty double, last_px double"
    names = ["Initialized", "Submitted", "Accepted", "PartiallyFilled", "Accepted", "Filled", "Initialized"]
    size = {-3: None, 5: float("nan")}
    data = [(i, n, e, size.get(i, 5.0), 2.5, 10.0) for n, e in enumerate(names) for i in (-3, -1, 0, 1, 5, 700, 5000)]
    assert jobs.ORDERS_PER_STATE > 5
    df, stream = landed(schema, data, parts=4)
    cols = ("client_order_id", "seq", "event", "accepted", "status", "filled_qty", "leaves_qty")
    want = order_steps(df, Series.of("client_order_id", "seq"))
    own = [c for c in cols if c in want.columns]
    got = SS.run_available_now(jobs.orders(stream))
    assert list(map(repr, bag(got, *own))) == list(map(repr, bag(want, *own)))


def test_finished_orders_of_a_group_are_forgotten_alone():
    """A timer of a group drops the orders that were finished long enough ago."""
    from types import SimpleNamespace

    from tidebook.streaming.processors import Orders

    held = {"now": None}
    state = SimpleNamespace(get=lambda: held["now"], update=lambda v: held.update(now=v), clear=lambda: held.update(now=None))
    orders = Orders(keep_ms=100)
    orders.state = state
    state.update(([1, 2, 3], ["Filled", "Accepted", "Filled"], [1.0] * 3, [1.0] * 3, [1.0] * 3, [0] * 3, [1000, None, 1050]))
    list(orders.handleExpiredTimer((0,), None, SimpleNamespace(getExpiryTimeInMs=lambda: 1100)))
    assert state.get()[0] == [2, 3]


def test_positions_that_share_a_state(landed):
    rnd = random.Random(6)
    schema = "symbol long, ts long, seq long, side long, qty_raw long, px_raw long, fee_raw long"
    data = [(rnd.randint(-2, 6), i, i, rnd.choice([1, -1]), rnd.randint(1, 4), rnd.randint(90, 110), 1) for i in range(200)]
    df, stream = landed(schema, data)
    cols = ("symbol", "seq", "net_raw", "avg_raw", "realized_raw")
    want = average_cost(df, Series.of("symbol", ("ts", "seq")))
    assert bag(SS.run_available_now(jobs.positions(stream, symbols_per_state=4)), *cols) == bag(want, *cols)
