"""Split series give the results of whole series, whatever the block size."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.operators import asof as asof_module
from tidebook.operators.asof import asof, asof_mark, mark_events
from tidebook.operators.fold import Fold, fold_rows
from tidebook.operators.indicators import atr, ema, macd, on_finite, rsi, runs, sma, smas
from tidebook.operators.series import Series, measure_cuts

SCHEMA = "symbol string, ts long, seq long, close double"


@pytest.fixture(scope="module")
def ticks(spark):
    """One symbol holds most rows; times come in bursts and ties."""
    rnd = random.Random(7)
    data, ts = [], 0
    for i in range(1000):
        ts += rnd.choice([0, 0, 1, 1, 50, 4000])
        symbol = "HOT" if rnd.random() < 0.7 else rnd.choice(["A", "B"])
        data.append((symbol, ts, i, round(50 + 10 * math.sin(i / 20) + rnd.random(), 2)))
    return spark.createDataFrame(data, SCHEMA).repartition(5).cache()


def _series(df, rows_per_block):
    cuts = measure_cuts(df, ("symbol",), "ts", rows_per_block=rows_per_block)
    return Series.of("symbol", ("ts", "seq"), cuts)


def _same(a, b, places=9):
    pa, pb = (x.toPandas().sort_values(["symbol", "ts", "seq"]).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(pa[sorted(pa)], pb[sorted(pb)], rtol=0, atol=10**-places)


def test_short_keys_are_not_cut(ticks):
    assert not measure_cuts(ticks, ("symbol",), "ts", rows_per_block=10_000)


def test_ten_thousand_blocks(spark):
    df = spark.range(30_000).selectExpr("'HOT' AS symbol", "id AS ts", "id AS seq", "cast(id % 7 AS double) AS close")
    cuts = measure_cuts(df, ("symbol",), "ts", rows_per_block=3)
    assert sum(len(points) for *_, points in cuts.table) > 9_000
    aggs = {"s": ("sum", F.col("close"))}
    whole, split = Series.of("symbol", ("ts", "seq")), Series.of("symbol", ("ts", "seq"), cuts)
    _same(whole.running(df, aggs), split.running(df, aggs))


def test_one_crowded_timestamp_is_cut_along_the_tie(spark):
    data = [("HOT", 500 if i % 3 else i, i, float(i % 13)) for i in range(900)]
    df = spark.createDataFrame([*data, ("A", 1, 901, 1.0)], SCHEMA).repartition(4)
    cuts = measure_cuts(df, ("symbol",), "ts", rows_per_block=50, tie="seq")
    assert len(cuts.ties) == 1 and cuts.ties[0][:2] == ("HOT", 500)
    s = Series.of("symbol", ("ts", "seq"), cuts)
    sizes = s._with_block(df).groupBy("symbol", "_s_blk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 120
    aggs = {"s": ("sum", F.col("close")), "n": ("count", F.col("close"))}
    whole = Series.of("symbol", ("ts", "seq"))
    for kw in ({}, {"reverse": True}):
        _same(whole.running(df, aggs, **kw), s.running(df, aggs, **kw))


@pytest.mark.parametrize("size", [40, 400])
def test_running_aggregates(ticks, size):
    aggs = {
        "s": ("sum", F.col("close")),
        "n": ("count", F.col("close")),
        "hi": ("max", F.col("close")),
        "lo": ("min", F.col("close")),
        "last": ("last", F.when(F.col("seq") % 3 == 0, F.col("close"))),
    }
    whole, split = Series.of("symbol", ("ts", "seq")), _series(ticks, size)
    assert split.is_split and not whole.is_split
    for kw in ({}, {"include_current": False}, {"reverse": True}):
        _same(whole.running(ticks, aggs, **kw), split.running(ticks, aggs, **kw))


@pytest.mark.parametrize("size", [40])
def test_bounded_frames(ticks, size):
    def build(w):
        return {
            "lag3": F.lag("close", 3).over(w),
            "lead2": F.lead("close", 2).over(w),
            "avg7": F.avg("close").over(w.rowsBetween(-6, 0)),
        }

    whole, split = Series.of("symbol", ("ts", "seq")), _series(ticks, size)
    _same(
        whole.frames(ticks, build, before=6, after=2), split.frames(ticks, build, before=6, after=2)
    )


@pytest.mark.parametrize("size", [200])
def test_indicators(ticks, size):
    whole, split = Series.of("symbol", ("ts", "seq")), _series(ticks, size)
    bars = ticks.withColumn("high", F.col("close") + 1).withColumn("low", F.col("close") - 1)
    for fn in (
        lambda s: sma(bars, s, 5),
        lambda s: ema(bars, s, 9),
        lambda s: rsi(bars, s, 14),
        lambda s: atr(bars, s, 14),
        lambda s: macd(bars, s),
        lambda s: runs(bars.withColumn("k", F.floor(F.col("close") / 5)), s, ["k"]).drop("k"),
    ):
        _same(fn(whole), fn(split))


def test_known_indicator_values(rows):
    vals = [2.0, 4.0, 4.0, 4.0, 5.0, 5.0, 7.0, 9.0]
    df = rows(SCHEMA, [("X", i, i, v) for i, v in enumerate(vals)])
    s = Series.of("symbol", ("ts", "seq"))
    from tidebook.operators.indicators import bollinger, vwap

    last = bollinger(df, s, 8, 2.0).orderBy("ts").collect()[-1]
    assert (last.bb_lower, last.bb_mid, last.bb_upper) == (1.0, 5.0, 9.0)
    up = rows(SCHEMA, [("X", i, i, float(i)) for i in range(1, 21)])
    assert rsi(up, s, 14).orderBy("ts").collect()[-1].rsi == 100.0
    got = [r.ema for r in ema(df, s, 3).orderBy("ts").collect()]
    assert got[:3] == [None, None, 3.5]
    flat = df.withColumn("volume", F.lit(0.0))
    assert vwap(flat, s, 3).where("vwap is not null").count() == 0


@pytest.mark.parametrize("bad", [0, -3])
def test_period_is_checked(rows, bad):
    df = rows(SCHEMA, [("X", 0, 0, 1.0)])
    for fn in (sma, ema, rsi, atr):
        with pytest.raises(ValueError):
            fn(df, Series.of("symbol", ("ts", "seq")), bad)


def test_poison_ticks_change_nothing(rows):
    s = Series.of("symbol", ("ts", "seq"))
    clean = [("X", i, i, float(i % 7)) for i in range(1, 21)]
    poison = [("X", 5, 100, float("nan")), ("X", 9, 101, float("inf")), ("X", 12, 102, None)]
    run = lambda d: on_finite(
        rows(SCHEMA, d), s, ["close"], ["ema"], lambda x: ema(x, s, 4)
    )
    want = {r.seq: r.ema for r in run(clean).collect()}
    got = {r.seq: r.ema for r in run(clean + poison).collect()}
    assert {k: v for k, v in got.items() if k < 100} == want
    assert got[100] == want[5] and got[101] == want[9]


def test_asof_against_brute_force(spark, ticks):
    rnd = random.Random(3)
    probes = [(rnd.choice(["HOT", "A", "Z"]), rnd.randrange(0, 900_000), i) for i in range(300)]
    left = spark.createDataFrame(probes, "symbol string, t long, id long")
    points = [(r.symbol, r.ts, r.seq, r.close) for r in ticks.collect()]

    def brute(direction):
        out = {}
        for sym, t, i in probes:
            back = max(((p[1], p[2], p[3]) for p in points if p[0] == sym and p[1] <= t), default=None)
            fwd = min(((p[1], p[2], p[3]) for p in points if p[0] == sym and p[1] > t), default=None)
            if direction == "backward":
                hit = back
            elif direction == "forward":
                hit = fwd
            elif back is None or (fwd is not None and fwd[0] - t < t - back[0]):
                hit = fwd or back
            else:
                hit = back
            out[i] = hit and hit[2]
        return out

    for rows_per_block in (10_000, 60):
        cuts = measure_cuts(ticks, ("symbol",), "ts", rows_per_block=rows_per_block)
        for direction in ("backward", "forward", "nearest"):
            df = asof(
                left, ticks, "symbol", left_at="t", right_at="ts", values={"v": "close"},
                direction=direction, right_tie="seq", cuts=cuts,
            )
            assert {r.id: r.v for r in df.collect()} == brute(direction)
    with pytest.raises(ValueError):
        asof(left, ticks, "symbol", left_at="t", right_at="ts", values={}, direction="sideways")


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_splits_a_crowded_timestamp(spark, direction):
    """Half of the rows of both sides at one time: cut inside it, with the result of one pass."""
    rnd = random.Random(5)
    right = spark.createDataFrame([("H", 500 if i % 2 else rnd.randrange(1000), i, float(i)) for i in range(600)], "symbol string, ts long, seq long, v double")
    left = spark.createDataFrame([("H", 500 if i % 2 else rnd.randrange(1000), i) for i in range(600)], "symbol string, t long, id long")
    cuts = measure_cuts(right, ["symbol"], "ts", 40, tie="seq")
    assert cuts.ties
    run = lambda c: asof(left, right, "symbol", left_at="t", right_at="ts", values={"v": "v"}, direction=direction, right_tie="seq", cuts=c)
    assert sorted(run(cuts).collect()) == sorted(run(None).collect())
    series = Series.of("symbol", ("_at", "_tie"), asof_module._tie_cuts(cuts))
    tagged = asof_module._tagged(left, right, ["symbol"], "t", "ts", ["v"], "seq", True)
    sizes = [r["count"] for r in series._with_block(tagged).where("_at = 500").groupBy("_s_blk").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 150  # 600 rows stand there


def test_marks_come_from_the_last_event_of_any_kind(spark):
    trades = spark.createDataFrame([("X", 10, 1, 100.0), ("X", 20, 5, 101.0), ("X", 20, 6, 102.0)], "symbol string, ts long, seq long, price double")
    quotes = spark.createDataFrame([("X", 10, 2, 90.0, 92.0), ("X", 30, 7, 94.0, 96.0)], "symbol string, ts long, seq long, bid double, ask double")
    bars = spark.createDataFrame([("X", 20, 103.0), ("Y", 5, 1.0)], "symbol string, ts_event long, close double")
    left = spark.createDataFrame([("X", t) for t in (9, 10, 19, 20, 29, 30)] + [("Z", 50)], "symbol string, at long")
    got = {(r.symbol, r["at"]): r.mark for r in asof_mark(left, mark_events(trades, quotes, bars), left_at="at").collect()}
    assert got == {("X", 9): None, ("X", 10): 100.0, ("X", 19): 100.0, ("X", 20): 103.0, ("X", 29): 103.0, ("X", 30): 95.0, ("Z", 50): None}
    only = asof_mark(left, mark_events(quotes=quotes), left_at="at").where("at = 20").first()
    assert only.mark == 91.0


def test_fold_splits_only_at_restarts(ticks):
    """A sum that restarts on marked rows, whole and split."""

    def apply(state, row):
        close, mark = row
        state[0] = close if mark else state[0] + close
        return (state[0],)

    fold = Fold(
        lambda: [0.0], apply, ("close", "mark"), (T.StructField("acc", T.DoubleType()),)
    )
    marked = ticks.withColumn("mark", F.col("seq") % 97 == 0)
    whole = fold_rows(marked, Series.of("symbol", ("ts", "seq")), fold, restart="mark")
    split = fold_rows(marked, _series(ticks, 50), fold, restart="mark")
    _same(whole, split, places=6)


def test_partition_count_does_not_matter(spark, ticks):
    s = _series(ticks, 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = smas(ticks, s, {"a": 4, "b": 9}).toPandas()
            results.append(out.sort_values("seq").reset_index(drop=True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    pd.testing.assert_frame_equal(*results)


def test_rows_of_a_key_with_many_cuts_do_not_carry_them(rows):
    data = [("a", i // 3 if i < 900 else 500, i) for i in range(1800)] + [("b", 1, 1), (None, 2, 2), ("a", None, 3)]
    df = rows("k string, ts long, seq long", data)
    cuts = measure_cuts(df.where("ts is not null"), ("k",), "ts", rows_per_block=5, tie="seq")
    s = Series.of("k", ("ts", "seq"), cuts)
    blocked = s._with_block(df)
    assert "array" not in blocked._jdf.queryExecution().optimizedPlan().toString().lower()
    points, ties = list(cuts.table[0][-1]), {t[1]: list(t[-1]) for t in cuts.ties}
    assert len(points) > 64 and max(map(len, ties.values())) > 64
    for r in blocked.collect():
        want = -1
        if r.k == "a":
            at = -(1 << 63) if r.ts is None else r.ts
            want = sum(p <= at for p in points) * (1 << 32) + sum(p <= r.seq for p in ties.get(r.ts, []))
        assert r._s_blk == want
