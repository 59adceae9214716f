"""Average-cost positions folded from fills, in integer price and size units."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.brokerage import notional, pnl_per_unit
from tidebook.functions.values import int_div
from tidebook.operators.fold import Fold, fold_groups, fold_rows, reduce_groups
from tidebook.operators.series import RN, Series
from tidebook.session import staged

#: How far from the expected average a block's table of averages reaches, on both sides.
NEAR = 64


def half_even(num: int, den: int) -> int:
    """Integer division rounded half to even."""
    q, r = divmod(num, den)
    twice = 2 * r
    return q + 1 if twice > den or (twice == den and q % 2) else q


class AverageCost:
    """State of one position: signed size and average entry."""

    __slots__ = ("net", "avg")

    def __init__(self):
        self.net, self.avg = 0, 0

    def fill(self, signed: int, px: int, unit) -> int:
        """Apply a fill and return the realized PnL; ``unit`` values a closed long."""
        net, gain = self.net, 0
        after = net + signed
        if net == 0:
            avg = px
        elif (net > 0) == (signed > 0):
            avg = half_even(self.avg * abs(net) + px * abs(signed), abs(after))
        else:
            closed = min(abs(net), abs(signed))
            gain = unit(self.avg, px, closed) * (1 if net > 0 else -1)
            avg = px if abs(signed) > abs(net) else self.avg
        self.net, self.avg = after, (avg if after else 0)
        return gain


class _Entered:
    """The average of a position that enters a block; None before its first fill."""

    __slots__ = ("avg",)

    def __init__(self):
        self.avg = None


def _linear(mult: int):
    return lambda entry, exit_, qty: (exit_ - entry) * qty * mult if entry else 0


def _inverse(mult: int, money_scale: int, px_scale: int):
    def unit(entry: int, exit_: int, qty: int) -> int:
        if not entry:
            return 0
        per = Decimal(px_scale) * (1 / Decimal(entry) - 1 / Decimal(exit_))
        value = per * qty * mult * Decimal(10) ** money_scale
        return int(value.quantize(Decimal(1), rounding=ROUND_HALF_EVEN))

    return unit


def average_cost(
    fills: DataFrame,
    series: Series,
    *,
    price_decimals: int = 2,
    money_decimals: int = 8,
) -> DataFrame:
    """Position after every fill.

    Input: keys, order columns, ``side`` (+1/-1), ``qty_raw`` and ``px_raw``
    (whole units), ``fee_raw`` (already in settlement units, 0 when the fee is
    in another currency); optional ``multiplier`` and ``is_inverse``.  Linear
    amounts are in price units, inverse amounts in ``10**-money_decimals``.
    """
    df = fills
    if "multiplier" not in df.columns:
        df = df.withColumn("multiplier", F.lit(1).cast("long"))
    if "is_inverse" not in df.columns:
        df = df.withColumn("is_inverse", F.lit(False))
    long = T.LongType()

    def apply(book: AverageCost, row: tuple) -> tuple:
        side, qty, px, fee, mult, inv = row
        unit = _inverse(mult, money_decimals, 10**price_decimals) if inv else _linear(mult)
        gain = book.fill(side * qty, px, unit) - fee
        return book.net, book.avg, gain

    fold = Fold(
        AverageCost,
        apply,
        ("side", "qty_raw", "px_raw", "fee_raw", "multiplier", "is_inverse"),
        tuple(T.StructField(n, long) for n in ("net_raw", "avg_raw", "realized_step")),
    )
    if series.is_split:
        return _in_blocks(df, series, fold, lambda mult: _inverse(mult, money_decimals, 10**price_decimals))
    steps = fold_rows(df, series, fold)
    return series.running(steps, {"realized_raw": ("sum", F.col("realized_step"))})


class _Drift:
    """The average after a block as ``a * (average before it) + b``, without rounding."""

    def __init__(self):
        self.a, self.b = 1.0, 0.0

    def take(self, net, signed, px):
        a, b = self.a, self.b
        for n, s, p in zip(net.tolist(), signed.tolist(), px.tolist()):
            if n == 0 or (n > 0) != (s > 0) and abs(s) > abs(n):
                a, b = 0.0, float(p)
            elif (n > 0) == (s > 0) and s:
                share = abs(n) / abs(n + s)
                a, b = a * share, b * share + p * (1.0 - share)
        self.a, self.b = a, b

    def result(self):
        return self.a, self.b


class _Averages:
    """The rounded average after a block for every average before it that is near the expected one.

    A fill moves two neighbours to the same average or to neighbours, so what is
    left of them is always a range: its ends tell whether any have met.
    """

    def __init__(self):
        self.low, self.fixed = None, False

    def take(self, net, signed, px, expected):
        if self.low is None:
            self.low = self.lo = round(float(expected[0])) - NEAR
            self.hi, self.of = self.lo + 2 * NEAR, np.arange(2 * NEAR + 1)
        lo, hi = self.lo, self.hi
        for n, s, p in zip(net.tolist(), signed.tolist(), px.tolist()):
            if n == 0 or (n > 0) != (s > 0) and abs(s) > abs(n):
                lo = hi = p
                self.fixed = True
            elif (n > 0) == (s > 0) and s:
                size, more = abs(n), abs(s)
                first = half_even(lo * size + p * more, size + more)
                last = half_even(hi * size + p * more, size + more) if hi > lo else first
                if last - first < hi - lo:
                    met = [half_even(v * size + p * more, size + more) - first for v in range(lo, hi + 1)]
                    self.of = np.array(met)[self.of]
                lo, hi = first, last
        self.lo, self.hi = lo, hi

    def result(self):
        return self.low, self.fixed, [self.lo] if self.fixed else [self.lo + i for i in self.of.tolist()]


def _chained(blocks: DataFrame, keys: list[str], start: Column, step, kind: str) -> DataFrame:
    """(keys, block, entry): the value that enters each block, where ``step(value, row)`` leaves it.

    One row for each block of a key is gathered, a few of millions of fills.
    """
    rest = [c for c in blocks.columns if c not in keys]
    rows = F.array_sort(F.collect_list(F.struct(*rest)))

    def add(state: Column, row: Column) -> Column:
        entries = F.concat(state["entries"], F.array(F.struct(row["_block"].alias("_block"), state["value"].alias("entry"))))
        return F.struct(step(state["value"], row).cast(kind).alias("value"), entries.alias("entries"))

    none = F.struct(start.cast(kind).alias("value"), F.array().cast(f"array<struct<_block: bigint, entry: {kind}>>").alias("entries"))
    entries = F.aggregate("_rows", none, add, lambda state: state["entries"])
    return blocks.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")


def _averages(state: _Entered, net: list[int], signed: list[int], px: list[int]) -> tuple[list[int], list[int]]:
    """The averages before and after each fill of a position whose size is known."""
    avg, before, after = state.avg, [], []
    for n, s, p in zip(net, signed, px):
        before.append(avg)
        if n == 0:
            avg = p
        elif (n > 0) == (s > 0):
            avg = half_even(avg * abs(n) + p * abs(s), abs(n + s))
        elif abs(s) > abs(n):
            avg = p
        if n + s == 0:
            avg = 0
        after.append(avg)
    state.avg = avg
    return before, after


def _entered_run(inverse):
    """Fills of a block in order; as ``AverageCost.fill``, with the gains of all of them at once."""

    def run(state: _Entered, side, qty, px, fee, mult, inv, net, entry) -> tuple:
        if state.avg is None:
            state.avg = int(entry[0])
        signed = side * qty
        before, after = _averages(state, net.tolist(), signed.tolist(), px.tolist())
        closing = np.flatnonzero((net != 0) & ((net > 0) != (signed > 0)))
        gain = np.zeros(len(net), dtype=object if len(closing) and _is_large(px, qty, mult) else np.int64)
        entries = np.array(before, dtype=gain.dtype)[closing]
        closed = np.minimum(np.abs(net), np.abs(signed))[closing]
        sign = np.where(net[closing] > 0, 1, -1)
        gain[closing] = np.where(entries != 0, (px[closing] - entries) * closed * mult[closing], 0) * sign
        for i in closing[inv[closing].astype(bool)].tolist():
            gain[i] = inverse(int(mult[i]))(before[i], int(px[i]), int(min(abs(net[i]), abs(signed[i])))) * (1 if net[i] > 0 else -1)
        return net + signed, np.array(after, dtype=object), gain - fee

    return run


def _is_large(px, qty, mult) -> bool:
    """Whether a gain might not fit into 64 bits; it is then worked out in whole numbers of any size."""
    return 2.0 * float(np.abs(px).max()) * float(np.abs(qty).max()) * float(np.abs(mult).max()) >= 2.0**61


def _in_blocks(df: DataFrame, series: Series, fold: Fold, inverse) -> DataFrame:
    """The fold with every long key cut into blocks, also where the position is never flat.

    What enters a block is its size, a prefix sum, and its average, which is
    rounded after each fill.  Without rounding a block maps averages affinely, so
    composing the blocks tells the average expected at each, and rounding moves
    it by little.  Each block then works out what it makes of every average near
    the expected one, and composing these tables gives the exact one: the block
    is folded from there.  Should an average ever leave its table, the key is
    folded as a whole.
    """
    keys, by = list(series.keys), list(series.by)
    signed = F.col("side") * F.col("qty_raw")
    before = {"_net": ("sum", F.col("_signed")), RN: ("count", F.lit(1))}
    rows = series.running(df.withColumn("_signed", signed.cast("long")), before, include_current=False)
    rows = rows.withColumn("_net", F.coalesce("_net", F.lit(0)).cast("long"))
    rows = rows.withColumn("_block", int_div(F.col(RN), series.rows_per_block)).drop(RN)
    rows = staged(rows)
    group, double = [*keys, "_block"], T.DoubleType()
    drift = reduce_groups(rows, group, by, _Drift, ("_net", "_signed", "px_raw"), (T.StructField("a", double), T.StructField("b", double)))
    expected = _chained(drift, keys, F.lit(0.0), lambda v, r: v * r["a"] + r["b"], "double").withColumnRenamed("entry", "_expected")
    tables = reduce_groups(
        rows.join(expected, group), group, by, _Averages, ("_net", "_signed", "px_raw", "_expected"),
        (T.StructField("low", T.LongType()), T.StructField("fixed", T.BooleanType()), T.StructField("after", T.ArrayType(T.LongType()))),
    )
    # a block in which the position starts anew has one average after it, whatever entered
    inside = lambda v, r: (v >= r["low"]) & (v <= r["low"] + 2 * NEAR)
    after = lambda v, r: F.when(r["fixed"], r["after"][0]).when(inside(v, r), F.get(r["after"], (v - r["low"]).cast("int")))
    entries = _chained(tables, keys, F.lit(0), after, "bigint")
    entries = entries.withColumn("_lost", F.max(F.col("entry").isNull()).over(Window.partitionBy(*keys)))
    rows = rows.join(entries, group)

    whole = rows.where("_lost").withColumns({"_block": F.lit(-1).cast("long"), "entry": F.lit(0).cast("long")})
    entered = Fold(_Entered, fold.apply, (*fold.inputs, "_net", "entry"), fold.outputs, _entered_run(inverse))
    steps = staged(fold_groups(rows.where("not _lost").unionByName(whole), group, by, entered, keep=[*group, *by]))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    gains = steps.groupBy(*group).agg(F.sum("realized_step").alias("_gain"))
    gains = gains.select(*group, F.coalesce(F.sum("_gain").over(earlier), F.lit(0)).alias("_gain"))
    upto = F.sum("realized_step").over(Window.partitionBy(*group).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("realized_raw", upto).join(gains, group).withColumn("realized_raw", F.col("realized_raw") + F.col("_gain")).drop("_gain", "_block")


def latest(positions: DataFrame, series: Series) -> DataFrame:
    """Last row of each series."""
    order = F.struct(*series.by)
    rest = [c for c in positions.columns if c not in series.keys]
    return positions.groupBy(*series.keys).agg(
        *[F.max_by(c, order).alias(c) for c in rest]
    )


def unrealized(df: DataFrame) -> DataFrame:
    """Add unrealized PnL and notional at ``mark``.

    Needs ``net``, ``avg_px``, ``mark``, ``multiplier``, ``is_inverse``.
    """
    inv, mult = F.col("is_inverse"), F.col("multiplier").cast("double")
    per = pnl_per_unit(inv, F.col("avg_px"), F.col("mark"), mult)
    size = F.abs("net")
    return df.withColumns(
        {
            "unrealized": F.when(F.col("net") == 0, F.lit(0.0)).otherwise(F.col("net") * per),
            "notional": notional(F.col("mark"), size, mult, inv),
        }
    )


def funding_payment(df: DataFrame) -> DataFrame:
    """Add ``payment``: longs pay on a positive rate, on the signed notional."""
    value = notional(
        F.col("mark"), F.col("net"), F.col("multiplier").cast("double"), F.col("is_inverse")
    )
    return df.withColumn(
        "payment",
        F.when(F.col("net") == 0, F.lit(0.0)).otherwise(-(value * F.col("rate"))),
    )
