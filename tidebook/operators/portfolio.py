"""Account-level views: conversion, exposure, equity, curves, balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.operators.asof import asof
from tidebook.operators.series import Cuts, Series


def to_settlement(
    amount: Column, currency: Column, settle: Column, is_inverse: Column, mark: Column
) -> Column:
    """Same currency passes, inverse coin amounts are marked, the rest is null."""
    return F.when(currency == settle, amount).when(is_inverse, amount * mark)


def exposure(holdings: DataFrame, account: str = "account") -> DataFrame:
    """Gross and net exposure per account, with the number of amounts left out.

    Needs ``net``, ``notional``, ``currency``, ``settle``, ``is_inverse``, ``mark``.
    """
    value = to_settlement(
        F.col("notional"), F.col("currency"), F.col("settle"), F.col("is_inverse"), F.col("mark")
    )
    rows = holdings.withColumn("_v", value)
    return rows.groupBy(account).agg(
        F.coalesce(F.sum("_v"), F.lit(0.0)).alias("gross_exposure"),
        F.coalesce(F.sum(F.col("_v") * F.signum("net")), F.lit(0.0)).alias("net_exposure"),
        F.count_if(F.col("_v").isNull()).alias("omitted"),
    )


def account_equity(
    balances: DataFrame, holdings: DataFrame, account: str = "account"
) -> DataFrame:
    """Balance plus converted realized and unrealized PnL."""
    conv = lambda c: to_settlement(
        F.col(c), F.col("currency"), F.col("settle"), F.col("is_inverse"), F.col("mark")
    )
    pnl = holdings.groupBy(account).agg(
        F.coalesce(F.sum(conv("realized")), F.lit(0.0)).alias("realized"),
        F.coalesce(F.sum(conv("unrealized")), F.lit(0.0)).alias("unrealized"),
    )
    zero = F.lit(0.0)
    return balances.join(pnl, account, "left").select(
        account,
        "balance",
        F.coalesce("realized", zero).alias("realized"),
        F.coalesce("unrealized", zero).alias("unrealized"),
        (F.col("balance") + F.coalesce("realized", zero) + F.coalesce("unrealized", zero)).alias(
            "equity"
        ),
    )


def balances_by_currency(adjustments: DataFrame) -> DataFrame:
    """Balance per account and currency; currencies never mix."""
    return adjustments.groupBy("account", "currency").agg(F.sum("amount").alias("balance"))


def pnl_by_strategy(positions: DataFrame) -> DataFrame:
    """Realized and unrealized PnL per strategy."""
    return positions.groupBy("strategy").agg(
        F.sum("realized").alias("realized"), F.sum("unrealized").alias("unrealized")
    )


def snap_fills(
    fills: DataFrame,
    bars: DataFrame,
    keys: list[str],
    bar_ts: str = "ts_event",
    cuts: Cuts | None = None,
) -> DataFrame:
    """Move each fill to its nearest bar; without bars it keeps its own time."""
    hit = asof(
        fills,
        bars,
        keys,
        left_at="ts",
        right_at=bar_ts,
        values={"_grid": "@at"},
        direction="nearest",
        cuts=cuts,
    )
    return hit.withColumn("ts", F.coalesce("_grid", "ts")).drop("_grid")


def curve_from_fills(
    fills: DataFrame,
    bars: DataFrame,
    series: Series,
    starting_balance: float,
    fee_rate: float = 0.0004,
    snap: bool = True,
) -> DataFrame:
    """Equity at every bar: cash and position after that bar's fills, marked at its close."""
    at = series.by[0]
    keys = list(series.keys)
    placed = snap_fills(fills, bars, keys, at, series.cuts) if snap else fills
    signed = F.col("side") * F.col("qty")
    flows = placed.groupBy(*keys, F.col("ts").alias(at)).agg(
        F.sum(-signed * F.col("px") - F.col("qty") * F.col("px") * F.lit(fee_rate)).alias("_cash"),
        F.sum(signed).alias("_qty"),
    )
    grid = bars.select(*keys, at, "close").join(flows, [*keys, at], "left")
    total = series.running(
        grid, {"_c": ("sum", F.col("_cash")), "_p": ("sum", F.col("_qty"))}
    )
    zero = F.lit(0.0)
    return total.select(
        *keys,
        at,
        "close",
        F.coalesce("_p", zero).alias("position"),
        (
            F.lit(float(starting_balance))
            + F.coalesce("_c", zero)
            + F.coalesce("_p", zero) * F.col("close")
        ).alias("equity"),
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.max(F.struct(*order, *rest)).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, "_r.*")


def recent(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """Newest ``k`` rows."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(k)
