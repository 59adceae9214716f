"""Option chains: values, greeks, implied volatility, expiry settlement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.pricing import ERF_A, ERF_P, bs_greeks, bs_price, intrinsic
from tidebook.operators.asof import asof
from tidebook.operators.series import Cuts

_INPUTS = ("spot", "strike", "t_years", "rate", "vol", "is_call")


def price_chain(chain: DataFrame) -> DataFrame:
    """Add ``price``; needs spot, strike, t_years, rate, vol, is_call."""
    return chain.withColumn("price", bs_price(*[F.col(c) for c in _INPUTS]))


def chain_greeks(chain: DataFrame) -> DataFrame:
    """Add delta, gamma, vega, theta and rho."""
    return chain.withColumns(bs_greeks(*[F.col(c) for c in _INPUTS]))


def portfolio_greeks(greeks: DataFrame, by: list[str]) -> DataFrame:
    """Sum of quantity x multiplier x greek."""
    size = F.col("qty") * F.col("multiplier")
    return greeks.groupBy(*by).agg(
        *[F.sum(size * F.col(g)).alias(g) for g in ("delta", "gamma", "vega", "theta", "rho")]
    )


def _cdf(x: np.ndarray) -> np.ndarray:
    z = np.abs(x) / np.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * z)
    poly = np.zeros_like(z)
    for c in reversed(ERF_A):
        poly = (poly + c) * t
    return 0.5 * (1.0 + np.sign(x) * (1.0 - poly * np.exp(-z * z)))


def _value_and_vega(s, k, t, r, vol, call):
    root = np.sqrt(t)
    d1 = (np.log(s / k) + (r + 0.5 * vol * vol) * t) / (vol * root)
    d2 = d1 - vol * root
    disc = k * np.exp(-r * t)
    sign = np.where(call, 1.0, -1.0)
    value = sign * (s * _cdf(sign * d1) - disc * _cdf(sign * d2))
    vega = s * np.exp(-0.5 * d1 * d1) / np.sqrt(2.0 * np.pi) * root
    return value, vega


def solve_vol(px, s, k, t, r, call) -> np.ndarray:
    """Volatility that reprices ``px`` for whole arrays; NaN when there is none.

    Newton from 0.2 for all rows at once, then bisection on [1e-6, 5] for the
    rows Newton left open.
    """
    n = len(px)
    out = np.full(n, np.nan)
    floor = np.maximum(np.where(call, 1.0, -1.0) * (s - k * np.exp(-r * t)), 0.0)
    ok = (t > 0) & (px > 0) & (s > 0) & (k > 0) & (px >= floor - 1e-9)
    vol = np.full(n, 0.2)
    active = ok.copy()
    with np.errstate(all="ignore"):
        for _ in range(100):
            i = np.flatnonzero(active)
            if not len(i):
                break
            value, vega = _value_and_vega(s[i], k[i], t[i], r[i], vol[i], call[i])
            miss = value - px[i]
            hit = np.abs(miss) < 1e-8
            out[i[hit]] = vol[i[hit]]
            moved = vol[i] - miss / vega
            lost = (vega < 1e-10) | ~((moved >= 1e-9) & (moved <= 5.0))
            active[i[hit | lost]] = False
            keep = ~(hit | lost)
            vol[i[keep]] = moved[keep]
        i = np.flatnonzero(ok & np.isnan(out))
        if len(i):
            lo, hi = np.full(len(i), 1e-6), np.full(len(i), 5.0)
            args = (s[i], k[i], t[i], r[i])
            f_lo = _value_and_vega(*args, lo, call[i])[0] - px[i]
            f_hi = _value_and_vega(*args, hi, call[i])[0] - px[i]
            found = np.full(len(i), np.nan)
            open_ = f_lo * f_hi <= 0
            for _ in range(200):
                if not open_.any():
                    break
                mid = 0.5 * (lo + hi)
                miss = _value_and_vega(*args, mid, call[i])[0] - px[i]
                hit = open_ & (np.abs(miss) < 1e-8)
                found[hit] = mid[hit]
                open_ &= ~hit
                left = f_lo * miss <= 0
                hi = np.where(open_ & left, mid, hi)
                lo = np.where(open_ & ~left, mid, lo)
                f_lo = np.where(open_ & ~left, miss, f_lo)
            found[open_] = 0.5 * (lo + hi)[open_]
            out[i] = found
    return out


def implied_vol(quotes: DataFrame) -> DataFrame:
    """Add ``iv``; needs price, spot, strike, t_years, rate, is_call.

    Arrow batches, no shuffle: each batch is solved as arrays.
    """
    schema = T.StructType([*quotes.schema.fields, T.StructField("iv", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cols = [
                pdf[c].to_numpy("float64") for c in ("price", "spot", "strike", "t_years", "rate")
            ]
            iv = solve_vol(*cols, pdf["is_call"].to_numpy(bool))
            yield pdf.assign(iv=iv)

    solved = quotes.mapInPandas(run, schema)
    return solved.withColumn("iv", F.when(F.isnan("iv"), F.lit(None)).otherwise(F.col("iv")))


def settle_at_expiry(
    positions: DataFrame,
    marks: DataFrame,
    *,
    mark_px: str = "close",
    mark_at: str = "ts_event",
    cuts: Cuts | None = None,
) -> DataFrame:
    """Closing fills of expired contracts, fee free.

    Options settle at the intrinsic value against the underlying's latest mark
    at expiry (their own mark when they name themselves or the underlying has
    none); futures settle at their own mark.  ``positions``: ``instrument,
    underlying, net, expiry_ns, strike, is_call, is_option, own_mark``.
    """
    looked = positions.where(F.col("net") != 0).withColumn(
        "_key", F.when(F.col("underlying") != F.col("instrument"), F.col("underlying"))
    )
    hit = asof(
        looked.withColumn("_key", F.coalesce("_key", F.col("instrument"))),
        marks.withColumnRenamed("symbol", "_key"),
        ["_key"],
        left_at="expiry_ns",
        right_at=mark_at,
        values={"spot": mark_px},
        cuts=cuts,
    )
    spot = F.coalesce("spot", "own_mark")
    px = F.when(F.col("is_option"), intrinsic(spot, F.col("strike"), F.col("is_call"))).otherwise(
        F.coalesce("own_mark", "spot")
    )
    return hit.select(
        "instrument",
        F.col("expiry_ns").alias("ts"),
        (-F.signum("net")).cast("long").alias("side"),
        F.abs("net").alias("qty"),
        px.alias("px"),
        F.lit(0.0).alias("fee"),
    )


def expired_orders(open_orders: DataFrame, instruments: DataFrame) -> DataFrame:
    """Resting orders whose contract expires during their life; cancel them then."""
    return (
        open_orders.join(instruments.select("instrument", "expiry_ns"), "instrument")
        .where(F.col("valid_to") >= F.col("expiry_ns"))
        .select("order_id", "instrument", F.col("expiry_ns").alias("cancel_ts"))
    )
