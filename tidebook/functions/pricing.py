"""European option values and greeks as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26 coefficients of erf.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Error function, absolute error at most 1.5e-7."""
    a = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * a)
    poly: Column = F.lit(0.0)
    for c in reversed(ERF_A):
        poly = (poly + F.lit(c)) * t
    return F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * (
        F.lit(1.0) - poly * F.exp(-a * a)
    )


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    return F.lit(0.5) * (F.lit(1.0) + erf(x / F.lit(math.sqrt(2.0))))


def norm_pdf(x: Column) -> Column:
    """Standard normal density."""
    return F.exp(F.lit(-0.5) * x * x) / F.lit(math.sqrt(2.0 * math.pi))


def intrinsic(spot: Column, strike: Column, is_call: Column) -> Column:
    """Payoff at expiry."""
    return F.greatest(F.when(is_call, spot - strike).otherwise(strike - spot), F.lit(0.0))


def _d1(spot: Column, strike: Column, t: Column, rate: Column, vol: Column) -> Column:
    return (F.ln(spot / strike) + (rate + F.lit(0.5) * vol * vol) * t) / (vol * F.sqrt(t))


def degenerate(spot: Column, strike: Column, t: Column, vol: Column) -> Column:
    """No diffusion left (or no price): value collapses to intrinsic."""
    return (
        (t <= 0) | (vol * F.sqrt(F.greatest(t, F.lit(0.0))) <= 0) | (spot <= 0) | (strike <= 0)
    )


def bs_price(
    spot: Column, strike: Column, t: Column, rate: Column, vol: Column, is_call: Column
) -> Column:
    """Black-Scholes price; undiscounted intrinsic for degenerate inputs."""
    d1 = _d1(spot, strike, t, rate, vol)
    d2 = d1 - vol * F.sqrt(t)
    disc = F.exp(-rate * t)
    call = spot * norm_cdf(d1) - strike * disc * norm_cdf(d2)
    put = strike * disc * norm_cdf(-d2) - spot * norm_cdf(-d1)
    return F.when(degenerate(spot, strike, t, vol), intrinsic(spot, strike, is_call)).otherwise(
        F.when(is_call, call).otherwise(put)
    )


def bs_greeks(
    spot: Column, strike: Column, t: Column, rate: Column, vol: Column, is_call: Column
) -> dict[str, Column]:
    """Delta, gamma, vega (per 1.0 vol), theta (per year), rho; zeros when degenerate."""
    root = F.sqrt(t)
    d1 = _d1(spot, strike, t, rate, vol)
    d2 = d1 - vol * root
    disc = F.exp(-rate * t)
    pdf = norm_pdf(d1)
    decay = -(spot * pdf * vol) / (F.lit(2.0) * root)
    carry = rate * strike * disc
    flat = degenerate(spot, strike, t, vol)
    pick = lambda call, put: F.when(is_call, call).otherwise(put)
    raw = {
        "delta": pick(norm_cdf(d1), norm_cdf(d1) - 1.0),
        "gamma": pdf / (spot * vol * root),
        "vega": spot * pdf * root,
        "theta": pick(decay - carry * norm_cdf(d2), decay + carry * norm_cdf(-d2)),
        "rho": pick(
            strike * t * disc * norm_cdf(d2), -strike * t * disc * norm_cdf(-d2)
        ),
    }
    return {k: F.when(flat, F.lit(0.0)).otherwise(v) for k, v in raw.items()}
