"""Execution-cost rules: price, size and fee of a fill as column expressions.

Subclass ``CostModel`` and override a method to plug in other economics.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.functions.values import quantize


@dataclass(frozen=True)
class CostModel:
    """Defaults: a fixed spread cost, optional range impact and volume cap.

    ``price_precision`` and ``fee_precision`` are the decimals of the instrument
    and of the settlement currency: a number for all, or the name of a column of
    the rows, so that every instrument and currency has its own. None, or a null
    in the column, leaves prices and fees as they come. Halves of the last decimal
    go to the even neighbour, or away from zero without ``half_even``.
    """

    slippage_bps: float = 1.0
    range_impact: float = 0.0
    participation_rate: float = 0.1
    queue_ahead_factor: float = 0.0
    lot: float = 1.0
    latency_ns: int = 1_000_000
    price_precision: int | str | None = None
    fee_precision: int | str | None = None
    half_even: bool = True

    def fill_price(self, side: Column, ref: Column, low: Column, high: Column) -> Column:
        """Adverse slippage; only its range part stops at the bar extreme."""
        slip = ref * F.lit(self.slippage_bps / 10_000.0)
        ranged = high > low
        reach = F.when(ranged, (high - low) * F.lit(self.range_impact)).otherwise(F.lit(0.0))
        buy_base, sell_base = ref + slip, ref - slip
        buy = F.when(
            ranged, F.greatest(F.least(buy_base + reach, high), buy_base)
        ).otherwise(buy_base)
        sell = F.when(
            ranged, F.least(F.greatest(sell_base - reach, low), sell_base)
        ).otherwise(sell_base)
        return _rounded(F.when(side > 0, buy).otherwise(sell), self.price_precision, self.half_even)

    def volume_cap(self, volume: Column) -> Column:
        """Most a bar can fill; null means no cap."""
        if self.participation_rate <= 0:
            return F.lit(None).cast("double")
        share = whole_lots(volume, self.participation_rate, self.lot)
        return F.when(volume > 0, F.greatest(share.cast("double"), F.lit(self.lot)))

    def queue_ahead(self, volume: Column) -> Column:
        """Volume waiting in front of a new passive order, whole lots."""
        return whole_lots(volume, max(self.queue_ahead_factor, 0.0), self.lot)

    def fee(
        self,
        px: Column,
        qty: Column,
        multiplier: Column,
        inverse: Column,
        rate: Column,
    ) -> Column:
        """Fee in the settlement currency on the fill notional."""
        return _rounded(notional(px, qty, multiplier, inverse) * rate, self.fee_precision, self.half_even)

    def fill_time(self, event_ns: Column) -> Column:
        """When the fill is reported."""
        return event_ns + F.lit(self.latency_ns)


#: Decimals that a column of precisions may ask for, at most.
MAX_DECIMALS = 12


def _rounded(x: Column, precision: int | str | None, half_even: bool) -> Column:
    if precision is None:
        return x
    if isinstance(precision, int):
        return quantize(x, precision, half_even).cast("double")
    # rounding takes a constant, so there is one branch for each number of decimals
    out = F.when(F.col(precision).isNull(), x)
    for k in range(MAX_DECIMALS + 1):
        out = out.when(F.col(precision) == k, quantize(x, k, half_even).cast("double"))
    return out.otherwise(F.raise_error(F.concat(F.lit("decimals out of range: "), F.col(precision).cast("string"))))


def whole_lots(volume: Column, rate: float, lot: float) -> Column:
    """The share of a volume in whole lots, in decimals so that no lot is lost to rounding."""
    share = volume.cast("decimal(20,6)") * F.lit(Decimal(str(rate))) / F.lit(Decimal(str(lot)))
    return F.floor(share).cast("double") * F.lit(lot)


def notional(px: Column, qty: Column, multiplier: Column, inverse: Column) -> Column:
    """Linear: quantity at price; inverse: coin amount, 0 at price 0."""
    return F.when(
        inverse, F.when(px == 0, F.lit(0.0)).otherwise(qty * multiplier / px)
    ).otherwise(px * qty * multiplier)


def pnl_per_unit(inverse: Column, entry: Column, exit_: Column, multiplier: Column) -> Column:
    """PnL of one unit held long from ``entry`` to ``exit_``; 0 at entry 0."""
    return (
        F.when(entry == 0, F.lit(0.0))
        .when(
            inverse,
            multiplier * (F.lit(1.0) / entry - F.try_divide(F.lit(1.0), exit_)),
        )
        .otherwise(multiplier * (exit_ - entry))
    )
