"""Target positions from indicators, vectorized mark-to-market, parameter sweeps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.operators.indicators import rsi, smas
from tidebook.operators.series import Series


def cross_events(df: DataFrame, series: Series, fast: str, slow: str) -> DataFrame:
    """``cross``: +1 on a strict up-cross, -1 on a strict down-cross, else null.

    Both rows must be warm; a touch is no cross.
    """

    def build(w):
        pf, ps = F.lag(fast).over(w), F.lag(slow).over(w)
        f, s = F.col(fast), F.col(slow)
        return {
            "cross": F.when((pf <= ps) & (f > s), 1).when((pf >= ps) & (f < s), -1)
        }

    return series.frames(df, build, before=1)


def hold_last(df: DataFrame, series: Series, event: str, out: str = "state") -> DataFrame:
    """Carry the last non-null event forward."""
    return series.running(df, {out: ("last", F.col(event))})


def sma_cross_positions(
    bars: DataFrame, series: Series, fast: int, slow: int, qty: float = 0.5
) -> DataFrame:
    """Long ``qty`` from an up-cross to the next down-cross, flat before the first."""
    lines = smas(bars, series, {"fast_ma": fast, "slow_ma": slow})
    crossed = cross_events(lines, series, "fast_ma", "slow_ma")
    held = hold_last(crossed, series, "cross")
    return held.withColumn(
        "position", F.when(F.col("state") > 0, F.lit(float(qty))).otherwise(F.lit(0.0))
    ).drop("state")


def rsi_reversion_positions(
    bars: DataFrame,
    series: Series,
    period: int = 14,
    low: float = 30.0,
    high: float = 70.0,
    qty: float = 0.5,
) -> DataFrame:
    """Enter below ``low``, leave above ``high``, hold in between."""
    lines = rsi(bars, series, period)
    event = F.when(F.col("rsi") < low, 1).when(F.col("rsi") > high, 0)
    held = hold_last(lines.withColumn("_e", event), series, "_e")
    return held.withColumn(
        "position", F.when(F.col("state") == 1, F.lit(float(qty))).otherwise(F.lit(0.0))
    ).drop("_e", "state")


def mark_to_market(
    positions: DataFrame,
    series: Series,
    *,
    starting_balance: float = 100_000.0,
    fee_rate: float = 0.0004,
    exec_lag: int = 1,
) -> DataFrame:
    """Equity of a target-position series; columns ``held``, ``dpos``, ``equity``.

    The target of a bar is realized ``exec_lag`` bars later; each position
    change pays ``fee_rate`` on its notional.
    """
    zero = F.lit(0.0)

    def build(w):
        held = F.coalesce(F.lag("position", exec_lag).over(w), zero) if exec_lag else F.col("position")
        before = F.coalesce(F.lag("position", exec_lag + 1).over(w), zero)
        move = F.col("close") - F.lag("close").over(w)
        return {
            "held": held,
            "dpos": held - before,
            "_gain": F.coalesce(before * move, zero),
        }

    steps = series.frames(positions, build, before=exec_lag + 1)
    net = F.col("_gain") - F.abs("dpos") * F.col("close") * F.lit(fee_rate)
    total = series.running(steps, {"_net": ("sum", net)})
    return total.withColumn("equity", F.lit(float(starting_balance)) + F.col("_net")).drop(
        "_gain", "_net"
    )


def position_fills(marked: DataFrame, series: Series) -> DataFrame:
    """Fills at the bars where the held position changes."""
    return marked.where(F.col("dpos") != 0).select(
        *series.keys,
        F.col(series.by[0]).alias("ts"),
        F.when(F.col("dpos") > 0, 1).otherwise(-1).cast("long").alias("side"),
        F.abs("dpos").alias("qty"),
        F.col("close").alias("px"),
    )


def to_session(marked: DataFrame, series: Series) -> tuple[DataFrame, DataFrame]:
    """(equity curve, fills) of a vector backtest, the input of the parity checks."""
    curve = marked.select(*series.keys, *series.by, "equity")
    return curve, position_fills(marked, series)


def check_lengths(bars: DataFrame, positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows present on only one side; an empty result means the lengths match."""
    b = bars.select(*keys).withColumn("_b", F.lit(1))
    p = positions.select(*keys).withColumn("_p", F.lit(1))
    both = b.join(p, list(keys), "full_outer")
    return both.where(F.col("_b").isNull() | F.col("_p").isNull()).select(
        *keys, F.when(F.col("_b").isNull(), "no bar").otherwise("no position").alias("problem")
    )


def pairs(fasts: Sequence[int], slows: Sequence[int]) -> list[tuple[int, int]]:
    """Valid (fast, slow) pairs in grid order."""
    return [(f, s) for f in fasts for s in slows if f < s]


def with_grid(df: DataFrame, fasts: Sequence[int], slows: Sequence[int]) -> DataFrame:
    """Each row once per valid pair, as ``combo``, ``fast`` and ``slow``."""
    combos = [
        F.struct(F.lit(i).cast("long").alias("combo"), F.lit(f).alias("fast"), F.lit(s).alias("slow"))
        for i, (f, s) in enumerate(pairs(fasts, slows))
    ]
    return df.select("*", F.inline(F.array(*combos)))


def sweep_positions(
    bars: DataFrame, series: Series, fasts: Sequence[int], slows: Sequence[int], qty: float = 0.5
) -> tuple[DataFrame, Series]:
    """Positions of every (fast, slow) pair, one average per distinct period.

    Each bar carries its averages in one array; a pair reads two elements, so
    the bars are scanned once and fan out by the number of pairs.
    """
    periods = sorted(set(fasts) | set(slows))
    at = {p: i for i, p in enumerate(periods)}
    lines = smas(bars, series, {f"_ma{p}": p for p in periods})
    packed = lines.withColumn("_ma", F.array(*[F.col(f"_ma{p}") for p in periods])).drop(
        *[f"_ma{p}" for p in periods]
    )
    fan = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).cast("long").alias("combo"),
                    F.lit(f).alias("fast"),
                    F.lit(s).alias("slow"),
                    F.col("_ma")[at[f]].alias("fast_ma"),
                    F.col("_ma")[at[s]].alias("slow_ma"),
                )
                for i, (f, s) in enumerate(pairs(fasts, slows))
            ]
        )
    )
    fanned = packed.withColumn("_c", fan).drop("_ma").select("*", "_c.*").drop("_c")
    wide = series.within("fast", "slow")
    held = hold_last(cross_events(fanned, wide, "fast_ma", "slow_ma"), wide, "cross")
    return (
        held.withColumn(
            "position", F.when(F.col("state") > 0, F.lit(float(qty))).otherwise(F.lit(0.0))
        ).drop("state"),
        wide,
    )


def signal_function(
    bars: DataFrame,
    series: Series,
    fn: Callable,
    lookback: int,
) -> DataFrame:
    """User signal: ``fn(pandas bars in order) -> positions`` of the same length.

    A series is fed in runs of consecutive bars, each preceded by the
    ``lookback`` bars before it, so ``fn`` may only depend on those.
    """
    if lookback < 0:
        raise ValueError("lookback must not be negative")
    size = max(series.rows_per_block, lookback + 1)
    rows = series.number(bars, "_rn")
    chunk = F.call_function("div", F.col("_rn"), F.lit(size))
    last = F.call_function("div", F.col("_rn") + lookback, F.lit(size))
    spread = rows.withColumn("_chunk", F.explode(F.sequence(chunk, last)))
    schema = T.StructType([*bars.schema.fields, T.StructField("position", T.DoubleType())])
    names = [f.name for f in schema.fields]
    by = list(series.by)

    def run(pdf):
        pdf = pdf.sort_values(by, kind="stable")
        pdf["position"] = list(fn(pdf[names[:-1]]))
        return pdf.loc[pdf["_rn"] // size == pdf["_chunk"], names]

    return spread.groupBy(*series.keys, "_chunk").applyInPandas(run, schema)
