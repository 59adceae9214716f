"""Technical indicators over ordered series; null until warm."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.values import is_finite
from tidebook.operators.recurrence import decay_filter, decay_filters
from tidebook.operators.series import Series


def check_period(*periods: int) -> None:
    """Periods count rows and must be positive."""
    for p in periods:
        if p <= 0:
            raise ValueError(f"period must be positive, got {p}")


def _full(w, p: int, value: Column) -> Column:
    """``value`` of the last ``p`` rows once there are that many."""
    frame = w.rowsBetween(-(p - 1), Window.currentRow)
    return F.when(F.count(F.lit(1)).over(frame) >= p, value.over(frame))


def sma(df: DataFrame, series: Series, period: int, col: str = "close", out: str = "sma"):
    """Mean of the last ``period`` rows; a period of one is the value itself."""
    return smas(df, series, {out: period}, col)


def smas(df: DataFrame, series: Series, periods: dict[str, int], col: str = "close"):
    """Several moving averages from one pass over the series."""
    check_period(*periods.values())
    reach = max(periods.values())
    return series.frames(
        df,
        lambda w: {n: _full(w, p, F.avg(col)) for n, p in periods.items()},
        before=reach - 1,
    )


def bollinger(df: DataFrame, series: Series, period: int, k: float = 2.0, col: str = "close"):
    """Mean and ``k`` population deviations around it."""
    check_period(period)

    def build(w):
        mid, sd = _full(w, period, F.avg(col)), _full(w, period, F.stddev_pop(col))
        return {"bb_lower": mid - sd * k, "bb_mid": mid, "bb_upper": mid + sd * k}

    return series.frames(df, build, before=period - 1)


def vwap(df: DataFrame, series: Series, period: int, out: str = "vwap"):
    """Volume-weighted price of the last ``period`` bars; null without volume."""
    check_period(period)

    def build(w):
        pv = _full(w, period, F.sum(F.col("close") * F.col("volume")))
        v = _full(w, period, F.sum("volume"))
        return {out: F.when(v != 0, pv / v)}

    return series.frames(df, build, before=period - 1)


def _warm(df: DataFrame, series: Series, out: str, n: int) -> DataFrame:
    """Null ``out`` on the first ``n`` rows that carry a value."""
    counted = series.running(df, {"_seen": ("count", F.col(out))})
    return counted.withColumn(out, F.when(F.col("_seen") > n, F.col(out))).drop("_seen")


def ema(df: DataFrame, series: Series, period: int, col: str = "close", out: str = "ema"):
    """Exponential average seeded with the first value, shown from row ``period`` on."""
    check_period(period)
    return _warm(
        decay_filter(df, series, col, out, 2.0 / (period + 1.0)), series, out, period - 1
    )


def rsi(df: DataFrame, series: Series, period: int = 14, col: str = "close", out: str = "rsi"):
    """Wilder RSI; 100 when there was no loss, null before ``period`` changes."""
    check_period(period)
    numbered = series.number(df, "_rn")
    prev = series.frames(numbered, lambda w: {"_p": F.lag(col).over(w)}, before=1)
    moves = prev.withColumns(
        {
            "_gain": F.greatest(F.col(col) - F.col("_p"), F.lit(0.0)),
            "_loss": F.greatest(F.col("_p") - F.col(col), F.lit(0.0)),
        }
    )

    def seeds(w):
        frame = w.rowsBetween(-(period - 1), Window.currentRow)

        def smoothing_input(c):
            seed = F.when(F.col("_rn") == period, F.avg(c).over(frame))
            return F.when(F.col("_rn") > period, F.col(c)).otherwise(seed)

        return {"_g": smoothing_input("_gain"), "_d": smoothing_input("_loss")}

    smooth = series.frames(moves, seeds, before=period - 1).drop("_p", "_gain", "_loss")
    wilder = 1.0 / period
    smooth = decay_filters(smooth, series, {"_g_s": ("_g", wilder), "_d_s": ("_d", wilder)})
    strength = F.when(F.col("_d_s") == 0, F.lit(100.0)).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.col("_g_s") / F.col("_d_s"))
    )
    warm = F.col("_rn") >= period
    return smooth.withColumn(out, F.when(warm, strength)).select(*df.columns, out)


def atr(df: DataFrame, series: Series, period: int = 14, out: str = "atr"):
    """Wilder average true range; the first range is high minus low."""
    check_period(period)

    def ranges(w):
        pc = F.lag("close").over(w)
        return {
            "_tr": F.greatest(
                F.col("high") - F.col("low"),
                F.abs(F.col("high") - pc),
                F.abs(F.col("low") - pc),
            )
        }

    tr = series.frames(df, ranges, before=1)
    smooth = decay_filter(tr, series, "_tr", out, 1.0 / period).drop("_tr")
    return _warm(smooth, series, out, period - 1)


def macd(
    df: DataFrame,
    series: Series,
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    col: str = "close",
):
    """MACD line, signal and histogram; all null until the signal is warm."""
    check_period(fast, slow, signal)
    numbered = series.number(df, "_no")
    both = {"_f": (col, 2.0 / (fast + 1.0)), "_s": (col, 2.0 / (slow + 1.0))}
    s = decay_filters(numbered, series, both)
    first = max(fast, slow) - 1
    line = F.when(F.col("_no") >= first, F.col("_f") - F.col("_s"))
    full = decay_filter(
        s.withColumn("macd", line), series, "macd", "signal", 2.0 / (signal + 1.0)
    )
    ready = F.col("_no") >= first + signal - 1
    names = ("macd", "signal", "hist")
    done = full.withColumn("hist", F.col("macd") - F.col("signal")).withColumns(
        {n: F.when(ready, F.col(n)) for n in names}
    )
    return done.select(*df.columns, *names)


def on_finite(
    df: DataFrame,
    series: Series,
    inputs: Sequence[str],
    outputs: Sequence[str],
    compute: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Skip rows whose inputs are not finite; they repeat the last outputs."""
    good = F.lit(True)
    for c in inputs:
        good = good & is_finite(F.col(c))
    marked = df.withColumn("_good", good)
    done = compute(marked.where(F.col("_good")))
    types = {f.name: f.dataType for f in done.schema.fields}
    held = marked.where(~F.col("_good")).withColumns(
        {o: F.lit(None).cast(types[o]) for o in outputs}
    )
    both = done.unionByName(held)
    filled = series.running(both, {f"_h_{o}": ("last", F.col(o)) for o in outputs})
    return filled.withColumns(
        {o: F.when(F.col("_good"), F.col(o)).otherwise(F.col(f"_h_{o}")) for o in outputs}
    ).drop("_good", *[f"_h_{o}" for o in outputs])


def returns(df: DataFrame, series: Series, col: str = "equity", out: str = "ret"):
    """Simple returns between rows; 0 after a zero, null on the first row."""

    def build(w):
        p = F.lag(col).over(w)
        return {
            out: F.when(p.isNotNull(), F.when(p == 0, F.lit(0.0)).otherwise((F.col(col) - p) / p))
        }

    return series.frames(df, build, before=1)


def drawdown(df: DataFrame, series: Series, col: str = "equity"):
    """Running peak and the relative fall from it (0 while the peak is not positive)."""
    peaked = series.running(df, {"peak": ("max", F.col(col))})
    return peaked.withColumn(
        "drawdown",
        F.when(F.col("peak") > 0, (F.col("peak") - F.col(col)) / F.col("peak")).otherwise(
            F.lit(0.0)
        ),
    )


def runs(df: DataFrame, series: Series, same: Sequence[str], out: str = "run"):
    """Number the maximal stretches of consecutive rows with equal ``same`` columns."""

    # the last row before this one, found in one pass also where a series is split
    lagged = series.running(df, {"_p": ("last", F.struct(*same))}, include_current=False)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.col("_p")[c])
    flagged = lagged.withColumn("_new", changed.cast("int")).drop("_p")
    return series.running(flagged, {out: ("sum", F.col("_new").cast("long"))}).drop("_new")
