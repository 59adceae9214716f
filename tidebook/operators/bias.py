"""Look-ahead and overfitting screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.values import int_div
from tidebook.operators.series import Series

# Thresholds of the overfitting screen.
MIN_TRADES = 8
IMPLAUSIBLE_WIN_RATE = 0.95


def backwards_rows(df: DataFrame, series: Series, at: str) -> DataFrame:
    """Rows, in recorded order, whose time is before that of the row in front."""
    lagged = series.frames(df, lambda w: {"prev_ts": F.lag(at).over(w)}, before=1)
    return lagged.where(F.col(at) < F.col("prev_ts"))


def lookahead_fills(fills: DataFrame, bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fills before the first bar or later than one mean step after the last."""
    keys = list(keys)
    span = bars.groupBy(*keys).agg(
        F.min("ts_event").alias("_lo"),
        F.max("ts_event").alias("_hi"),
        F.count(F.lit(1)).alias("_n"),
    )
    step = F.when(F.col("_n") > 1, int_div(F.col("_hi") - F.col("_lo"), F.col("_n") - 1)).otherwise(
        F.lit(0)
    )
    problem = F.when(F.col("ts") < F.col("_lo"), "before_first_bar").when(
        F.col("ts") > F.col("_hi") + step, "after_last_bar"
    )
    return (
        fills.join(span, keys)
        .withColumn("problem", problem)
        .where(F.col("problem").isNotNull())
        .drop("_lo", "_hi", "_n")
    )


def overfit_flags(metrics: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Warnings for results that are too good: win rate, return without drawdown."""
    flags = [
        F.when(
            (F.col("n_trades") >= MIN_TRADES) & (F.col("win_rate") >= IMPLAUSIBLE_WIN_RATE),
            F.lit("implausible_win_rate"),
        ),
        F.when(
            (F.col("n_trades") > 0)
            & (F.col("max_drawdown") == 0)
            & (F.col("total_return") > 0),
            F.lit("zero_drawdown_with_profit"),
        ),
    ]
    return metrics.join(stats, list(keys), "left").withColumn(
        "warnings", F.filter(F.array(*flags), lambda f: f.isNotNull())
    )


def bias_report(lookahead: DataFrame, overfit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Warning counts by family per run; ``clean`` when no screen fired."""
    keys = list(keys)
    found = lookahead.groupBy(*keys, "problem").agg(F.count(F.lit(1)).alias("n"))
    late = found.groupBy(*keys).agg(F.sum("n").alias("lookahead"))
    over = overfit.select(*keys, F.size("warnings").cast("long").alias("overfitting"))
    both = over.join(late, keys, "full_outer").na.fill(0, ["lookahead", "overfitting"])
    return both.withColumn("clean", (F.col("lookahead") == 0) & (F.col("overfitting") == 0))
