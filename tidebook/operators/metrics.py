"""Performance metrics of equity curves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.indicators import drawdown, returns
from tidebook.operators.series import Cuts, Series

MINUTES_PER_YEAR = 525_600


def perf_metrics(
    curve: DataFrame, series: Series, annualization: int = MINUTES_PER_YEAR
) -> DataFrame:
    """One row per run: return, Sharpe, Sortino, drawdown, volatility, periods.

    Population deviation; downside over negative returns only; curves shorter
    than two points score zero.
    """
    ann = math.sqrt(annualization)
    order = F.struct(*series.by)
    steps = drawdown(returns(curve, series), series)
    agg = steps.groupBy(*series.keys).agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.min_by("equity", order).alias("_first"),
        F.max_by("equity", order).alias("_last"),
        F.avg("ret").alias("_mean"),
        F.stddev_pop("ret").alias("_sd"),
        F.sqrt(F.avg(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")))).alias("_down"),
        F.max("drawdown").alias("_dd"),
    )
    enough = F.col("n_periods") >= 2
    zero = F.lit(0.0)

    def when_enough(col):
        return F.coalesce(F.when(enough, col), zero)

    return agg.select(
        *series.keys,
        when_enough(F.col("_last") / F.nullif(F.col("_first"), zero) - 1.0).alias("total_return"),
        when_enough(F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * ann)).alias("sharpe"),
        when_enough(F.when(F.col("_down") > 0, F.col("_mean") / F.col("_down") * ann)).alias(
            "sortino"
        ),
        when_enough(F.col("_dd")).alias("max_drawdown"),
        when_enough(F.col("_sd") * ann).alias("volatility"),
        "n_periods",
    )


def screen_scores(marked: DataFrame, series: Series, starting_balance: float = 100_000.0):
    """Score rows of a sweep: return, annualized Sharpe, entries.

    A zero previous equity divides by one; no deviation scores zero.
    """

    def build(w):
        p = F.lag("equity").over(w)
        return {
            "_r": F.when(
                p.isNotNull(),
                (F.col("equity") - p) / F.when(p == 0, F.lit(1.0)).otherwise(p),
            )
        }

    steps = series.frames(marked, build, before=1)
    agg = steps.groupBy(*series.keys).agg(
        F.max_by("equity", F.struct(*series.by)).alias("_last"),
        F.avg("_r").alias("_mean"),
        F.stddev_pop("_r").alias("_sd"),
        F.count_if(F.col("dpos") > 0).alias("n_trades"),
    )
    return agg.select(
        *series.keys,
        (F.col("_last") / F.lit(float(starting_balance)) - 1.0).alias("total_return"),
        F.coalesce(
            F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * math.sqrt(MINUTES_PER_YEAR)),
            F.lit(0.0),
        ).alias("sharpe"),
        "n_trades",
    )


def return_histogram(steps: DataFrame, keys: tuple[str, ...], bins: int = 40) -> DataFrame:
    """Equal-width histogram of ``ret`` per run; the maximum falls in the last bin."""
    edges = steps.groupBy(*keys).agg(F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    slot = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("ret") - F.col("lo")) / width), F.lit(bins - 1))
    )
    return (
        steps.where(F.col("ret").isNotNull())
        .join(edges, list(keys))
        .groupBy(*keys, slot.cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


#: Bits of a value that one round of ``values_at_ranks`` tells apart.
DIGIT = 16


def values_at_ranks(df: DataFrame, by: str, value: str, wanted: DataFrame, digit: int = DIGIT) -> DataFrame:
    """``wanted`` (``by``, rank from 0) with ``value``, the one at that rank of its group.

    Radix selection on a long column: rows are counted by their leading digits,
    running counts over at most ``2**digit`` of these tell in which one a rank
    lies, and the next round counts only the rows below that one by their next
    digits.  No task ever orders more than ``2**digit`` counts, however many
    distinct values a group has.
    """
    name = wanted.schema[by].dataType
    rows = df.select(F.col(by).alias("_g"), F.col(value).cast("long").alias("_v")).where("_v is not null")
    at = wanted.select(F.col(by).alias("_g"), "rank", F.col("rank").alias("left"), F.lit(0).cast("long").alias("_head"))
    for low in range(64 - digit, -1, -digit):
        # every head carries the ranks looked for in it, so each round reads the last one once
        heads = at.groupBy("_g", "_head").agg(F.collect_list(F.struct("rank", "left")).alias("_ranks"))
        head = F.shiftright("_v", low + digit) if low < 64 - digit else F.lit(0).cast("long")
        own = rows.withColumn("_head", head).join(heads, ["_g", "_head"])
        counts = own.groupBy("_g", "_head", F.shiftright("_v", low).alias("_next")).agg(F.count(F.lit(1)).alias("_n"), F.first("_ranks").alias("_ranks"))
        w = Window.partitionBy("_g", "_head").orderBy("_next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("_upto", F.sum("_n").over(w))
        before = F.col("_upto") - F.col("_n")
        inside = F.filter("_ranks", lambda r: (r["left"] < F.col("_upto")) & (r["left"] >= before))
        at = counts.select("_g", F.col("_next").alias("_head"), before.alias("_before"), F.explode(inside).alias("_r"))
        at = at.select("_g", "_head", "_r.rank", (F.col("_r.left") - F.col("_before")).alias("left"))
    return at.select(F.col("_g").cast(name).alias(by), "rank", F.col("_head").alias(value))


def latency_percentiles(
    events: DataFrame,
    by: str = "metric",
    probs: tuple[float, ...] = (0.5, 0.95, 0.99),
    digit: int = DIGIT,
) -> DataFrame:
    """Exact interpolated percentiles of ``latency_ns`` per metric, by the values at the ranks about them."""
    totals = events.where(F.col("latency_ns").isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    places = [F.lit(p) * (F.col("n") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*[F.floor(x) for x in places], *[F.ceil(x) for x in places]))
    found = values_at_ranks(events, by, "latency_ns", totals.select(by, F.explode(ranks).alias("rank")), digit)
    held = totals.join(found.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "latency_ns"))).alias("_at")), by)
    out = []
    for p, x in zip(probs, places):
        low, high = F.col("_at")[F.floor(x)], F.col("_at")[F.ceil(x)]
        out.append((low + (high - low) * (x - F.floor(x))).alias(f"p{round(p * 100)}"))
    return held.select(by, *out, "n")


def run_counters(order_events: DataFrame, curve: DataFrame, by: str = "run_id") -> DataFrame:
    """Submitted, denied and filled counts with start and final equity per run."""
    kinds = order_events.groupBy(by).agg(
        F.count_if(F.col("kind") == "submitted").alias("submitted"),
        F.count_if(F.col("kind") == "denied").alias("denied"),
        F.count_if(F.col("kind").isin("filled", "partially_filled")).alias("fills"),
    )
    ends = curve.groupBy(by).agg(
        F.min_by("equity", "ts").alias("starting_equity"),
        F.max_by("equity", "ts").alias("final_equity"),
    )
    return kinds.join(ends, by, "full_outer")


def tear_sheet(metrics: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """(run, metric, value) rows from the metrics and trade statistics."""
    joined = metrics.join(stats, key, "left")
    names = [c for c in joined.columns if c != key]
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
            for c in names
        ]
    )
    return joined.select(key, F.inline(pairs))


def rank(scores: DataFrame, by: str, ties: list[str], k: int) -> DataFrame:
    """Best ``k`` rows, ties broken by ``ties``."""
    return scores.orderBy(F.col(by).desc(), *ties).limit(k)


def best_per_group(
    scores: DataFrame, group: list[str], score: str = "score", tie: str = "combo"
) -> DataFrame:
    """Best finite score of each group, the first in grid order on a tie.

    A group without a finite score keeps its first combination.
    """
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    ranked = scores.withColumn("_ok", finite)
    w = Window.partitionBy(*group).orderBy(
        F.col("_ok").desc(), F.when(F.col("_ok"), F.col(score)).desc_nulls_last(), F.col(tie)
    )
    return (
        ranked.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") == 1)
        .drop("_r", "_ok")
    )
