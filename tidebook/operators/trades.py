"""Fills to round-trip trades and trade statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators.asof import asof
from tidebook.operators.indicators import runs
from tidebook.operators.series import ROWS_PER_BLOCK, Cuts, Series, measure_cuts
from tidebook.session import staged

# Fixed value: quantities at or below this are flat.
DUST = 1e-12
_QTY = "decimal(38,12)"
_SUM = "decimal(36,12)"  # leaves room for a sum of two


def coalesce_partials(fills: DataFrame, series: Series) -> DataFrame:
    """Merge strictly consecutive fills with the same side and price."""
    marked = runs(fills, series, ["side", "px"])
    first = F.struct(*series.by)
    return (
        marked.groupBy(*series.keys, "run")
        .agg(
            *[F.min_by(c, first).alias(c) for c in series.by],
            F.first("side").alias("side"),
            F.sum("qty").alias("qty"),
            F.first("px").alias("px"),
        )
        .drop("run")
    )


def _split_parts(fills: DataFrame, series: Series) -> DataFrame:
    """Closing and opening quantity of each fill with twice their running totals.

    What was opened less what was closed is the size of the position, and both
    together are all that was traded, so two sums give all of them.
    """
    q = F.coalesce(F.col("qty").cast(_QTY), F.lit(0).cast(_QTY))
    signed = F.when(F.col("side") > 0, q).when(F.col("side") < 0, -q).otherwise(F.lit(0).cast(_QTY))
    sums = series.running(fills, {"_net": ("sum", signed), "_all": ("sum", q)})
    before = F.col("_net").cast(_SUM) - signed.cast(_SUM)
    against = F.signum(before) == -F.col("side")
    closing = F.when(against, F.least(F.abs(before), q)).otherwise(F.lit(0).cast(_QTY))
    size, traded = F.abs("_net").cast(_SUM), F.col("_all").cast(_SUM)
    return sums.withColumns({"_close": closing, "_cum_open": traded + size, "_cum_close": traded - size}).withColumn(
        "_open", q - F.col("_close")
    )


def fifo_trades(
    fills: DataFrame, series: Series, fee_rate: float = 0.0, coalesce: bool = True
) -> DataFrame:
    """FIFO round trips of each series; open lots are not emitted.

    The n-th unit closed is the n-th unit opened.  Opens and closes are laid
    on one axis of cumulative quantity, and every stretch between neighbouring
    breakpoints is one matched lot, so no lot is ever joined to all closes.
    """
    fills = fills.select(*series.keys, *series.by, "side", "qty", "px")
    merged = coalesce_partials(fills, series) if coalesce else fills
    parts = _split_parts(merged, series)
    at = series.by[0]

    leg = F.struct(F.col(at).alias("ts"), F.col("px").alias("px"), F.col("side").alias("side"))

    def mark(kind: int, size: str, cum: str):
        return F.struct(
            F.col(size).alias("_size"),
            F.col(cum).alias("_cum"),
            F.floor(cum).cast("long").alias("_pos"),
            F.lit(kind).alias("_kind"),
            (leg if kind == 0 else F.when(F.lit(False), leg)).alias("_entry"),
            (leg if kind == 1 else F.when(F.lit(False), leg)).alias("_exit"),
        )

    both = F.array(mark(0, "_open", "_cum_open"), mark(1, "_close", "_cum_close"))
    axis = parts.select(*series.keys, F.inline(both)).where(F.col("_size") > 0).drop("_size")
    cuts: Cuts | None = None
    if series.is_split:
        axis = staged(axis)
        cuts = measure_cuts(axis, series.keys, "_pos", series.rows_per_block)
    line = Series.of(series.keys, ("_pos", "_cum", "_kind"), cuts)
    # The narrow rows first: a second pass over a split series is staged and shuffled again.
    spans = line.running(axis, {"_before": ("last", F.col("_cum"))}, include_current=False)
    qty = F.col("_cum") - F.coalesce(F.col("_before"), F.lit(0).cast(_QTY))
    spans = spans.withColumn("qty", qty.cast("double") / 2).drop("_before")
    legs = line.running(
        spans,
        {"entry": ("last", F.col("_entry")), "exit": ("last", F.col("_exit"))},
        reverse=True,
    )
    lots = legs.where((F.col("qty") > DUST) & F.col("exit").isNotNull())
    entry, exit_, q = F.col("entry.px"), F.col("exit.px"), F.col("qty")
    pnl = (exit_ - entry) * q * F.col("entry.side") - (entry + exit_) * q * F.lit(fee_rate)
    return lots.select(
        *series.keys,
        F.col("entry.ts").alias("entry_ts"),
        F.col("exit.ts").alias("exit_ts"),
        F.col("entry.side").cast("long").alias("side"),
        "qty",
        entry.alias("entry_px"),
        exit_.alias("exit_px"),
        pnl.alias("pnl"),
        F.when(entry * q != 0, pnl / (entry * q)).otherwise(F.lit(0.0)).alias("return_pct"),
    )


def open_exposure(fills: DataFrame, keys: list[str]) -> DataFrame:
    """Side and size still open after the stream; dust counts as flat."""
    net = F.sum(F.col("side") * F.col("qty").cast(_QTY)).cast("double")
    flat = F.abs("_net") <= DUST
    return (
        fills.groupBy(*keys)
        .agg(net.alias("_net"))
        .select(
            *keys,
            F.when(flat, 0).otherwise(F.signum("_net")).cast("long").alias("net_side"),
            F.when(flat, 0.0).otherwise(F.abs("_net")).alias("open_qty"),
        )
    )


def trade_stats(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Trade-level statistics; with no keys always one row, zeros without trades."""
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    agg = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(win).alias("n_wins"),
        F.count_if(loss).alias("n_losses"),
        F.sum(F.when(win, F.col("pnl"))).alias("_gp"),
        F.sum(F.when(loss, -F.col("pnl"))).alias("_gl"),
        F.sum("pnl").alias("_total"),
        F.max("pnl").alias("_best"),
        F.min("pnl").alias("_worst"),
        F.avg((F.col("exit_ts") - F.col("entry_ts")).cast("double")).alias("_hold"),
    )
    zero = F.lit(0.0)
    n = F.col("n_trades").cast("double")
    gp, gl = F.coalesce("_gp", zero), F.coalesce("_gl", zero)
    some = lambda c: F.coalesce(c, zero)
    return agg.select(
        *keys,
        "n_trades",
        "n_wins",
        "n_losses",
        some(F.when(n > 0, F.col("n_wins") / n)).alias("win_rate"),
        F.when(gl > 0, gp / gl)
        .when(gp > 0, F.lit(float("inf")))
        .otherwise(zero)
        .alias("profit_factor"),
        some(F.when(n > 0, F.col("_total") / n)).alias("avg_trade"),
        some(F.when(F.col("n_wins") > 0, gp / F.col("n_wins"))).alias("avg_win"),
        some(F.when(F.col("n_losses") > 0, -gl / F.col("n_losses"))).alias("avg_loss"),
        some(F.col("_best")).alias("largest_win"),
        some(F.col("_worst")).alias("largest_loss"),
        gp.alias("gross_profit"),
        gl.alias("gross_loss"),
        some(F.col("_total")).alias("total_pnl"),
        some(F.col("_hold")).alias("avg_holding_ns"),
    )


def time_in_market(
    fills: DataFrame, grid: DataFrame, series: Series, run: list[str] | None = None
) -> DataFrame:
    """Share of bars at which any symbol of the run was not flat.

    ``grid`` has one row per (run, bar ts); ``fills`` carry run and symbol.
    Between two fills of a symbol its position is constant, so each non-flat
    stretch becomes an interval and a bar is covered when the number of open
    intervals is positive; fills never multiply with bars.
    """
    run = list(run or [])
    at = series.by[0]
    net = series.running(
        fills, {"_net": ("sum", F.col("qty").cast(_QTY) * F.col("side"))}
    ).withColumn("_on", (F.abs("_net") > DUST).cast("int"))
    switched = series.frames(
        net, lambda w: {"_was": F.coalesce(F.lag("_on").over(w), F.lit(0))}, before=1
    )
    steps = switched.where(F.col("_on") != F.col("_was")).select(
        *run, F.col(at).alias("ts"), (F.col("_on") - F.col("_was")).cast("long").alias("_step")
    )
    per_ts = steps.groupBy(*run, "ts").agg(F.sum("_step").alias("_step"))
    key = run or ["_all"]
    left, right = grid, per_ts
    if not run:
        left = left.withColumn("_all", F.lit(0))
        right = right.withColumn("_all", F.lit(0))
    # A run may pool any number of symbols, so its own length is measured.
    rows = series.cuts.rows_per_block if series.cuts else ROWS_PER_BLOCK
    axis = Series.of(key, ("ts",), measure_cuts(right.unionByName(left, True), key, "ts", rows))
    level = axis.running(right, {"_open": ("sum", F.col("_step"))})
    hit = asof(
        left, level, key, left_at="ts", right_at="ts", values={"_open": "_open"}, cuts=axis.cuts
    )
    share = F.avg(F.when(F.coalesce("_open", F.lit(0)) > 0, 1.0).otherwise(0.0))
    return hit.groupBy(*run).agg(share.alias("exposure"))


def turnover(fills: DataFrame, keys: list[str], starting_equity: float) -> DataFrame:
    """Gross traded notional over the starting equity."""
    total = F.sum(F.abs("qty") * F.col("px"))
    value = total / F.lit(float(starting_equity)) if starting_equity else total * 0.0
    return fills.groupBy(*keys).agg(value.alias("turnover"))


def first_by_id(fills: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keep the first fill of each trade id.

    Aggregates on the map side first, so a trade id repeated a billion times
    costs one row per task.
    """
    whole = F.struct(*order, *[c for c in fills.columns if c not in order])
    return fills.groupBy(key).agg(F.min(whole).alias("_r")).select("_r.*").select(*fills.columns)


