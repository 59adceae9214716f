"""Pre-trade screening, margin checks, protections and account monitoring."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.brokerage import notional
from tidebook.functions.values import NANOS
from tidebook.operators.series import Series
from tidebook.session import staged

# Deny reasons in the order they are checked.
DENY_ORDER = (
    "expired",
    "kill_switch",
    "min_notional",
    "max_order_notional",
    "max_position",
    "max_gross_exposure",
    "insufficient_margin",
)


def deny_reason(orders: DataFrame) -> DataFrame:
    """Add ``reason``: the first rule an order fails, null when it passes.

    State columns: ``killed, ref_px, multiplier, position, gross, equity,
    expiry_ns``; limit columns (null = unlimited): ``min_notional,
    max_order_notional, max_position_qty, max_gross, leverage``.  Reducing
    orders always pass the margin rule.
    """
    delta = F.col("side") * F.col("qty")
    value = F.col("ref_px") * F.col("qty") * F.col("multiplier")
    after = F.abs(F.col("position") + delta)
    added = after - F.abs("position")
    need = F.try_divide(F.col("ref_px") * added * F.col("multiplier"), F.col("leverage"))
    free = F.col("equity") - F.try_divide(F.col("gross"), F.col("leverage"))
    rules: Mapping[str, Column] = {
        "kill_switch": F.col("killed"),
        "expired": F.col("ts_decision") >= F.col("expiry_ns"),
        "min_notional": value < F.col("min_notional"),
        "max_order_notional": value > F.col("max_order_notional"),
        "max_position": after > F.col("max_position_qty"),
        "max_gross_exposure": F.col("gross") > F.col("max_gross"),
        "insufficient_margin": (F.col("leverage") > 0) & (added > 0) & (need > free),
    }
    reason = F.coalesce(
        *[F.when(F.coalesce(rules[name], F.lit(False)), F.lit(name)) for name in DENY_ORDER]
    )
    return orders.withColumn("reason", reason)


def maintenance_breaches(states: DataFrame, rate: float) -> DataFrame:
    """First moment an account's equity is below ``rate`` of its gross exposure."""
    bad = (F.col("gross") > 0) & (F.col("equity") < F.col("gross") * F.lit(rate))
    return states.where(bad).groupBy("account").agg(
        F.min("ts").alias("ts"),
        F.min_by("equity", "ts").alias("equity"),
        F.min_by("gross", "ts").alias("gross"),
    )


def liquidation_fills(breaches: DataFrame, changes: DataFrame) -> DataFrame:
    """Closing fills for what a breached account holds at the breach, at the marks of then.

    ``changes``: account, symbol, ts, seq, the change of the position and the
    mark.  Only rows up to the breach count.
    """
    known = changes.join(
        breaches.select("account", F.col("ts").alias("_breach")), "account"
    ).where(F.col("ts") <= F.col("_breach"))
    held = known.groupBy("account", "symbol", F.col("_breach").alias("ts")).agg(
        F.sum("change").alias("net"), F.max_by("mark", F.struct("ts", "seq")).alias("mark")
    )
    return (
        held.where(F.col("net") != 0)
        .select(
            "account",
            "symbol",
            "ts",
            (-F.signum("net")).cast("long").alias("side"),
            F.abs("net").alias("qty"),
            F.col("mark").alias("px"),
        )
    )


def stoploss_guard(
    trades: DataFrame, series: Series, max_losses: int, window_s: int, cooldown_s: int
) -> DataFrame:
    """Trip when the losing trades of the trailing window reach ``max_losses``.

    The count at a trade is a difference of two running loss counts, looked
    up with an ordered pass, so no frame ever spans the rows of a busy window.
    Both read the counts of each time, which are few, from one staged table.
    """
    width = window_s * NANOS
    at = series.by[0]
    keys = list(series.keys)
    loss = (F.col("pnl") < 0).cast("long")
    run = series.running(trades, {"_upto": ("sum", loss)})
    # Trades sharing a timestamp all count for each other.
    per_ts = staged(run.groupBy(*keys, at).agg(F.max("_upto").alias("_upto")))
    edges = (
        per_ts.select(*keys, F.col(at).alias("_p"), F.lit(0).alias("_k"), F.col("_upto"))
        .unionByName(
            per_ts.select(
                *keys,
                (F.col(at) - F.lit(width)).alias("_p"),
                F.lit(-1).alias("_k"),
                F.lit(None).cast("long").alias("_upto"),
            )
        )
    )
    axis = Series.of(keys, ("_p", "_k"), series.cuts)
    seen = axis.running(edges, {"_old": ("last", F.col("_upto"))})
    starts = seen.where(F.col("_k") == -1).select(
        *keys, (F.col("_p") + F.lit(width)).alias(at), "_old"
    )
    losses = F.col("_upto") - F.coalesce("_old", F.lit(0))
    return (
        per_ts.join(starts, [*keys, at])
        .select(*keys, at, losses.alias("losses"))
        .withColumn("tripped", F.col("losses") >= max_losses)
        .withColumn(
            "until", F.when(F.col("tripped"), F.col(at) + F.lit(cooldown_s * NANOS))
        )
    )


def drawdown_guard(curve: DataFrame, series: Series, max_pct: float, cooldown_s: int):
    """Trip when the fall from the running peak reaches ``max_pct``."""
    at = series.by[0]
    peaked = series.running(curve, {"peak": ("max", F.col("equity"))})
    dd = F.try_divide(F.col("peak") - F.col("equity"), F.col("peak"))
    hit = (F.col("peak") > 0) & (dd >= max_pct)
    return peaked.withColumn("tripped", F.coalesce(hit, F.lit(False))).withColumn(
        "until", F.when(F.col("tripped"), F.col(at) + F.lit(cooldown_s * NANOS))
    )


def cooldown(verdicts: DataFrame, series: Series) -> DataFrame:
    """Add ``cooling``: an earlier trip's lockout still covers this row."""
    armed = series.running(
        verdicts, {"_armed": ("max", F.col("until"))}, include_current=False
    )
    return armed.withColumn(
        "cooling", F.coalesce(F.col(series.by[0]) < F.col("_armed"), F.lit(False))
    ).drop("_armed")


def should_halt(verdicts: DataFrame) -> DataFrame:
    """Add ``halt``: any protection tripped or cooling."""
    return verdicts.withColumn("halt", F.col("tripped") | F.col("cooling"))


TELEMETRY = ("equity", "gross_exposure", "net_exposure", "realized_pnl", "unrealized_pnl")


def account_state(telemetry: DataFrame, series: Series) -> DataFrame:
    """Sparse telemetry to full state: last known values, peak and day start.

    Unset fields are zero before their first value; the day starts with the
    first equity that is not zero.
    """
    run = series.running(
        telemetry,
        {
            **{f"_{c}": ("last", F.col(c)) for c in TELEMETRY},
            "_peak": ("max", F.col("equity")),
        },
    )
    start = F.when(F.col("equity") != 0, F.col("equity"))
    zero = F.lit(0.0)
    # The first non-zero equity is the earliest one seen so far.
    order = F.when(start.isNotNull(), F.struct(*series.by, F.col("equity")))
    run = series.running(run, {"_day": ("min", order)})
    return run.select(
        *series.keys,
        *series.by,
        *[F.coalesce(f"_{c}", zero).alias(c) for c in TELEMETRY],
        F.greatest(F.coalesce("_peak", zero), zero).alias("peak"),
        F.coalesce("_day.equity", zero).alias("day_start"),
    )


def account_breaches(
    states: DataFrame,
    max_drawdown_pct: float,
    max_gross: float,
    max_net: float,
    max_loss_of_day: float,
) -> DataFrame:
    """Add ``breaches``: (limit, observed, threshold) of every broken limit."""
    peak, eq = F.col("peak"), F.col("equity")
    dd = F.when(peak > 0, (peak - eq) / peak).otherwise(F.lit(0.0))
    loss = F.greatest(F.col("day_start") - eq, F.lit(0.0))
    rules = [
        ("max_drawdown", dd, max_drawdown_pct, (peak > 0) & (dd >= max_drawdown_pct)),
        ("gross_exposure", F.col("gross_exposure"), max_gross, F.col("gross_exposure") > max_gross),
        ("net_exposure", F.abs("net_exposure"), max_net, F.abs("net_exposure") > max_net),
        ("loss_of_day", loss, max_loss_of_day, loss > max_loss_of_day),
    ]
    entries = [
        F.when(
            broken,
            F.struct(
                F.lit(name).alias("limit"),
                seen.alias("observed"),
                F.lit(float(top)).alias("threshold"),
            ),
        )
        for name, seen, top, broken in rules
    ]
    return states.withColumn("breaches", F.filter(F.array(*entries), lambda b: b.isNotNull()))


def first_trip(breached: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The one control event of each account: its first row with a breach."""
    first = F.struct(*order)
    names = F.concat_ws(",", F.transform("breaches", lambda b: b["limit"]))
    return (
        breached.where(F.size("breaches") > 0)
        .groupBy(key)
        .agg(F.min(F.struct(first.alias("o"), names.alias("limits"))).alias("_f"))
        .select(key, *[F.col(f"_f.o.{c}").alias(c) for c in order], "_f.limits")
    )


def kill_switch(control: DataFrame, scope: list[str]) -> DataFrame:
    """First engagement per scope; releases and other kinds do not count."""
    return (
        control.where((F.col("kind") == "kill_switch") & F.col("engaged"))
        .groupBy(*scope)
        .agg(F.min("ts").alias("engaged_at"))
    )


def position_notional(px: Column, net: Column, mult: Column, inverse: Column) -> Column:
    """Absolute notional of a signed position."""
    return notional(px, F.abs(net), mult, inverse)


def predicate_guard(rows: DataFrame, series: Series, condition: Column, cooldown_s: int) -> DataFrame:
    """A protection from any condition: it trips on each row where that holds."""
    at = F.col(series.by[0])
    hit = F.coalesce(condition, F.lit(False))
    return rows.select(
        *series.keys, at, hit.alias("tripped"), F.when(hit, at + F.lit(cooldown_s * NANOS)).alias("until")
    )


def protections(guards: Mapping[str, DataFrame], series: Series) -> DataFrame:
    """All protections together: per key and time, who tripped and whether to halt.

    Every guard has the keys, the time, ``tripped`` and ``until``.  A time is
    halted while any guard's lockout, begun now or earlier, covers it.
    """
    at = series.by[0]
    parts = [
        g.select(*series.keys, at, F.lit(name).alias("guard"), "tripped", "until")
        for name, g in guards.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    armed = series.running(rows, {"_armed": ("max", F.col("until"))})
    names = F.array_sort(F.collect_set(F.when(F.col("tripped"), F.col("guard"))))
    return armed.groupBy(*series.keys, at).agg(
        names.alias("tripped_by"),
        F.coalesce(F.col(at) < F.max("_armed"), F.lit(False)).alias("halt"),
    )
