"""Order life cycle: event log, state fold, read views, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.operators.fold import Fold, fold_rows
from tidebook.operators.series import Series

# Statuses from which each event is legal.
LEGAL_FROM = {
    "Submitted": ("Initialized",),
    "Accepted": ("Submitted",),
    "PendingUpdate": ("Accepted", "PartiallyFilled"),
    "Updated": ("PendingUpdate",),
    "PendingCancel": ("Accepted", "PartiallyFilled", "PendingUpdate"),
    "PartiallyFilled": ("Accepted", "PartiallyFilled", "PendingUpdate"),
    "Filled": ("Accepted", "PartiallyFilled", "PendingUpdate"),
    "Denied": ("Initialized",),
    "Rejected": ("Submitted", "PendingUpdate"),
    "Canceled": ("Accepted", "PartiallyFilled", "PendingCancel"),
    "Expired": ("Accepted", "PartiallyFilled"),
}
# Statuses that never change again.
TERMINAL = ("Denied", "Filled", "Canceled", "Expired", "Rejected")


def is_terminal(status: Column) -> Column:
    """True for a finished order."""
    return status.isin(*TERMINAL)


def event_label(event: Column) -> Column:
    """Event name in snake case."""
    return F.lower(F.regexp_replace(event, "(?<!^)([A-Z])", "_$1"))


def event_reason(event: Column, reason: Column) -> Column:
    """Only denials and rejections carry a reason."""
    return F.when(event.isin("Denied", "Rejected"), reason)


def number_events(events: DataFrame, series: Series, existing: DataFrame | None = None):
    """Zero-based ``seq`` per order, continuing after what the log already holds."""
    numbered = series.number(events, "seq")
    if existing is None:
        return numbered
    keys = list(series.keys)
    top = existing.groupBy(*keys).agg((F.max("seq") + 1).alias("_base"))
    return (
        numbered.join(top, keys, "left")
        .withColumn("seq", F.col("seq") + F.coalesce("_base", F.lit(0)))
        .drop("_base")
    )


def replay(log: DataFrame, *, order_id=None, strategy=None) -> DataFrame:
    """Events of one order, or of all orders of a strategy, in (order, seq) order."""
    rows = log
    if order_id is not None:
        rows = rows.where(F.col("client_order_id") == order_id)
    if strategy is not None:
        rows = rows.where(F.col("strategy_id") == strategy)
    return rows.orderBy("client_order_id", "seq")


class OrderState:
    """Status, filled size and notional of one order."""

    __slots__ = ("status", "filled", "notional", "qty", "ignored")

    def __init__(self):
        self.status, self.filled, self.notional, self.qty, self.ignored = "", 0.0, 0.0, 0.0, 0

    def apply(self, event: str, order_qty, last_qty, last_px) -> bool:
        """Apply an event; an illegal one changes nothing and returns False."""
        if event == "Initialized":
            legal = not self.status
        else:
            legal = self.status in LEGAL_FROM.get(event, ())
        if not legal:
            self.ignored += 1
            return False
        if event == "Initialized":
            self.qty = order_qty or 0.0
        if event in ("PartiallyFilled", "Filled"):
            self.filled += last_qty
            self.notional += last_qty * last_px
            self.status = "Filled" if self.filled >= self.qty else "PartiallyFilled"
        elif event == "Updated":
            self.qty = order_qty or self.qty
            self.status = "PartiallyFilled" if self.filled > 0 else "Accepted"
        else:
            self.status = event
        return True

    def view(self) -> tuple:
        """(status, filled, leaves, average price, ignored events)."""
        avg = self.notional / self.filled if self.filled else None
        leaves = max(self.qty - self.filled, 0.0)
        return self.status, self.filled, leaves, avg, self.ignored


STATE_FIELDS = (
    T.StructField("status", T.StringType()),
    T.StructField("filled_qty", T.DoubleType()),
    T.StructField("leaves_qty", T.DoubleType()),
    T.StructField("avg_px", T.DoubleType()),
    T.StructField("ignored", T.LongType()),
)


def order_steps(events: DataFrame, series: Series) -> DataFrame:
    """Every event with ``accepted`` and the state after it.

    Needs ``event, order_qty, last_qty, last_px``; state is kept per series.
    """

    def apply(order: OrderState, row: tuple) -> tuple:
        ok = order.apply(*row)
        return (ok, *order.view())

    fold = Fold(
        OrderState,
        apply,
        ("event", "order_qty", "last_qty", "last_px"),
        (T.StructField("accepted", T.BooleanType()), *STATE_FIELDS),
    )
    keep = [*series.keys, *series.by, "event"]
    return fold_rows(events, series, fold, keep=keep)


def order_states(events: DataFrame, series: Series) -> DataFrame:
    """Final state of each order."""
    steps = order_steps(events, series)
    names = [f.name for f in STATE_FIELDS]
    row = F.max_by(F.struct(*names), F.struct(*series.by)).alias("_r")
    return steps.groupBy(*series.keys).agg(row).select(*series.keys, "_r.*")


def order_vwap(fills: DataFrame, key: str = "order_id") -> DataFrame:
    """Filled size, average price and leaves per order."""
    return fills.groupBy(key).agg(
        F.sum("qty").alias("filled_qty"),
        (F.sum(F.col("px") * F.col("qty")) / F.nullif(F.sum("qty"), F.lit(0.0))).alias("avg_px"),
    )


def fill_status(fills: DataFrame, series: Series) -> DataFrame:
    """Filled or PartiallyFilled after each fill, by what is left of ``order_qty``."""
    run = series.running(fills, {"_done": ("sum", F.col("qty"))})
    left = F.greatest(F.col("order_qty") - F.col("_done"), F.lit(0.0))
    return run.withColumn("leaves_qty", left).withColumn(
        "status", F.when(left == 0, "Filled").otherwise("PartiallyFilled")
    ).drop("_done")


def open_orders(states: DataFrame) -> DataFrame:
    """Orders that can still change."""
    return states.where(~is_terminal(F.col("status")))


def new_submissions(batch: DataFrame, known: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First submission of each id not seen before; repeats are no-ops."""
    whole = F.struct(*order, *[c for c in batch.columns if c not in order])
    first = batch.groupBy(key).agg(F.min(whole).alias("_r")).select("_r.*")
    return first.select(*batch.columns).join(known.select(key), key, "left_anti")


def reconcile_fills(
    local: DataFrame, venue: DataFrame, key: str = "trade_id", symbol: str = "symbol"
) -> tuple[DataFrame, DataFrame]:
    """Fills that one side lacks or that differ, and the positions they throw off.

    Both sides: ``key, symbol, side, qty, px``; repeats of a key are one fill.
    The first table has ``key, symbol, problem`` (``missing_fill``: only the venue
    has it, ``unknown_fill``: only the log has it, ``fill_mismatch``: both, with
    another side, quantity or price); the second ``symbol, local_net,
    venue_net`` where the nets differ.
    """
    values = ["side", "qty", "px"]

    def one(df: DataFrame, name: str) -> DataFrame:
        row = F.min(F.struct(symbol, *values)).alias(name)
        return df.groupBy(key).agg(row)

    both = one(local, "_l").join(one(venue, "_v"), key, "full_outer")
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(f"_l.{c}").eqNullSafe(F.col(f"_v.{c}"))
    problem = (
        F.when(F.col("_l").isNull(), "missing_fill").when(F.col("_v").isNull(), "unknown_fill").when(differs, "fill_mismatch")
    )
    named = F.coalesce(f"_v.{symbol}", f"_l.{symbol}").alias(symbol)
    fills = both.select(key, named, problem.alias("problem")).where("problem is not null")

    def net(name: str) -> Column:
        return F.coalesce(F.sum(F.col(f"{name}.side") * F.col(f"{name}.qty")), F.lit(0.0))

    nets = both.select(named, "_l", "_v").groupBy(symbol).agg(net("_l").alias("local_net"), net("_v").alias("venue_net"))
    return fills, nets.where(F.col("local_net") != F.col("venue_net"))


def reconcile(local: DataFrame, venue: DataFrame, key: str = "client_order_id") -> DataFrame:
    """Orders known to one side only."""
    a = local.select(key).distinct().withColumn("_local", F.lit(True))
    b = venue.select(key).distinct().withColumn("_venue", F.lit(True))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("_local").isNull(), "orphan_order").when(
        F.col("_venue").isNull(), "missing_at_venue"
    )
    return both.select(key, kind.alias("problem")).where(F.col("problem").isNotNull())
