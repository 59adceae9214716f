"""Order books from delta streams, and continuity of update ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.operators.fold import Fold, fold_rows
from tidebook.operators.series import Series


def mark_stale(deltas: DataFrame, series: Series) -> DataFrame:
    """Add ``epoch`` (number of clears so far) and ``stale``.

    A clear always applies and re-bases the sequence.  Any other row is stale
    when its sequence is below the highest one before it in its epoch.
    """
    clear = F.col("action") == "Clear"
    epochs = series.running(deltas, {"epoch": ("sum", clear.cast("long"))})
    # Epochs only grow, so the running maximum of (epoch, sequence) restarts
    # with each clear and no second partitioning by epoch is needed.
    tops = series.running(
        epochs,
        {"_top": ("max", F.struct("epoch", "sequence"))},
        include_current=False,
    )
    behind = (F.col("_top.epoch") == F.col("epoch")) & (F.col("sequence") < F.col("_top.sequence"))
    return tops.withColumn("stale", ~clear & F.coalesce(behind, F.lit(False))).drop("_top")


def book_at(deltas: DataFrame, series: Series, until: int | None = None) -> DataFrame:
    """Live levels after the last delta at or before ``until`` (default: all)."""
    rows = deltas if until is None else deltas.where(F.col(series.by[0]) <= until)
    marked = mark_stale(rows, series).where(~F.col("stale"))
    keys = list(series.keys)
    order = F.struct(*series.by)
    last_epoch = rows.groupBy(*keys).agg(
        F.coalesce(F.sum((F.col("action") == "Clear").cast("long")), F.lit(0)).alias("epoch")
    )
    live = (F.col("_last.action") != "Delete") & (F.col("_last.size") > 0)
    levels = (
        marked.where(F.col("action") != "Clear")
        .groupBy(*keys, "epoch", "side", "price")
        .agg(F.max_by(F.struct("action", "size"), order).alias("_last"))
    )
    return (
        levels.join(last_epoch, [*keys, "epoch"], "left_semi")
        .where(live)
        .select(*keys, "side", "price", F.col("_last.size").alias("size"))
    )


def top_of_book(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Best prices, sizes, spread and mid; spread and mid need both sides."""
    bid, ask = F.col("side") > 0, F.col("side") < 0
    agg = levels.groupBy(*keys).agg(
        F.max(F.when(bid, F.struct("price", "size"))).alias("_b"),
        F.min(F.when(ask, F.struct("price", "size"))).alias("_a"),
        F.count_if(bid).alias("bid_levels"),
        F.count_if(ask).alias("ask_levels"),
    )
    return agg.select(
        *keys,
        F.col("_b.price").alias("bid"),
        F.col("_b.size").alias("bid_size"),
        F.col("_a.price").alias("ask"),
        F.col("_a.size").alias("ask_size"),
        (F.col("_a.price") - F.col("_b.price")).alias("spread"),
        ((F.col("_a.price") + F.col("_b.price")) / 2).alias("mid"),
        "bid_levels",
        "ask_levels",
    )


def depth(levels: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best ``k`` levels of each side, bids falling and asks rising."""
    rank_price = F.when(F.col("side") > 0, -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy(*keys, "side").orderBy(rank_price)
    return (
        levels.withColumn("level", F.row_number().over(w).cast("long"))
        .where(F.col("level") <= k)
        .select(*keys, "side", "level", "price", "size")
    )


def quotes_from_top(top: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Quote rows of a top-of-book series that has both sides."""
    return top.where(F.col("bid").isNotNull() & F.col("ask").isNotNull()).select(
        *keys, ts, "bid", "ask", "bid_size", "ask_size"
    )


class Book:
    """Levels of one book; ``apply`` returns False for a stale delta."""

    __slots__ = ("sides", "last")

    def __init__(self):
        self.sides = {1: {}, -1: {}}
        self.last = None

    def apply(self, action: str, side: int, price, size, sequence) -> bool:
        if action == "Clear":
            self.sides = {1: {}, -1: {}}
            self.last = sequence
            return True
        if self.last is not None and sequence < self.last:
            return False
        self.last = sequence
        book = self.sides[1 if side > 0 else -1]
        if action == "Delete" or size <= 0:
            book.pop(price, None)
        else:
            book[price] = size
        return True

    def top(self):
        bids, asks = self.sides[1], self.sides[-1]
        b = max(bids) if bids else None
        a = min(asks) if asks else None
        return (
            None if b is None else float(b),
            None if b is None else float(bids[b]),
            None if a is None else float(a),
            None if a is None else float(asks[a]),
            len(bids) + len(asks),
        )


BOOK_FIELDS = (
    T.StructField("applied", T.BooleanType()),
    T.StructField("bid", T.DoubleType()),
    T.StructField("bid_size", T.DoubleType()),
    T.StructField("ask", T.DoubleType()),
    T.StructField("ask_size", T.DoubleType()),
    T.StructField("levels", T.LongType()),
)


def book_series(deltas: DataFrame, series: Series) -> DataFrame:
    """Top of book after every delta.

    A clear empties the book, so the stretches between clears are independent
    once a series is long enough to be cut.
    """

    def apply(book: Book, row: tuple) -> tuple:
        return (book.apply(*row), *book.top())

    fold = Fold(Book, apply, ("action", "side", "price", "size", "sequence"), BOOK_FIELDS)
    marked = deltas.withColumn("_clear", F.col("action") == "Clear")
    return fold_rows(marked, series, fold, restart="_clear")


def diff_continuity(diffs: DataFrame, series: Series) -> DataFrame:
    """Check each diff against the one before it in a pure diff stream.

    Adds ``verdict``: ``first``, ``skipped`` (nothing new), ``applied`` or
    ``gap``.  ``prev_id`` is used when the venue sends it, else the first id
    must follow the last one directly.
    """
    tops = series.running(
        diffs, {"_last": ("max", F.col("last_id"))}, include_current=False
    )
    follows = F.when(F.col("prev_id").isNotNull(), F.col("prev_id") == F.col("_last")).otherwise(
        F.col("first_id") == F.col("_last") + 1
    )
    return tops.withColumn(
        "verdict",
        F.when(F.col("_last").isNull(), "first")
        .when(F.col("last_id") <= F.col("_last"), "skipped")
        .when(follows, "applied")
        .otherwise("gap"),
    ).drop("_last")


class Continuity:
    """Update-id state of one book: synced after a diff bridges the snapshot."""

    __slots__ = ("last", "synced")

    def __init__(self, last: int = 0, synced: bool = False):
        self.last, self.synced = last, synced

    def snapshot(self, last_id: int) -> None:
        self.last, self.synced = last_id, False

    def diff(self, first: int, last: int, prev: int | None) -> str:
        """``applied``, ``skipped`` or ``resync``."""
        if last <= self.last:
            return "skipped"
        if self.synced:
            ok = prev == self.last if prev is not None else first == self.last + 1
        else:
            ok = first <= self.last + 1 <= last
        if not ok:
            self.synced = False
            return "resync"
        self.last, self.synced = last, True
        return "applied"


def snapshot_continuity(messages: DataFrame, series: Series) -> DataFrame:
    """Outcome of every snapshot and diff of a book in arrival order.

    ``kind`` is ``snapshot`` or ``diff``; ids in ``first_id, last_id, prev_id``.
    A snapshot resets the state, so stretches between snapshots are
    independent.
    """

    def apply(c: Continuity, row: tuple) -> tuple:
        kind, first, last, prev = row
        if kind == "snapshot":
            c.snapshot(last)
            return "snapshot", c.last
        return c.diff(first, last, prev), c.last

    fold = Fold(
        Continuity,
        apply,
        ("kind", "first_id", "last_id", "prev_id"),
        (
            T.StructField("outcome", T.StringType()),
            T.StructField("book_last_id", T.LongType()),
        ),
    )
    marked = messages.withColumn("_snap", F.col("kind") == "snapshot")
    return fold_rows(marked, series, fold, restart="_snap")
