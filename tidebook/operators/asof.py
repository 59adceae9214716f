"""As-of joins as one tagged union and one ordered pass per direction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.operators.series import Cuts, Series

_AT, _PRIO, _TIE, _L, _R = "_at", "_prio", "_tie", "_left", "_right"
#: Left rows follow all right rows of their position: their ties begin here, those of right rows stay below.
_LEFT = 1 << 62


def _tagged(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    right_values: Sequence[str],
    right_tie: str | None,
    spread: bool,
) -> DataFrame:
    l_type = left.schema.simpleString()
    value = F.struct(F.col(right_at).alias("at"), *[F.col(v).alias(v) for v in right_values])
    r = right.select(
        *keys,
        F.col(right_at).alias(_AT),
        F.lit(0).alias(_PRIO),
        (F.col(right_tie).cast("long") if right_tie else F.lit(0).cast("long")).alias(_TIE),
        F.lit(None).cast(l_type).alias(_L),
        value.alias(_R),
    )
    r_type = r.schema[_R].dataType
    l_ = left.select(
        *keys,
        F.col(left_at).alias(_AT),
        F.lit(1).alias(_PRIO),
        (F.lit(_LEFT) + (F.shiftrightunsigned(F.xxhash64(*left.columns), 3) if spread else F.lit(0))).cast("long").alias(_TIE),
        F.struct(*[F.col(c) for c in left.columns]).alias(_L),
        F.lit(None).cast(r_type).alias(_R),
    )
    return l_.unionByName(r)


def _tie_cuts(cuts: Cuts | None) -> Cuts | None:
    """The cuts of crowded positions, along the order inside a position.

    Right rows come first, in the order of their tie, then the left rows, which
    take any order and are cut into as many parts.
    """
    if not cuts:
        return cuts
    ties = tuple(
        (*key, [*points, *(_LEFT + (_LEFT // 2) * j // (len(points) + 1) for j in range(len(points) + 1))])
        for *key, points in cuts.ties
    )
    return replace(cuts, tie=_TIE, ties=ties)


#: Order of the kinds of events that set a mark at the same time; the last one holds.
MARK_KINDS = {"quote": 0, "trade": 1, "bar": 2}
_KIND_BITS = 56


def mark_events(
    trades: DataFrame | None = None, quotes: DataFrame | None = None, bars: DataFrame | None = None
) -> DataFrame:
    """``symbol, ts, mark, tie`` of all events that set a mark: a trade's price, a quote's mid, a bar's close.

    ``tie`` orders events of one time by kind and then by ``seq``.
    """

    def of(df: DataFrame, kind: str, ts: str, mark: Column, seq: Column) -> DataFrame:
        tie = F.lit(MARK_KINDS[kind] << _KIND_BITS) + seq.cast("long")
        return df.select("symbol", F.col(ts).alias("ts"), mark.cast("double").alias("mark"), tie.alias("tie"))

    parts = []
    if trades is not None:
        parts.append(of(trades, "trade", "ts", F.col("price"), F.col("seq")))
    if quotes is not None:
        parts.append(of(quotes, "quote", "ts", (F.col("bid") + F.col("ask")) / 2, F.col("seq")))
    if bars is not None:
        parts.append(of(bars, "bar", "ts_event", F.col("close"), F.lit(0)))
    return reduce(DataFrame.unionByName, parts)


def asof_mark(left: DataFrame, events: DataFrame, *, left_at: str, name: str = "mark", cuts: Cuts | None = None) -> DataFrame:
    """``left`` with the mark its symbol had: that of the last of ``mark_events`` at or before ``left_at``."""
    return asof(left, events, "symbol", left_at=left_at, right_at="ts", values={name: "mark"}, right_tie="tie", cuts=cuts)


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    *,
    left_at: str,
    right_at: str,
    values: dict[str, str],
    direction: str = "backward",
    right_tie: str | None = None,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Attach to each left row the right row that is nearest in ``direction``.

    * ``backward``: latest right row at or before the left row;
    * ``forward``: first right row strictly after it;
    * ``nearest``: the closer of the two, the earlier one on a tie.

    ``values`` maps output names to right columns.  The right row's own
    position is available as the pseudo column ``"@at"``.

    Pass ``cuts`` measured on the longer table when a key may be long; without
    them each key is one window partition.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    wanted = sorted({c for c in values.values() if c != "@at"})
    both = _tagged(left, right, keys, left_at, right_at, wanted, right_tie, bool(cuts and cuts.ties))
    series = Series.of(keys, (_AT, _TIE), _tie_cuts(cuts))
    if direction in ("backward", "nearest"):
        both = series.running(both, {"_prev": ("last", F.col(_R))})
    if direction in ("forward", "nearest"):
        both = series.running(both, {"_next": ("last", F.col(_R))}, reverse=True)
    rows = both.where(F.col(_PRIO) == 1)
    if direction == "backward":
        pick: Column = F.col("_prev")
    elif direction == "forward":
        pick = F.col("_next")
    elif direction == "nearest":
        back = F.col(_AT) - F.col("_prev.at")
        ahead = F.col("_next.at") - F.col(_AT)
        pick = F.when(
            F.col("_prev").isNull() | (ahead < back), F.coalesce("_next", "_prev")
        ).otherwise(F.col("_prev"))
    else:
        raise ValueError(f"unknown as-of direction {direction!r}")
    picked = rows.select(F.col(_L), pick.alias("_hit"))
    return picked.select(
        f"{_L}.*",
        *[F.col("_hit.at" if c == "@at" else f"_hit.{c}").alias(n) for n, c in values.items()],
    )
