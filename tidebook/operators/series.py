"""Ordered per-key operators that never need a whole series in one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.
That is the best plan while series are short, and no plan at all when one
symbol holds a third of the data.  ``Series`` therefore knows the *cuts* of
the long keys: positions on the order axis that split a key into blocks of
about ``rows_per_block`` rows.

* prefix aggregates run inside (key, block) and add the carry of the earlier
  blocks, taken from a table with one row per block;
* frames with a bounded reach run inside chunks of consecutive row numbers,
  with the rows a neighbour needs copied over (and dropped afterwards).

With no long key both fall back to the plain window, i.e. one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.values import int_div
from tidebook.session import is_scan, staged

ROWS_PER_BLOCK = 2_000_000
#: Cuts in a table that is broadcast; a larger table is joined by a shuffle.
BROADCAST_CUTS = 200_000
_TIES = 1 << 32
_FIRST = -(1 << 63)
#: Cuts of a key that its rows may carry; more are searched.
_FAN = 64

# Helper columns; callers never see them, nor should they use these names.
_BLK, _POINTS = "_s_blk", "_s_points"
RN, CHUNK = "_s_rn", "_s_chunk"


@dataclass(frozen=True)
class Cuts:
    """Block boundaries of the long keys, about one for each ``rows_per_block`` rows."""

    keys: tuple[str, ...]
    rows_per_block: int = ROWS_PER_BLOCK
    table: tuple = ()  # rows of (key values..., sorted cut positions)
    key_types: tuple = field(default=())
    tie: str | None = None
    ties: tuple = ()  # rows of (key values..., position, cuts along ``tie``)

    def __bool__(self) -> bool:
        return bool(self.table)

    def rename(self, *keys: str) -> Cuts:
        """The same cuts for a table that names the key columns differently."""
        return replace(self, keys=tuple(keys))


def measure_cuts(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    rows_per_block: int = ROWS_PER_BLOCK,
    tie: str | None = None,
) -> Cuts:
    """Find the keys longer than a block and where to cut them along ``at``.

    Reads only the key and order columns.  One position for each block reaches
    the driver: a millionth of the rows.  With ``tie``, the second order column
    (a long), a single position that holds more than two blocks is cut along
    it as well.
    """
    keys = tuple(keys)
    types = tuple(df.schema[k].dataType for k in keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total, longest = counts.agg(F.sum("n"), F.max("n")).first()
    if not total or longest <= rows_per_block:
        return Cuts(keys, rows_per_block, (), types)
    size = rows_per_block
    few = total // size <= BROADCAST_CUTS  # long keys and crowded positions hold a block or more
    hint = F.broadcast if few else lambda small: small
    long_keys = counts.where(F.col("n") > size).select(*keys)
    long_rows = df.join(hint(long_keys), list(keys), "left_semi")
    points = max(2, -(-longest // size))
    cuts = {tuple(k): set(q) for *k, q in _quantiles(long_rows, keys, at, size, points)}
    ties = ()
    if tie is not None:
        crowded = long_rows.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("n"))
        crowded = crowded.where(F.col("n") > 2 * size).select(*keys, at)
        rows = long_rows.join(hint(crowded), [*keys, at], "left_semi")
        ties = tuple(_quantiles(rows, (*keys, at), tie, size, points))
        for *key, position, _ in ties:
            # A crowded position gets blocks of its own.
            cuts.setdefault(tuple(key), set()).update((position, position + 1))
    table = tuple((*k, sorted(q)) for k, q in cuts.items())
    return Cuts(keys, size, table, types, tie, ties)


def _quantiles(df: DataFrame, keys: Sequence[str], at: str, size: int, points: int) -> list[tuple]:
    """Per key, positions along ``at`` that split its rows into parts of ``size``."""
    probs = [i / points for i in range(1, points)]
    parts = F.ceil(F.col("n") / F.lit(size)).cast("int")

    def pick(j: Column) -> Column:
        k = (j * points / F.col("parts")).cast("int")
        return F.element_at("q", F.greatest(F.lit(1), F.least(F.lit(len(probs)), k)))

    steps = F.sequence(F.lit(1), F.greatest(F.col("parts") - 1, F.lit(1)))
    picked = (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx(F.col(at), probs, 10 * points).alias("q"),
        )
        .withColumn("parts", parts)
        .select(*keys, F.array_sort(F.array_distinct(F.transform(steps, pick))).alias("cuts"))
    )
    return [tuple(r) for r in picked.collect()]


def _small(table: DataFrame, cuts: int) -> DataFrame:
    """Hint a broadcast where the number of cuts allows it."""
    return F.broadcast(table) if cuts <= BROADCAST_CUTS else table


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(local + carry, local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "min":
        return F.least(local, carry)
    if kind == "last":
        return F.coalesce(local, carry)
    raise ValueError(f"unknown running aggregate {kind!r}")


def _aggregate(kind: str, col: Column) -> Column:
    if kind == "sum":
        return F.sum(col)
    if kind == "count":
        return F.count(col)
    if kind == "max":
        return F.max(col)
    if kind == "min":
        return F.min(col)
    if kind == "last":
        return F.last(col, ignorenulls=True)
    raise ValueError(f"unknown running aggregate {kind!r}")


@dataclass(frozen=True)
class Series:
    """Rows grouped by ``keys`` and ordered by ``by`` (``by[0]`` is a long)."""

    keys: tuple[str, ...]
    by: tuple[str, ...]
    cuts: Cuts | None = None

    @classmethod
    def of(cls, keys, by, cuts: Cuts | None = None) -> Series:
        as_tuple = lambda x: (x,) if isinstance(x, str) else tuple(x)
        keys = as_tuple(keys)
        if cuts is not None and cuts.keys != keys:
            cuts = cuts.rename(*keys)
        return cls(keys, as_tuple(by), cuts)

    @property
    def is_split(self) -> bool:
        return bool(self.cuts)

    @property
    def rows_per_block(self) -> int:
        return self.cuts.rows_per_block if self.cuts else ROWS_PER_BLOCK

    def ordered_by(self, *by: str) -> Series:
        return replace(self, by=tuple(by))

    def within(self, *extra: str) -> Series:
        """The same series, further split by columns that are cut-independent.

        The cuts stay attached to the original keys, so blocks of a long key
        are still blocks after a parameter or run column joins the key.
        """
        return replace(self, keys=(*self.keys, *extra))

    def _order(self, reverse: bool) -> list[Column]:
        return [F.col(c).desc() if reverse else F.col(c).asc() for c in self.by]

    def window(self, reverse: bool = False):
        return Window.partitionBy(*self.keys).orderBy(*self._order(reverse))

    def _with_block(self, df: DataFrame) -> DataFrame:
        cuts = self.cuts
        tied = bool(cuts.ties) and self.by[1:2] == (cuts.tie,)
        if tied or max(len(row[-1]) for row in cuts.table) > _FAN:
            return self._search_block(df, tied)
        schema = T.StructType(
            [T.StructField(k, t) for k, t in zip(cuts.keys, cuts.key_types)]
            + [T.StructField(_POINTS, T.ArrayType(T.LongType()))]
        )
        rows = [(*key, list(points)) for *key, points in cuts.table]
        table = _small(df.sparkSession.createDataFrame(rows, schema), sum(len(r[-1]) for r in rows))
        at = F.col(self.by[0])
        block = F.when(F.col(_POINTS).isNull(), F.lit(-1)).otherwise(
            F.size(F.filter(F.col(_POINTS), lambda c: c <= at))
        )
        return (
            df.join(table, list(cuts.keys), "left").withColumn(_BLK, block.cast("long")).drop(_POINTS)
        )

    def _search_block(self, df: DataFrame, tied: bool) -> DataFrame:
        """Blocks by binary search, for keys of many cuts: a row never carries the cuts of its key."""
        cuts, ties = self.cuts, {}
        points = {tuple(key): np.array(at, dtype=np.int64) for *key, at in cuts.table}
        for *key, position, at in cuts.ties if tied else ():
            ties.setdefault(tuple(key), {})[position] = np.array(at, dtype=np.int64)
        known = df.sparkSession.sparkContext.broadcast((points, ties))
        n = len(cuts.keys)

        def search(*columns: pa.Array) -> pa.Array:
            points, ties = known.value
            at, *tie = [c.fill_null(_FIRST).to_numpy(zero_copy_only=False) for c in columns[n:]]
            blocks = np.full(len(at), -1, dtype=np.int64)
            codes = np.zeros(len(at), dtype=np.int64)
            for column in columns[:n]:
                one = column.dictionary_encode("encode")
                codes = codes * (len(one.dictionary) + 1) + one.indices.to_numpy(zero_copy_only=False)
                codes = np.unique(codes, return_inverse=True)[1]
            order = np.argsort(codes, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else ():
                key = tuple(c[int(rows[0])].as_py() for c in columns[:n])
                if key not in points:
                    continue
                found = np.searchsorted(points[key], at[rows], side="right")
                if tied:
                    found = found * _TIES
                    crowded = ties.get(key, {})
                    for position in np.unique(at[rows]).tolist() if crowded else ():
                        if position in crowded:
                            here = at[rows] == position
                            found[here] += np.searchsorted(crowded[position], tie[0][rows[here]], side="right")
                blocks[rows] = found
            return pa.array(blocks)

        block = F.arrow_udf(search, "long")
        return df.withColumn(_BLK, block(*cuts.keys, *self.by[: 2 if tied else 1]))

    def running(
        self,
        df: DataFrame,
        aggs: Mapping[str, tuple[str, Column]],
        *,
        include_current: bool = True,
        reverse: bool = False,
    ) -> DataFrame:
        """Prefix aggregates: ``{name: ("sum"|"count"|"max"|"min"|"last", column)}``.

        ``reverse`` walks the series backwards (suffix aggregates).
        """
        upto = Window.currentRow if include_current else -1
        if not self.is_split:
            w = self.window(reverse).rowsBetween(Window.unboundedPreceding, upto)
            out = df.withColumns({n: _aggregate(k, c).over(w) for n, (k, c) in aggs.items()})
            return _zero_counts(out, aggs)
        # Both the blocks and their totals read the input: stage derived rows.
        b = self._with_block(df if is_scan(df) else staged(df))
        group = [*self.keys, _BLK]
        w = (
            Window.partitionBy(*group)
            .orderBy(*self._order(reverse))
            .rowsBetween(Window.unboundedPreceding, upto)
        )
        local = b.withColumns({f"_l_{n}": _aggregate(k, c).over(w) for n, (k, c) in aggs.items()})
        edge = F.struct(*[F.col(c) for c in self.by])
        pick_last = F.min_by if reverse else F.max_by

        def whole(kind: str, col: Column) -> Column:
            if kind == "last":
                return pick_last(col, F.when(col.isNotNull(), edge))
            return _aggregate(kind, col)

        blocks = (
            b.where(F.col(_BLK) >= 0)
            .groupBy(*group)
            .agg(*[whole(k, c).alias(f"_t_{n}") for n, (k, c) in aggs.items()])
        )
        order = F.col(_BLK).desc() if reverse else F.col(_BLK).asc()
        before = (
            Window.partitionBy(*self.keys)
            .orderBy(order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = blocks.select(
            *group,
            *[
                _aggregate("sum" if k == "count" else k, F.col(f"_t_{n}"))
                .over(before)
                .alias(f"_c_{n}")
                for n, (k, _) in aggs.items()
            ],
        )
        joined = local.join(carry, group, "left")
        out = joined.withColumns(
            {
                n: _combine(k, F.col(f"_l_{n}"), F.col(f"_c_{n}"))
                for n, (k, _) in aggs.items()
            }
        ).drop(*[f"{p}{n}" for n in aggs for p in ("_l_", "_c_")], _BLK)
        return _zero_counts(out, aggs)

    def number(self, df: DataFrame, name: str = RN) -> DataFrame:
        """Zero-based position of each row in its series."""
        out = self.running(df, {name: ("count", F.lit(1))})
        return out.withColumn(name, F.col(name) - 1)

    def frames(
        self,
        df: DataFrame,
        build: Callable[[object], Mapping[str, Column]],
        *,
        before: int = 0,
        after: int = 0,
    ) -> DataFrame:
        """Window columns that look at most ``before`` rows back, ``after`` ahead.

        ``build`` gets an ordered window spec and returns named columns.
        """
        if not self.is_split:
            return df.withColumns(dict(build(self.window())))
        size = max(self.rows_per_block, 2 * (before + after) + 1)
        home = int_div(F.col(RN), size)
        first = int_div(F.greatest(F.col(RN) - after, F.lit(0).cast("long")), size)
        last = int_div(F.col(RN) + before, size)
        spread = self.number(df).withColumn(CHUNK, F.explode(F.sequence(first, last)))
        w = Window.partitionBy(*self.keys, CHUNK).orderBy(*self._order(False))
        return (
            spread.withColumns(dict(build(w)))
            .where(F.col(CHUNK) == home)
            .drop(CHUNK, RN)
        )

    def chunked_by(self, df: DataFrame, column: str) -> DataFrame:
        """Add ``RN`` and ``CHUNK``: runs of consecutive rows with a value in ``column``.

        Rows before the first value get position and chunk -1.
        """
        counted = self.running(df, {RN: ("count", F.col(column))})
        return counted.withColumn(RN, F.col(RN) - 1).withColumn(
            CHUNK, int_div(F.col(RN), self.rows_per_block)
        )


def _zero_counts(df: DataFrame, aggs: Mapping[str, tuple[str, Column]]) -> DataFrame:
    fixed = {
        n: F.coalesce(F.col(n), F.lit(0).cast("bigint"))
        for n, (k, _) in aggs.items()
        if k == "count"
    }
    return df.withColumns(fixed) if fixed else df
