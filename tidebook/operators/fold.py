"""Sequential folds over ordered series, streamed through their tasks.

Some rules are order-dependent by definition (an average price rounded at
every step, a book after every delta).  A fold hash-partitions the rows by
series, sorts them inside the partitions and walks the Arrow batches with one
state per series, so a task holds a batch and a state, never a whole series.
Rows that reset the state mark where a long series may be split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidebook.functions.values import int_div
from tidebook.operators.series import RN, Series

_AT = "_s_at"


@dataclass(frozen=True)
class Fold:
    """``apply(state, row)`` changes the state and returns the output values.

    ``row`` holds the ``inputs`` columns in order, nulls as None.  Where there is
    ``apply_run``, it is called instead, with the state and the ``inputs`` of
    consecutive rows of a group as numpy arrays, and returns arrays.
    """

    start: Callable[[], object]
    apply: Callable[[object, tuple], tuple]
    inputs: tuple[str, ...]
    outputs: tuple[T.StructField, ...]
    apply_run: Callable[..., tuple] | None = None


def _runs(batch: pa.RecordBatch, group: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, start, end) of the runs of rows of one group."""
    if not batch.num_rows:
        return
    changes = np.zeros(batch.num_rows - 1, dtype=bool)
    for g in group:
        codes = batch.column(g).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        changes |= codes[1:] != codes[:-1]
    edges = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
    keys = zip(*[batch.column(g).take(pa.array(edges[:-1])).to_pylist() for g in group])
    yield from zip(keys, edges, edges[1:])


def _walk(fold: Fold, group: list[str], keep: list[str]):
    types = [to_arrow_type(f.dataType) for f in fold.outputs]
    names = [*keep, *[f.name for f in fold.outputs]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            rows = zip(*[batch.column(c).to_pylist() for c in fold.inputs])
            for key, start, end in _runs(batch, group):
                if key != current:
                    current, state = key, fold.start()
                out += [fold.apply(state, row) for row in islice(rows, end - start)]
            columns = zip(*out) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(list(c), t) for c, t in zip(columns, types)],
                names=names,
            )

    def run_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in fold.inputs]
            out = []
            for key, start, end in _runs(batch, group):
                if key != current:
                    current, state = key, fold.start()
                out.append(fold.apply_run(state, *[a[start:end] for a in arrays]))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(c, t) for c, t in zip(columns, types)], names=names
            )

    return run_of_runs if fold.apply_run else run


def in_order(df: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """``df`` with the rows of a group in one partition, one after the other, and their number.

    The window asks for that.  After ``repartition`` alone Spark may drop the
    shuffle behind a join on the same columns and then read the join's input
    by mapper, once it has turned into a broadcast: groups come in pieces.
    """
    return df.withColumn(_AT, F.row_number().over(Window.partitionBy(*group).orderBy(*by)))


def fold_groups(
    df: DataFrame, group: list[str], by: list[str], fold: Fold, keep: list[str] | None = None
) -> DataFrame:
    """Run ``fold`` over each group in order; returns ``keep`` plus its outputs."""
    keep = list(dict.fromkeys(keep or [*group, *by]))
    slim = df.select(*dict.fromkeys([*group, *by, *keep, *fold.inputs]))
    schema = T.StructType([*[slim.schema[c] for c in keep], *fold.outputs])
    return in_order(slim, group, by).mapInArrow(_walk(fold, group, keep), schema)


def reduce_groups(
    df: DataFrame,
    group: list[str],
    by: list[str],
    start: Callable[[], object],
    inputs: tuple[str, ...],
    outputs: tuple[T.StructField, ...],
) -> DataFrame:
    """One row for each group: ``group`` and what ``start()`` gives after all rows, in order.

    The state has ``take(*arrays)``, called with the ``inputs`` of consecutive
    rows as numpy arrays, and ``result()``, the output values.
    """
    slim = df.select(*dict.fromkeys([*group, *by, *inputs]))
    schema = T.StructType([*[slim.schema[c] for c in group], *outputs])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in inputs]
            done = []
            for key, start_at, end in _runs(batch, group):
                if key != current:
                    if state is not None:
                        done.append((*current, *state.result()))
                    current, state = key, start()
                state.take(*[a[start_at:end] for a in arrays])
            yield _batch(done)
        if state is not None:
            yield _batch([(*current, *state.result())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[] for _ in types]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=schema.names)

    return in_order(slim, group, by).select(*dict.fromkeys([*group, *inputs]), _AT).mapInArrow(run, schema)


def fold_rows(
    df: DataFrame,
    series: Series,
    fold: Fold,
    restart: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Run ``fold`` over each series.

    ``restart`` names a boolean column: on a marked row the state does not
    depend on earlier rows.  A long series is split there into sets of
    consecutive stretches that run in parallel; ``fold`` must give the same
    result from a fresh state.
    """
    by, keys = list(series.by), list(series.keys)
    keep = keep or [*keys, *by]
    if not (series.is_split and restart):
        return fold_groups(df, keys, by, fold, keep)
    rows = series.number(df)
    rows = series.running(rows, {"_s_from": ("last", F.when(F.col(restart), F.col(RN)))})
    start = F.coalesce("_s_from", F.lit(0).cast("long"))
    rows = rows.withColumn("_s_set", int_div(start, series.rows_per_block))
    return fold_groups(rows, [*keys, "_s_set"], by, fold, keep)
