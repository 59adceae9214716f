"""First-order recurrences ``y = (1-a)*y' + a*x`` over ordered series.

A step is affine in the state, so a chunk of a series can be filtered from a
zero state and corrected afterwards: ``y = local + (1-a)^(pos+1) * carry``.
Short series take one streamed pass over Arrow batches, filtered as arrays; long
ones are cut into chunks and the carry is folded over one row per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.operators.fold import Fold, fold_groups, in_order
from tidebook.operators.series import CHUNK, RN, Series
from tidebook.session import staged


def _double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


_BLOCK = 128


def _steps(x: np.ndarray, alpha: float, before: float) -> np.ndarray:
    """``y = y' + alpha * (x - y')`` along ``x``, by blocks of a triangular product."""
    k = np.arange(_BLOCK)
    lag = k[:, None] - k[None, :]
    weights = np.where(lag >= 0, alpha * (1.0 - alpha) ** np.maximum(lag, 0), 0.0)
    fade = (1.0 - alpha) ** (k + 1)
    blocks = np.zeros((-(-len(x) // _BLOCK), _BLOCK))
    blocks.ravel()[: len(x)] = x
    y = blocks @ weights.T
    for row in y:
        row += fade * before
        before = row[-1]
    return y.ravel()[: len(x)]


def _filtered(x: np.ndarray, known: np.ndarray, alpha: float, state: float | None):
    """Filter one stretch; nulls repeat the state, a null state is seeded by the first value."""
    values = x[known]
    if len(values) and state is None:
        y = np.concatenate((values[:1], _steps(values[1:], alpha, values[0])))
    else:
        y = _steps(values, alpha, state) if len(values) else values
    at = np.cumsum(known) - 1
    out = np.where(at >= 0, y[np.maximum(at, 0)], 0.0 if state is None else state) if len(y) else np.full(len(x), state or 0.0)
    empty = (at < 0) if state is None else np.zeros(len(x), bool)
    return out, empty, float(y[-1]) if len(y) else state


def _walk(group: list[str], columns: list[str], alphas: list[float], outs: list[str], fresh: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, states = None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for g in group:
                codes = batch.column(g).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            new[0] = True
            starts = np.flatnonzero(new)
            arrays = [batch.column(c).cast(pa.float64()) for c in columns]
            known = [a.is_valid().to_numpy(zero_copy_only=False) for a in arrays]
            values = [a.fill_null(0.0).to_numpy() for a in arrays]
            out = [np.zeros(n) for _ in outs]
            null = [np.zeros(n, bool) for _ in outs]
            for first, end in zip(starts, [*starts[1:], n]):
                key = tuple(batch.column(g)[int(first)].as_py() for g in group)
                if key != current:
                    current, states = key, [None if fresh else 0.0] * len(alphas)
                for i, alpha in enumerate(alphas):
                    part = slice(first, end)
                    out[i][part], null[i][part], states[i] = _filtered(
                        values[i][part], known[i][part], alpha, states[i]
                    )
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(y, mask=m) for y, m in zip(out, null)],
                names=[*keep, *outs],
            )

    return run


def _filter_groups(
    df: DataFrame,
    group: list[str],
    by: list[str],
    filters: list[tuple[str, str, float]],
    fresh: bool,
    keep: list[str],
) -> DataFrame:
    """(output, column, alpha) filters over each group in order, as arrays batch by batch.

    ``fresh`` groups are seeded with their first value, others start from zero.
    """
    outs, columns, alphas = (list(x) for x in zip(*filters))
    slim = df.select(*dict.fromkeys([*group, *by, *keep, *columns]))
    schema = T.StructType([*[slim.schema[c] for c in keep], *map(_double, outs)])
    return in_order(slim, group, by).mapInArrow(_walk(group, columns, alphas, outs, fresh, keep), schema)


def _carries(keep: float) -> Fold:
    """State in front of each chunk, from the chunks' local ends."""

    def apply(state, row):
        last, n = row
        before = state[0]
        state[0] = last + keep**n * before
        return (before,)

    return Fold(lambda: [0.0], apply, ("_last", "_n"), (_double("_carry"),))


def decay_filters(
    df: DataFrame, series: Series, filters: dict[str, tuple[str, float]]
) -> DataFrame:
    """Exponential filters ``{output: (column, alpha)}`` from one ordered pass.

    Each is seeded with the first value of its column, which may be null on
    leading (warm-up) rows only; the output is null there too.
    """
    by, keys = list(series.by), list(series.keys)
    if not series.is_split:
        wanted = [(out, column, alpha) for out, (column, alpha) in filters.items()]
        return _filter_groups(df, keys, by, wanted, True, df.columns)
    out = df
    for name, (column, alpha) in filters.items():
        out = _chunked_filter(out, series, column, name, alpha)
    return out


def _chunked_filter(df: DataFrame, series: Series, column: str, out: str, alpha: float):
    by, keys = list(series.by), list(series.keys)
    group = [*keys, CHUNK]
    parts = series.chunked_by(df, column)
    # The very first value enters whole: it is a seed, not a step from zero.
    x = F.when(F.col(RN) == 0, F.col(column) / alpha).otherwise(F.col(column))
    local = staged(
        _filter_groups(
            parts.withColumn("_x", x),
            group,
            by,
            [(out, "_x", alpha)],
            False,
            [*df.columns, RN, CHUNK],
        )
    )
    ends = local.where(F.col(CHUNK) >= 0).groupBy(*group).agg(
        F.max_by(out, RN).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
        F.min(RN).alias("_start"),
    )
    # One row per chunk of a series, i.e. rows / rows_per_block.
    carry = fold_groups(ends, keys, [CHUNK], _carries(1.0 - alpha), [*group, "_start"])
    steps = (F.col(RN) - F.col("_start") + 1).cast("double")
    value = F.col(out) + F.col("_carry") * F.pow(F.lit(1.0 - alpha), steps)
    joined = local.join(carry, group, "left")
    return joined.withColumn(out, value).select(*df.columns, out)


def decay_filter(df: DataFrame, series: Series, column: str, out: str, alpha: float):
    """One exponential filter, see ``decay_filters``."""
    return decay_filters(df, series, {out: (column, alpha)})
