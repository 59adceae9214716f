"""Band joins: intervals against points, as an equi-join on time buckets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.values import int_div


def band_join(
    intervals: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    *,
    start: str,
    end: str,
    at: str,
    bucket_ns: int,
) -> DataFrame:
    """Pairs with equal keys and ``start < at <= end``.

    An interval is copied to each bucket it touches, a point lives in one.
    Pick ``bucket_ns`` near the usual interval length: the copies per interval
    are ``length / bucket_ns + 1``.
    """
    keys = list(keys)
    spread = _spread(intervals, start, end, bucket_ns)
    placed = points.withColumn("_b", int_div(F.col(at), bucket_ns))
    return _inside(spread.join(placed, [*keys, "_b"]), start, end, at)


def _spread(intervals: DataFrame, start: str, end: str, bucket_ns: int) -> DataFrame:
    first, last = int_div(F.col(start), bucket_ns), int_div(F.col(end), bucket_ns)
    return intervals.where(F.col(end) > F.col(start)).withColumn(
        "_b", F.explode(F.sequence(first, last))
    )


def _inside(pairs: DataFrame, start: str, end: str, at: str) -> DataFrame:
    return pairs.where((F.col(at) > F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def reach_join(
    intervals: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    *,
    start: str,
    end: str,
    at: str,
    low: str,
    high: str,
    reaches: Callable[[Column, Column], Column],
    bucket_ns: int,
) -> DataFrame:
    """``band_join`` restricted to points for which ``reaches(low, high)`` holds.

    ``reaches`` must hold for a range whenever it holds for a part of it.  The
    range of each bucket then tells which buckets an interval can skip, so a
    long interval meets one row per bucket and only the points that matter.
    """
    keys = list(keys)
    placed = points.withColumn("_b", int_div(F.col(at), bucket_ns))
    ranges = placed.groupBy(*keys, "_b").agg(F.min(low).alias("_lo"), F.max(high).alias("_hi"))
    kept = (
        _spread(intervals, start, end, bucket_ns)
        .join(ranges, [*keys, "_b"])
        .where(reaches(F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi")
    )
    pairs = kept.join(placed, [*keys, "_b"]).where(reaches(F.col(low), F.col(high)))
    return _inside(pairs, start, end, at)
