"""Agreement of two recorded sessions and the promotion verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.values import bucket, int_div
from tidebook.operators.series import Cuts, Series
from tidebook.session import is_scan, staged


def match_fills(
    a: DataFrame, b: DataFrame, keys: list[str], bucket_ns: int, at: str = "ts"
) -> DataFrame:
    """Distinct (bucket, side) keys of both sessions with their mean prices."""

    def grouped(df, name):
        return df.groupBy(*keys, bucket(F.col(at), bucket_ns).alias("bucket"), "side").agg(
            F.avg("px").alias(name)
        )

    return grouped(a, "px_a").join(grouped(b, "px_b"), [*keys, "bucket", "side"], "full_outer")


def timing_and_price(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Signal timing agreement and mean price deviation in bps per session pair."""
    in_a, in_b = F.col("px_a").isNotNull(), F.col("px_b").isNotNull()
    dev = F.abs(F.col("px_b") - F.col("px_a")) / F.abs("px_a") * 1e4
    both = in_a & in_b & (F.col("px_a") != 0)
    total = F.count_if(in_a) + F.count_if(in_b)
    return matched.groupBy(*keys).agg(
        F.when(total == 0, 1.0)
        .otherwise(2.0 * F.count_if(in_a & in_b) / total)
        .alias("signal_agreement"),
        F.coalesce(F.avg(F.when(both, dev)), F.lit(0.0)).alias("fill_dev_bps"),
    )


def align_curves(
    a: DataFrame,
    b: DataFrame,
    keys: list[str],
    at: str = "ts_event",
    cuts: Cuts | None = None,
) -> DataFrame:
    """Pair two curves by position after resampling both to the shorter one.

    Output point ``i`` of ``n`` reads source row ``i * m div n``; turned
    around, source row ``j`` serves the outputs ``ceil(j*n/m)`` up to (not
    including) ``ceil((j+1)*n/m)``, at most one since ``n <= m``.
    """

    series = Series.of(keys, at, cuts)

    def sized(df, n):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))

    sizes = sized(a, "_na").join(sized(b, "_nb"), keys)
    n = F.least("_na", "_nb")

    def resampled(df, own, out):
        rows = series.number(df.select(*keys, at, "equity"), "_j").join(sizes, keys)
        i = int_div(F.col("_j") * n + F.col(own) - 1, F.col(own))
        hit = int_div(i * F.col(own), n) == F.col("_j")
        return rows.where(hit & (i < n)).select(*keys, i.alias("i"), F.col("equity").alias(out))

    return resampled(a, "_na", "eq_a").join(resampled(b, "_nb", "eq_b"), [*keys, "i"])


def curve_correlation(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson correlation; identical flat curves correlate fully."""
    agg = aligned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.covar_pop("eq_a", "eq_b").alias("_cov"),
        F.var_pop("eq_a").alias("_va"),
        F.var_pop("eq_b").alias("_vb"),
        F.max((F.col("eq_a") != F.col("eq_b")).cast("int")).alias("_differ"),
    )
    flat_a, flat_b = F.col("_va") == 0, F.col("_vb") == 0
    value = (
        F.when(F.col("_n") < 2, 0.0)
        .when(flat_a & flat_b, F.when(F.col("_differ") == 0, 1.0).otherwise(0.0))
        .when(flat_a | flat_b, 0.0)
        .otherwise(F.try_divide(F.col("_cov"), F.sqrt(F.col("_va") * F.col("_vb"))))
    )
    return agg.select(*keys, value.alias("equity_corr"))


def final_returns(curve: DataFrame, keys: list[str], at: str, out: str) -> DataFrame:
    """Return from the first to the last point; 0 when degenerate."""
    agg = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("equity", at).alias("_s"),
        F.max_by("equity", at).alias("_e"),
    )
    ok = (F.col("_n") >= 2) & (F.col("_s") != 0)
    return agg.select(
        *keys, F.when(ok, F.col("_e") / F.col("_s") - 1.0).otherwise(F.lit(0.0)).alias(out)
    )


def parity_metrics(
    fills_a: DataFrame,
    curve_a: DataFrame,
    fills_b: DataFrame,
    curve_b: DataFrame,
    keys: list[str],
    *,
    bucket_ns: int,
    at: str = "ts_event",
    cuts: Cuts | None = None,
) -> DataFrame:
    """The four agreement metrics of every session pair in one table."""
    # Each curve feeds the alignment and the returns.
    curve_a, curve_b = (c if is_scan(c) else staged(c) for c in (curve_a, curve_b))
    timing = timing_and_price(match_fills(fills_a, fills_b, keys, bucket_ns), keys)
    corr = curve_correlation(align_curves(curve_a, curve_b, keys, at, cuts), keys)
    ra = final_returns(curve_a, keys, at, "_ra")
    rb = final_returns(curve_b, keys, at, "_rb")
    ends = ra.join(rb, keys).select(*keys, F.abs(F.col("_ra") - F.col("_rb")).alias("return_diff"))
    return (
        ends.join(timing, keys, "left")
        .join(corr, keys, "left")
        .select(
            *keys,
            F.coalesce("signal_agreement", F.lit(1.0)).alias("signal_agreement"),
            F.coalesce("fill_dev_bps", F.lit(0.0)).alias("fill_dev_bps"),
            F.coalesce("equity_corr", F.lit(0.0)).alias("equity_corr"),
            "return_diff",
        )
    )


@dataclass(frozen=True)
class Criterion:
    """Thresholds of the promotion gate."""

    min_signal_agreement: float = 0.95
    max_fill_dev_bps: float = 5.0
    min_equity_corr: float = 0.90
    max_return_diff: float = 0.02


def verdict(metrics: DataFrame, criterion: Criterion = Criterion()) -> DataFrame:
    """Add ``passed`` and ``reasons`` (every failing condition)."""
    c = criterion
    failing = [
        F.when(F.col("signal_agreement") < c.min_signal_agreement, F.lit("signal_agreement")),
        F.when(F.col("fill_dev_bps") > c.max_fill_dev_bps, F.lit("fill_dev_bps")),
        F.when(F.col("equity_corr") < c.min_equity_corr, F.lit("equity_corr")),
        F.when(F.col("return_diff") > c.max_return_diff, F.lit("return_diff")),
    ]
    return metrics.withColumn(
        "reasons", F.filter(F.array(*failing), lambda r: r.isNotNull())
    ).withColumn("passed", F.size("reasons") == 0)


def cross_check(metrics: DataFrame, max_return_diff_bps: float = 50.0) -> DataFrame:
    """Advisory warnings; never a gate."""
    notes = [
        F.when(F.col("signal_agreement") < 1.0, F.lit("signal_timing_drift")),
        F.when(F.col("return_diff") * 1e4 > max_return_diff_bps, F.lit("return_drift")),
    ]
    return metrics.withColumn("warnings", F.filter(F.array(*notes), lambda r: r.isNotNull()))


def perturb(fills: DataFrame, bps: float) -> DataFrame:
    """Scale every fill price by ``bps`` (a test session)."""
    return fills.withColumn("px", F.col("px") * (1.0 + bps / 1e4))
