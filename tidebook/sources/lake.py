"""Partitioned OHLCV lake: range reads, idempotent merges, coverage.

Layout: ``root/venue=/symbol=/interval=/yyyymm=/*.parquet`` with bars stamped
by their close time in nanoseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook import schemas
from tidebook.functions.values import month_key, month_key_of, utc_text
from tidebook.session import staged

SERIES = list(schemas.SERIES)
_PRICES = ["open", "high", "low", "close", "volume"]


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return path.getFileSystem(conf).exists(path)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The whole lake, lazily; empty when it does not exist yet."""
    if not _exists(spark, root):
        return spark.createDataFrame([], schemas.LAKE_BAR)
    return spark.read.schema(schemas.LAKE_BAR).parquet(root)


def in_range(bars: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Inclusive time range, paired with the month predicate that prunes folders."""
    out = bars
    if start_ns is not None:
        out = out.where(
            (F.col("ts_event") >= start_ns) & (F.col("yyyymm") >= month_key_of(start_ns))
        )
    if end_ns is not None:
        out = out.where((F.col("ts_event") <= end_ns) & (F.col("yyyymm") <= month_key_of(end_ns)))
    return out


def read(
    spark: SparkSession,
    root: str,
    venue: str | None = None,
    symbol: str | None = None,
    interval: str | None = None,
    *,
    start_ns: int | None = None,
    end_ns: int | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Bars of a series within ``[start_ns, end_ns]``; unsorted, sort at the sink."""
    bars = scan(spark, root)
    for name, value in zip(SERIES, (venue, symbol, interval)):
        if value is not None:
            bars = bars.where(F.col(name) == value)
    bars = in_range(bars, start_ns, end_ns)
    return bars.select(*SERIES, "ts_event", *(columns or _PRICES))


def read_closes(spark: SparkSession, root: str, *series: str, **bounds) -> DataFrame:
    """Close-only projection of ``read``."""
    return read(spark, root, *series, columns=["close"], **bounds)


def read_ohlc(spark: SparkSession, root: str, *series: str, **bounds) -> DataFrame:
    """Price projection of ``read``."""
    return read(spark, root, *series, columns=_PRICES[:4], **bounds)


def merge(existing: DataFrame, batch: DataFrame, order: str = "batch_seq") -> DataFrame:
    """Last write wins per (series, ts); ``order`` ranks the rows of the batch.

    A plain aggregate: duplicates collapse on the map side, no sort.
    """
    cols = [*SERIES, "ts_event", *_PRICES]
    both = (
        existing.select(*cols)
        .withColumn("_gen", F.lit(0))
        .withColumn("_ord", F.lit(None).cast("long"))
        .unionByName(
            batch.select(*cols, F.lit(1).alias("_gen"), F.col(order).cast("long").alias("_ord"))
        )
    )
    newest = F.max(F.struct("_gen", "_ord", *_PRICES)).alias("_r")
    return both.groupBy(*SERIES, "ts_event").agg(newest).select(
        *SERIES, "ts_event", *[F.col(f"_r.{c}").alias(c) for c in _PRICES]
    )


def write_bars(
    spark: SparkSession, root: str, batch: DataFrame, order: str = "batch_seq"
) -> int:
    """Merge ``batch`` into the lake and return the rows now in the touched months.

    Only the touched (series, month) folders are read and replaced.  The merged
    months are staged first, because a folder cannot be read and overwritten
    in one job, and then replace the old ones.
    """
    # The batch is read three times: for its months, the merge and the join.
    batch = staged(batch)
    stamped = batch.withColumn("yyyymm", month_key(F.col("ts_event")))
    touched = stamped.select(*SERIES, "yyyymm").distinct()
    # Calendar months are few; as literals they prune folders at planning time.
    calendar = [r[0] for r in stamped.select("yyyymm").distinct().collect()]
    existing = scan(spark, root).where(F.col("yyyymm").isin(calendar))
    existing = existing.join(touched, [*SERIES, "yyyymm"], "left_semi")
    merged = merge(existing, stamped, order).withColumn("yyyymm", month_key(F.col("ts_event")))
    ready = staged(merged)
    _write_months(ready, root)
    return ready.count()


def _write_months(bars: DataFrame, root: str) -> None:
    """Range-partition by series and time: balanced files, sorted in each."""
    (
        bars.repartitionByRange(*SERIES, "yyyymm", "ts_event")
        .sortWithinPartitions(*SERIES, "yyyymm", "ts_event")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*SERIES, "yyyymm")
        .parquet(root)
    )


def series(bars: DataFrame) -> DataFrame:
    """Distinct series; only partition columns are read."""
    return bars.select(*SERIES).distinct()


def symbols(bars: DataFrame, venue: str) -> DataFrame:
    """Symbols of a venue."""
    return bars.where(F.col("venue") == venue).select("symbol").distinct()


def footer_coverage(spark: SparkSession, root: str, venue: str | None = None) -> DataFrame:
    """``coverage`` of a written lake from the statistics in its Parquet footers.

    Counts, least and largest times are pushed into the scan for each folder, so
    no row is read; a series then adds up its months.  Only the newer file source
    does that; it is switched on in a session of its own, which leaves the
    caller's as it is.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    bars = scan(own, root)
    bars = bars if venue is None else bars.where(F.col("venue") == venue)
    months = bars.groupBy(*SERIES, "yyyymm").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_event").alias("lo"), F.max("ts_event").alias("hi")
    )
    return months.groupBy(*SERIES).agg(
        F.sum("n").alias("n_rows"), F.min("lo").alias("start_ns"), F.max("hi").alias("end_ns")
    )


def coverage(bars: DataFrame) -> DataFrame:
    """Rows and time span per series."""
    return bars.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("ts_event").alias("start_ns"),
        F.max("ts_event").alias("end_ns"),
    )


def coverage_text(cover: DataFrame) -> DataFrame:
    """Coverage with UTC text bounds, ``-`` for an empty one."""
    return cover.withColumns(
        {"start_utc": utc_text(F.col("start_ns")), "end_utc": utc_text(F.col("end_ns"))}
    )


def catalog(bars: DataFrame, venue: str) -> DataFrame:
    """Coverage report of one venue."""
    return coverage_text(coverage(bars.where(F.col("venue") == venue)))


def authoritative(
    lake: DataFrame,
    fallback: DataFrame,
    keys: list[str],
    start_ns: int | None = None,
    end_ns: int | None = None,
) -> DataFrame:
    """Lake bars, plus fallback bars of series the lake does not have at all.

    The range applies afterwards, so a series with a gap never shows stale
    fallback rows.
    """
    have = lake.select(*keys).distinct()
    rest = fallback.join(have, keys, "left_anti")
    both = lake.select(*fallback.columns).unionByName(rest)
    if start_ns is not None:
        both = both.where(F.col("ts_event") >= start_ns)
    if end_ns is not None:
        both = both.where(F.col("ts_event") <= end_ns)
    return both


def warmup(bars: DataFrame, keys: list[str], n: int, end_ns: int | None = None) -> DataFrame:
    """Last ``n`` bars per series at or before ``end_ns``.

    The rank filter is pushed below the shuffle, so each task sends at most
    ``n`` rows per series.
    """
    rows = bars if end_ns is None else bars.where(F.col("ts_event") <= end_ns)
    w = Window.partitionBy(*keys).orderBy(F.col("ts_event").desc())
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Two-column (ts, close) text; header and malformed rows are skipped."""
    raw = spark.read.schema("ts string, close string").option("mode", "PERMISSIVE").csv(path)
    typed = raw.select(
        F.expr("try_cast(ts as bigint)").alias("ts"),
        F.expr("try_cast(close as double)").alias("close"),
    )
    return typed.where(F.col("ts").isNotNull() & F.col("close").isNotNull())


def from_rows(spark: SparkSession, rows) -> DataFrame:
    """Inline (ts, close) rows."""
    return spark.createDataFrame(
        [(int(t), float(c)) for t, c in rows], schemas.CLOSE_BAR
    )


def read_typed_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars written with an ``instrument`` column and unsigned timestamps."""
    raw = spark.read.parquet(path)
    return raw.withColumn("ts_event", F.col("ts_event").cast("decimal(20,0)").cast("long"))


def write_typed_bars(bars: DataFrame, path: str) -> None:
    """Write ``instrument`` bars as zstd Parquet, sorted within files."""
    bars.sortWithinPartitions("instrument", "ts_event").write.mode("overwrite").option(
        "compression", "zstd"
    ).parquet(path)
