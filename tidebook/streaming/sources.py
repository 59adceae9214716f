"""Streaming inputs and sinks shared by the jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook import schemas
from tidebook.functions.values import nanos_to_timestamp
from tidebook.session import shared_dir
from tidebook.sources import lake, normalize


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int = 100
) -> DataFrame:
    """Files that land in a folder (or match a glob), a bounded number per trigger."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(path)


def kafka_frames(spark: SparkSession, servers: str, topic: str, max_offsets: int) -> DataFrame:
    """Raw frames from Kafka; offsets live in the query's checkpoint."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
    )
    arrived = F.unix_micros("timestamp") * 1000
    return raw.select(F.col("value").cast("string").alias("text"), arrived.alias("ts_init"))


def market_streams(frames: DataFrame) -> dict[str, DataFrame]:
    """Trades, quotes, depth updates and rejects of one raw frame stream."""
    parts = normalize.split_frames(frames)
    return {
        "trades": normalize.trades(parts["trades"]),
        "quotes": normalize.quotes(parts["quotes"]),
        "depth": normalize.depth_updates(parts["depth"]),
        "rejects": parts["rejects"],
    }


def frame_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Raw frames from JSON files."""
    return file_stream(spark, path, schemas.RAW_FRAME, "json", max_files)


def with_event_time(df: DataFrame, delay: str, ts: str = "ts", out: str = "event_time"):
    """Event-time column in microseconds with a watermark."""
    return df.withColumn(out, nanos_to_timestamp(F.col(ts))).withWatermark(out, delay)


def lake_sink(root: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that merges bars into the lake.

    Later batches win; replaying a batch gives the same lake.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        lake.write_bars(batch.sparkSession, root, batch.withColumn("batch_seq", F.lit(batch_id)))

    return write


def fan_out(routes: dict[str, tuple], root: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: each route ``{name: predicate}`` gets its rows.

    The micro-batch is kept once for all routes, and each batch overwrites its
    own folder, so a replay cannot duplicate rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for name, predicate in routes.items():
                kept.where(predicate).write.mode("overwrite").parquet(
                    f"{root}/{name}/batch={batch_id}"
                )
        finally:
            kept.unpersist()

    return write


def run_available_now(
    df: DataFrame,
    mode: str = "append",
    checkpoint: str | None = None,
    state_partitions: int | None = None,
):
    """Process everything that is there and return the output as a table.

    Each micro-batch overwrites its own folder, so a retried batch does not
    repeat rows.  ``state_partitions`` fixes how many partitions the state has
    for the life of the query; the session's shuffle partitions by default.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    # The state layout is fixed by the partition count of the first run.
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions or before))
    try:
        query = (
            df.writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint or f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(out)
