"""What the operators share: staging in the shared folder, table reading, column checks."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one is made only where it is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A few rows of the driver as a table, columns as in DDL; sent as Arrow, so no Python worker starts to read them."""
    schema = to_arrow_schema(StructType.fromDDL(columns))
    values = zip(*rows) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema))


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for a shuffle that the operators place themselves."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str, needs: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without columns named like result columns: the result takes their place.

    Columns that the operator ``needs`` can't be replaced: their clash is an error.
    """
    taken = {n.lower() for n in names}
    if clash := [n for n in needs if n.lower() in taken]:
        raise ValueError(f"columns {clash} are needed, but results bear their names; rename them first")
    return df.drop(*(c for c in df.columns if c.lower() in taken))


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with columns of these names renamed, and a function that brings back its columns as they were."""
    taken = {n.lower() for n in names}
    moved = {c: f"_aside_{i}" for i, c in enumerate(df.columns) if c.lower() in taken}
    columns = [F.col(moved.get(c, c)).alias(c) for c in df.columns]
    return df.withColumnsRenamed(moved), lambda out: out.select(*columns)


def extended(df: DataFrame, columns: str) -> StructType:
    """The schema of ``df`` with more columns, given as in DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(columns).fields])


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches that stay small when texts are long.

    A worker holds a few copies of a batch; ``ARROW_ROWS`` bounds it, also
    beside the other workers of an executor. The session keeps the setting, as
    it must hold when the plan runs. A worker stays for later tasks; what a task
    has freed goes back to the system when it ends.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key, "10000"))
    if not 0 < now <= ARROW_ROWS:
        df.sparkSession.conf.set(key, str(ARROW_ROWS))

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(released, schema)


def give_back() -> None:
    """Memory that this process has freed but still holds goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_or_empty(text: str = "text"):
    """The text, a null as the empty string."""
    return F.coalesce(F.col(text), F.lit(""))
