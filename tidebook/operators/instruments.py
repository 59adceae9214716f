"""Instrument dimension: defaults, validation, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Known asset classes.
CLASSES = ("spot", "equity", "perpetual", "future", "option")


def with_defaults(instruments: DataFrame) -> DataFrame:
    """Fill class defaults: unit multiplier for spot and equity, quote settlement
    unless inverse, inverse only for perpetuals."""
    cls = F.col("asset_class")
    inverse = (cls == "perpetual") & F.coalesce("is_inverse", F.lit(False))
    return (
        instruments.withColumn("is_inverse", inverse)
        .withColumn(
            "multiplier",
            F.when(cls.isin("spot", "equity"), F.lit(1.0)).otherwise(
                F.coalesce(F.col("multiplier").cast("double"), F.lit(1.0))
            ),
        )
        .withColumn("settle", F.when(F.col("is_inverse"), F.col("base")).otherwise(F.col("quote")))
    )


def violations(instruments: DataFrame) -> DataFrame:
    """Add ``violations``: every rule an instrument breaks."""
    cls = F.col("asset_class")
    option = cls == "option"
    rules = [
        F.when(cls.isNull() | ~cls.isin(*CLASSES), F.lit("unknown_class")),
        F.when((cls == "future") & F.col("expiry_ns").isNull(), F.lit("future_without_expiry")),
        F.when(option & F.col("strike").isNull(), F.lit("option_without_strike")),
        F.when(option & F.col("right").isNull(), F.lit("option_without_right")),
        F.when(option & F.col("expiry_ns").isNull(), F.lit("option_without_expiry")),
        F.when(option & F.col("underlying").isNull(), F.lit("option_without_underlying")),
    ]
    return instruments.withColumn(
        "violations", F.filter(F.array(*rules), lambda r: r.isNotNull())
    )


def lookup(rows: DataFrame, instruments: DataFrame, key: str = "symbol"):
    """(known rows with their instrument, rows of unknown instruments)."""
    return rows.join(instruments, key), rows.join(instruments.select(key), key, "left_anti")
