"""From raw documents to shards: toxicity, near duplicates, benchmark passages, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import decontaminate, mixing, probminhash, sharding, toxicity
from tidebook.llm.common import staged, table


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier toxic than not go; the labels outside the held-out fifth teach it.

    Null and empty texts have no windows and stay. Repeated rows are judged
    alike, a score of exactly 0.5 goes, an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.keep_clean(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least id.

    Texts without words (null, empty, blank) are one class, so one of them
    stays. Null ids come last; of repeated rows one stays.
    """
    return probminhash.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go.

    Null and empty texts stay as they are, as do all texts if the benchmark has
    no words. Repeated rows are cut alike. ``n_chars``, where there is one, is
    counted anew; that of a null text is null.
    """
    clean = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's weight asks for.

    Null and empty texts have no words: they are taken as often as their source
    is repeated whole. A null source is one of its own; rows with the same id
    and size are taken alike.
    """
    return mixing.repeated(docs, mixing.cycled_weights)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with shard and slot, in eight shards of near equal bytes.

    Null and empty texts weigh one byte. Equal texts share a shard unless they
    alone exceed one; an empty table stays empty.
    """
    return sharding.shard(docs, shards=8)


STAGES = [("toxicity", nontoxic), ("minhash near-dedup", near_dedup), ("benchmark decontamination", benchmark), ("mixing to target weights", mix), ("sharding", shard)]

#: The toxicity score and the near-duplicate classes can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each staged before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else staged(docs), sf_dir)
    return docs
