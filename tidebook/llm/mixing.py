"""Mixing sources to target weights by capped water-filling.

Each source gets the share of the total that its weight asks for, but at most
``max_epochs`` times its own size; what the clamped sources leave is shared out
again by weight among the rest until no source is above its cap. A source is
then repeated whole as often as its rate says, and a seeded part of it once
more.

The part is found by walking the source in seeded hash order and taking every
document that still fits into the words wanted. The walk needs no sort of a
source in one task: it goes in rounds, each over the documents behind the last
one that didn't fit that are no larger than what is left. Sizes are summed per
source and hash bucket (combined before the shuffle), running sums over at most
65,536 buckets of a source give the bucket where the round ends, and only that
bucket is sorted. What is left falls with each round, and the rounds end when
nothing fits any more. One more document tops the walk up where that brings the
source nearer to its target, so a source misses it by less than half of the
smallest document not taken.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import staged

MAX_EPOCHS = 3
SEED = "mix"
#: A table of sources up to this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Hex digits of the hash that name a bucket: 65,536 buckets.
HEX_BUCKET = 4


def words_of(text: str = "text") -> Column:
    """Number of runs of characters other than blanks and U+0009 to U+000D; a null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size, weight) with ``target``: the water level.

    With sources in the order of size / weight, those up to some point are
    clamped and the rest share what remains by weight; the point is the first
    at which the next source stays below its cap. Sizes and weights are whole
    numbers, so the sums are exact. Sources of size 0 get 0. The table has one
    row per source and is ordered once in one task: it grows with the number of
    sources, not with their rows.
    """
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    clamped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_epochs
    total = F.coalesce(F.sum("source_size").over(before), F.lit(0)) + F.sum("source_size").over(rest)
    level = sizes.select("*", (total - clamped).alias("_left"), F.sum("weight").over(rest).alias("_weight"), F.row_number().over(order).alias("_at"))
    cap = F.col("source_size") * max_epochs
    fits = F.col("_left") * F.col("weight") / F.col("_weight") <= cap
    free = F.min(F.when(fits, F.struct("_at", "_left", "_weight"))).over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = F.col("_free._left") * F.col("weight") / F.col("_free._weight")
    return level.withColumn("_free", free).select(*sizes.columns, F.least(F.coalesce(share, cap.cast("double")), cap.cast("double")).alias("target"))


def _unit(key: str, text: str, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), words_of(text).cast("string")))


def _units(docs: DataFrame, key: str, source: str, text: str, seed: str) -> DataFrame:
    """Source, size and the place in the seeded order of each document."""
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words_of(text).alias("size"), _unit(key, text, seed).alias("unit"))


def _by_source(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    right = plan.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _walk(units: DataFrame, start: DataFrame, few: bool) -> list[DataFrame]:
    """The rounds of the walk: (source, left, after, until), each staged.

    A round takes the units of a source between ``after`` and ``until`` of at
    most ``left`` words: ``until`` is the first that doesn't fit any more, null
    where all fit. ``start`` has the words wanted.
    """
    bucket = F.substring("unit", 1, HEX_BUCKET)
    rounds, state = [], start.select("source", F.col("wanted").alias("left"), F.lit("").alias("after"))
    while True:
        fits = _by_source(units, state, few).where((F.col("unit") > F.col("after")) & (F.col("size") <= F.col("left")))
        sums = staged(fits.groupBy("source", "left", "after", bucket.alias("bucket")).agg(F.sum("size").alias("size")))
        if sums.isEmpty():
            return rounds
        sums = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
        ends = sums.groupBy("source", "left", "after").agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("upto") - F.col("size")).alias("before")))).alias("e"), F.sum("size").alias("all"))
        ends = staged(ends.select("source", "left", "after", "all", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before")))

        # inside the bucket where a round ends, unit by unit
        inside = _by_source(units, ends.where("edge is not null"), few).where((F.col("unit") > F.col("after")) & (F.col("size") <= F.col("left")) & (bucket == F.col("edge")))
        inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("unit")))
        stops = inside.where("upto > left").groupBy("source").agg(F.min(F.struct("unit", (F.col("upto") - F.col("size")).alias("got"))).alias("s"))
        done = _by_source(ends, stops.select("source", F.col("s.unit").alias("until"), F.col("s.got").alias("got")), few)
        done = staged(done.select("source", "left", "after", "until", F.coalesce("got", "all").alias("got")))
        rounds.append(done.select("source", "left", "after", "until"))
        state = done.where("until is not null").select("source", (F.col("left") - F.col("got")).alias("left"), F.col("until").alias("after"))


def _walked(size: Column) -> Column:
    """Whether a unit of that size is taken in one of the ``rounds`` of its source."""
    taken = lambda r: (size <= r["left"]) & (F.col("unit") > r["after"]) & F.coalesce(F.col("unit") < r["until"], F.lit(True))
    return F.coalesce(F.exists("rounds", taken), F.lit(False))


def plan(rows: DataFrame, weights, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame, bool, bool]:
    """What documents are taken by, and whether each of the two tables may be broadcast.

    One row per source: source_size, target, whole (repetitions of all), rounds
    (of the walk) and top (the unit that tops it up). And one row for each unit
    that several rows share, by whose sizes together it was walked: source, unit
    and ``walked``.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    base = targets(weights(sizes), max_epochs).withColumn("whole", F.least(whole, F.lit(max_epochs)))
    base = staged(base.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")))
    few = base.count() <= BROADCAST_SOURCES
    units = staged(rows.groupBy("source", "unit").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).where("size > 0"))
    rounds = _walk(units, base, few)
    if rounds:
        all_rounds = functools.reduce(DataFrame.union, rounds).groupBy("source").agg(F.collect_list(F.struct("left", "after", "until")).alias("rounds"))
        base = _by_source(base, all_rounds, few)
    else:
        base = base.withColumn("rounds", F.expr("cast(null as array<struct<left: double, after: string, until: string>>)"))
    walked = _by_source(units, base.select("source", "wanted", "rounds"), few).withColumn("walked", _walked(F.col("size")))
    got = walked.groupBy("source").agg(F.sum(F.when(F.col("walked"), F.col("size")).otherwise(0)).alias("got"))
    base = staged(_by_source(base, got, few).withColumn("missing", F.col("wanted") - F.coalesce("got", F.lit(0))))

    # one unit more, where that brings the source nearer to its target
    over = _by_source(units, base.select("source", "missing", "rounds"), few).where((F.col("size") < 2 * F.col("missing")) & ~_walked(F.col("size")))
    tops = over.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("missing")), "unit")).alias("t"))
    base = staged(_by_source(base, tops.select("source", F.col("t.unit").alias("top")), few).select("source", "source_size", "target", "whole", "rounds", "top"))
    shared = staged(walked.where("n > 1").select("source", "unit", "walked"))
    return base, shared, few, shared.count() <= BROADCAST_SOURCES


def _planned(rows: DataFrame, by: tuple[DataFrame, DataFrame, bool, bool]) -> DataFrame:
    """``rows`` (source, unit, size and others) with source_size, target and copies."""
    base, shared, few, few_shared = by
    shared = shared.select(F.col("source").alias("_source"), F.col("unit").alias("_unit"), "walked")
    rows = _by_source(rows, base, few)
    rows = rows.join(F.broadcast(shared) if few_shared else shared, F.col("source").eqNullSafe(F.col("_source")) & (F.col("unit") == F.col("_unit")), "left").drop("_source", "_unit")
    part = (F.col("size") > 0) & F.coalesce("walked", _walked(F.col("size"))) | F.coalesce(F.col("unit") == F.col("top"), F.lit(False))
    return rows.withColumn("copies", F.col("whole") + part.cast("long"))


def mix(docs: DataFrame, weights, *, key: str = "doc_id", source: str = "source", text: str = "text", max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: key, source, size, source_size, target, copies, taken.

    ``weights`` maps the table (source, source_size) to the same with a whole
    ``weight`` of 1 or more. ``copies`` is how often the mix holds the document,
    ``taken`` its words times that. Rows of a source with the same key and size
    (repeats, or nulls as keys) are taken alike, by their size together. A null text has size 0, a null
    source is a source of its own. An empty table gives no rows. Runs over the
    same rows agree, however they are partitioned.
    """
    rows = staged(_units(docs, key, source, text, seed))
    rows = _planned(rows, plan(rows, weights, max_epochs))
    return rows.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, weights, *, key: str = "doc_id", source: str = "source", text: str = "text", max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs``, every row as often as the mix takes it; as ``mix`` otherwise.

    The texts are not shuffled: what a row is taken by stands in its source's row.
    """
    by = plan(staged(_units(docs, key, source, text, seed)), weights, max_epochs)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(source).alias("source"), _unit(key, text, seed).alias("unit"), words_of(text).alias("size"))
    return _planned(rows, by).select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_")).select("doc.*")


def cycled_weights(sizes: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, over the sources by code point, a null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
