"""Exact token counts by a histogram of document lengths.

Documents are counted by their encoded length; from the histogram alone, sums
over its tail give, for every context limit, how many documents and tokens are
in reach of it, how many tokens remain if longer documents are cut to it, and
quantiles of the length. Only the histogram is shuffled, combined before.

The tail sums are taken in two steps, inside blocks of lengths and over the
blocks, so that not even a histogram of very many lengths meets in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import extended, fresh, in_arrow

#: A vocabulary of ranks (token in base64, rank) and the pattern that cuts text before merging.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 64 << 20
BLOCK = 4096


def encoding(ranks: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoder; special tokens in a text are ordinary text."""
    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def with_tokens(docs: DataFrame, *, text: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with ``n_tokens``; a null or empty text has none. Other columns stay; one
    named like the result column is replaced by it.

    The vocabulary is read on the driver and sent to the tasks: a file of at
    most ``MAX_VOCABULARY_BYTES``, else an error.
    """
    docs = fresh(docs, "n_tokens", needs=(text,))
    path = Path(ranks)
    if path.stat().st_size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{ranks} is larger than {MAX_VOCABULARY_BYTES} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(path.read_bytes())
    schema = extended(docs, "n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(sent.value, pattern).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "n_tokens"])

    return in_arrow(docs, run, schema)


def histogram(counted: DataFrame, column: str = "n_tokens") -> DataFrame:
    """(length, n_docs) of a table with a length for each document; a null length counts as 0."""
    return counted.groupBy(F.coalesce(F.col(column), F.lit(0)).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """The histogram with what its tail says about a context limit of ``length`` tokens.

    n_tokens: tokens of the documents of this length; docs_from, tokens_from:
    documents of at least this length and their tokens; truncated: tokens of all
    documents cut to this length; docs_upto: share of documents of at most this
    length. An empty histogram gives no rows.
    """
    rows = lengths.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(
        "block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"), F.sum("d").over(everything).alias("d_all"), F.sum("t").over(everything).alias("t_all")
    )
    tail = Window.partitionBy("block").orderBy(F.col("length").desc())
    rows = rows.join(sums, "block").select(
        "length", "n_docs", "n_tokens", (F.sum("n_docs").over(tail) + F.col("d_later")).alias("docs_from"), (F.sum("n_tokens").over(tail) + F.col("t_later")).alias("tokens_from"), "d_all", "t_all"
    )
    truncated = F.col("t_all") - F.col("tokens_from") + F.col("length") * F.col("docs_from")
    return rows.select("length", "n_docs", "n_tokens", "docs_from", "tokens_from", truncated.alias("truncated"), ((F.col("d_all") - F.col("docs_from") + F.col("n_docs")) / F.col("d_all")).alias("docs_upto"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, n_docs_longer, truncated) for any limits, also lengths that no document has."""

    def of(c: int):
        cut = F.sum(F.least("length", F.lit(c)) * F.col("n_docs"))
        longer = F.sum(F.when(F.col("length") > c, F.col("n_docs")))
        return F.struct(F.lit(c).cast("long").alias("context"), F.coalesce(longer, F.lit(0)).alias("n_docs_longer"), F.coalesce(cut, F.lit(0)).alias("truncated"))

    return sums.agg(F.array(*map(of, limits)).alias("a")).select(F.inline("a"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least that share of the documents do not exceed."""
    of = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("docs_upto") >= q, F.col("length"))).alias("length")) for q in shares]
    return sums.agg(F.array(*of).alias("a")).select(F.inline("a"))
