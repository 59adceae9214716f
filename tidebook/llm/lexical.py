"""Ranked lexical search by the Best Position Algorithm.

Documents are the shards of the index: a block of documents holds, for every term
of the items, an impact list (documents by falling impact) and, for every
document, its places in these lists. An item reads its terms' lists in parallel,
some positions at a time. Every document met is looked up in all lists at once
(direct access): that gives its score, and it marks its place in each list as
seen. The best position of a list is the last one up to which all are seen,
whether by reading on or by direct access, so it is never before the position
read last. No document yet unseen scores more than the impacts at the best
positions together; the item is done with a block when that is strictly below
the k-th best score known, which also covers ties.

Three passes: one over the texts counts the terms of the items in each document
and stages the counts; one over these gives the statistics of the collection; one
searches blocks of them. A task keeps the k best of an item over its blocks, and
the tasks' lists are merged in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidebook.llm.common import in_arrow, staged
from tidebook.llm.textblocks import as_bytes, folded_words

BEST = 10
#: Text of the items that one search handles, at most about; more items take more passes.
GROUP_BYTES = 2 << 20
#: A block ends with the document that brings it to so many postings or documents.
BLOCK_POSTINGS, BLOCK_DOCS = 500_000, 1 << 16
FIRST_STEP = 16
MERGE_PARTS = 32


@dataclass
class Items:
    """Items by number: their ids and their terms, which are numbers in ``vocabulary``."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]


def _items(rows: list[tuple]) -> Items:
    """Of (id, UTF-8 text); the texts of an id are one item."""
    words: dict = {}
    for name, text in rows:
        if found := folded_words(text):
            words.setdefault(name, set()).update(found)
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*words.values())))}
    return Items(list(words), [np.array(sorted(vocabulary[w] for w in own)) for own in words.values()], vocabulary)


def _groups(items: DataFrame, item_id: str, text: str, group_bytes: int) -> Iterator[Items]:
    """Items of about ``group_bytes`` of text at a time."""
    rows = items.select(F.col(item_id).alias("n"), F.col(text).cast("binary").alias("t")).where("t is not null").distinct()
    total = rows.agg(F.sum(F.length("t") + 32)).first()[0] or 0
    n = -(-total // group_bytes)
    for g in range(n):
        part = rows.where(F.pmod(F.xxhash64("n"), F.lit(n)) == g) if n > 1 else rows
        if (found := _items([tuple(r) for r in part.toLocalIterator()])).ids:
            yield found


def _postings(docs: DataFrame, key: str, text: str, sent) -> DataFrame:
    """(key, n, terms, tfs) of every document with a term: its length and the counts of the items' terms."""
    schema = StructType([StructField("key", docs.schema[key].dataType), *StructType.fromDDL("n long, terms array<int>, tfs array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.vocabulary.get
        for batch in batches:
            lengths, terms, counts = [], [], []
            for t in as_bytes(batch.column(1)):
                words = folded_words(t or b"")
                lengths.append(len(words))
                found = Counter(map(number, words))
                found.pop(None, None)
                terms.append([*found])
                counts.append([*found.values()])
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["key", "n", "terms", "tfs"])
            yield out.filter(pc.greater(out.column(1), 0))

    return in_arrow(docs.select(key, text), run, schema)


@dataclass
class Statistics:
    """Documents with a term, all their terms, and the weight of each term of the items."""

    documents: int
    terms: int
    weights: np.ndarray


def statistics(postings: DataFrame, vocabulary: int) -> Statistics:
    n, total = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(vocabulary, np.int64)
    for term, df in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the vocabulary of a group
        weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    return Statistics(n, total, weights)


class Block:
    """Impact lists of a block of documents, which are in the order that decides ties."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, ends: np.ndarray, known: Statistics) -> None:
        self.docs = len(lengths)
        self.first = np.concatenate(([0], ends))
        doc = np.repeat(np.arange(self.docs), np.diff(self.first))
        m = 100 - 90 + (90 * lengths * known.documents) // known.terms
        self.terms = terms
        self.impacts = known.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
        order = np.lexsort((doc, -self.impacts, terms))
        self.listed, self.listed_impacts = doc[order], self.impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(known.weights) + 1))
        self.places = np.empty(len(order), np.int64)
        self.places[order] = np.arange(len(order)) - self.starts[terms[order]]
        self.slot = np.full(len(known.weights), -1)

    def best(self, terms: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the ``k`` best above 0, best first, and how many documents were met.

        Those below ``floor``, if it is above 0, may be left out.
        """
        sizes = self.starts[terms + 1] - self.starts[terms]
        terms, sizes = terms[sizes > 0], sizes[sizes > 0]
        starts = self.starts[terms]
        live = self.listed_impacts[starts] > 0
        terms, sizes, starts = terms[live], sizes[live], starts[live]
        self.slot[terms] = np.arange(len(terms))
        offsets = np.concatenate(([0], np.cumsum(sizes + 1)))  # one place after each list stays unseen
        seen, met = np.zeros(offsets[-1], bool), np.zeros(self.docs, bool)
        position = np.zeros(len(terms), np.int64)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step, n_met = 0, FIRST_STEP, 0
        while len(terms):
            read = np.minimum(depth + step, sizes) - np.minimum(depth, sizes)
            rows = np.repeat(starts + np.minimum(depth, sizes), read) + _steps(read)
            new = np.unique(self.listed[rows])
            new = new[~met[new]]
            met[new] = True
            n_met += len(new)
            depth += step
            step *= 2

            # direct access: all lists that hold the new documents
            count = self.first[new + 1] - self.first[new]
            rows = np.repeat(self.first[new], count) + _steps(count)
            slot = self.slot[self.terms[rows]]
            hit = slot >= 0
            seen[offsets[slot[hit]] + self.places[rows[hit]]] = True
            total = np.bincount(np.repeat(np.arange(len(new)), count)[hit], self.impacts[rows[hit]], len(new))  # whole and below 2**53
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, total.astype(np.int64)])
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]

            most = 0
            for i in range(len(terms)):
                ahead = seen[offsets[i] + position[i] : offsets[i + 1]]
                position[i] += np.argmin(ahead)
                if position[i] < sizes[i]:
                    most += int(self.listed_impacts[starts[i] + position[i] - 1])
            if most == 0 or most < floor or (len(scores) == k and most < scores[-1]):
                break
        self.slot[terms] = -1
        return docs[scores > 0], scores[scores > 0], n_met


def _steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, end to end."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def _searcher(sent, known: Statistics, k: int, item_type, key_type):
    """The ``k`` best documents of each item among the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        held: list[list[tuple]] = [[] for _ in items.ids]  # (-score, no key, key)

        def search(rows: pa.Table) -> None:
            rows = rows.take(pc.sort_indices(rows, [("key", "ascending")], null_placement="at_end")).combine_chunks()
            keys, lists = rows["key"].combine_chunks(), rows["terms"].combine_chunks()
            terms = lists.flatten().to_numpy().astype(np.int64)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            block = Block(rows["n"].to_numpy(), terms, rows["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64), ends, known)
            for i, own in enumerate(items.terms):
                best = held[i]
                found, scores, _ = block.best(own, k, -best[-1][0] if len(best) == k else 0)
                names = keys.take(pa.array(found)).to_pylist()
                held[i] = sorted([*best, *((-s, name is None, name) for s, name in zip(scores.tolist(), names))], key=lambda r: r[: 2 + (not r[1])])[:k]

        waiting, size, docs = [], 0, 0
        for batch in batches:
            waiting.append(batch)
            size += len(batch.column(2).flatten())
            docs += batch.num_rows
            if size >= BLOCK_POSTINGS or docs >= BLOCK_DOCS:
                search(pa.Table.from_batches(waiting))
                waiting, size, docs = [], 0, 0
        if docs:
            search(pa.Table.from_batches(waiting))
        out = [(items.ids[i], key, -s) for i, best in enumerate(held) for s, _, key in best]
        ids, keys, scores = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, item_type), pa.array(keys, key_type), pa.array(scores, pa.int64())], ["item", "key", "score"])

    return run


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows (item, key, score) of each item with ``rank``; in parts of an item first."""
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    parts = Window.partitionBy("item", F.pmod(F.xxhash64("key", "score"), F.lit(MERGE_PARTS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = BEST, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(``item_id``, rank, ``key``, score): the ``k`` best documents of each item with a score above 0.

    Terms are runs of digits, letters A-Z (folded) and characters beyond ASCII of
    whole texts. A null or empty text has none: such a document is not counted
    and never found, such an item finds nothing. Rows of items with the same id
    (a null, too) are one item with the terms of all of them; each row of
    ``docs`` is a document of its own, also where a key repeats. Equal scores go
    by the key, nulls last. Empty tables give no rows. Only the named columns
    are read, so others can't clash.
    """
    if item_id.lower() == key.lower() or {item_id.lower(), key.lower()} & {"rank", "score"}:
        raise ValueError(f"columns {item_id} and {key} would clash in the result; rename them first")
    schema = StructType([StructField("item", items.schema[item_id].dataType), StructField("key", docs.schema[key].dataType), StructField("score", LongType())])
    spark, out = docs.sparkSession, None
    for group in _groups(items, item_id, item_text, group_bytes):
        sent = spark.sparkContext.broadcast(group)  # about group_bytes of text
        postings = staged(_postings(docs, key, text, sent))
        known = statistics(postings, len(group.vocabulary))
        if known.documents:
            run = _searcher(sent, known, k, to_arrow_type(schema["item"].dataType), to_arrow_type(schema["key"].dataType))
            found = in_arrow(postings, run, schema)
            out = out.union(found) if out else found
    if out is None:
        return spark.createDataFrame([], StructType([schema["item"], StructField("rank", IntegerType()), schema["key"], schema["score"]])).toDF(item_id, "rank", key, "score")
    return _ranked(staged(out), k).select(F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")
