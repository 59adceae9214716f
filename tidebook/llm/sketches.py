"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k least 64-bit hashes of a document's shingles. Sketches of
parts merge into the sketch of the whole (the k least of both). The least k of
two merged sketches are a random sample of the union, so the share of them that
both hold estimates resemblance; the k-th least hash estimates how many
distinct shingles there are, and both together containment.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidebook.llm.common import extended, fresh, in_arrow, shuffle_width
from tidebook.llm.textblocks import BLOCK_BYTES, as_bytes, shingles, text_blocks

WORDS = 5
K = 128


def sketches(texts: list[bytes | None], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The k least distinct shingle hashes of each text, ascending."""
    out: list[np.ndarray] = []
    for a, z in text_blocks(texts):
        hashes, ends = shingles(texts[a:z], words)
        first = 0
        for end in ends.tolist():
            own = hashes[first:end]
            if len(own) > 8 * k:  # repeats apart, the least few are enough to look at
                least = np.unique(own[own <= np.partition(own, 4 * k)[4 * k]])
                own = least if len(least) >= k else own
            out.append(np.unique(own)[:k])
            first = end
    return out


def encoded(sketch: np.ndarray) -> str:
    """As text: base64 of the hashes, big-endian; empty for a text without words."""
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def decoded(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together; a shingle across their border is in neither."""
    return np.union1d(a, b)[:k]


def cardinality(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[-1]) + 1) * 2.0**-64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact where the union has at most k shingles; 1 for two empty ones."""
    both = np.union1d(a, b)[:k]
    if not len(both):
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b, True), both, True)) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    n = cardinality(a, k)
    return min(1.0, resemblance(a, b, k) * cardinality(np.union1d(a, b)[:k], k) / n) if n else 1.0


def fingerprint(docs: DataFrame, *, text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """``docs`` with ``fingerprint`` (see ``encoded``) and ``n_shingles`` (estimated).

    A text of fewer than ``words`` words has one shingle of all its words; null
    and empty texts and texts without words have an empty fingerprint. Other
    columns stay; one named like a result column is replaced by it. One pass, no shuffle.
    """
    docs = fresh(docs, "fingerprint", "n_shingles", needs=(text,))
    schema = extended(docs, "fingerprint string, n_shingles double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(as_bytes(batch.column(batch.schema.get_field_index(text))), k, words)
            new = [pa.array(map(encoded, found), pa.string()), pa.array([cardinality(s, k) for s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "fingerprint", "n_shingles"])

    return in_arrow(docs, run, schema)


def merge(parts: DataFrame, by: str, *, k: int = K) -> DataFrame:
    """(``by``, fingerprint): the fingerprints of a document's parts merged into one.

    Each batch is merged before the shuffle, so a document of very many parts
    brings a row for each batch to its task. Null fingerprints are empty ones;
    a null ``by`` is a value of its own.
    """
    schema = f"`{by}` {dict(parts.dtypes)[by]}, fingerprint string"

    def combined(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for value, own in frame.groupby(by, dropna=False)["fingerprint"]:
            sketch = np.empty(0, np.uint64)
            for f in own:
                sketch = merged(sketch, decoded(f or ""), k)
            out.append((value, encoded(sketch)))
        return pd.DataFrame(out, columns=[by, "fingerprint"])

    partial = parts.select(by, "fingerprint").mapInPandas(lambda frames: map(combined, frames), schema)
    return partial.groupBy(by).applyInPandas(combined, schema)


def by_descending_key(docs: DataFrame, run, schema: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in the order of descending ``key``, each with the text of the next.

    ``run`` maps an iterator of (key, text, next text) to record batches. After
    the last document comes the first. Nulls are the last keys; ties are in the
    order of the text, so equal rows are interchangeable.

    The order is dealt into ranges whose upper bounds are keys of the table. The
    document at an upper bound is the first of its range, so it is sent to the
    range above as well, to follow its last document; the very first goes to the
    lowest range. One shuffle of the texts, and no range holds more than its rows.
    """
    parts = shuffle_width(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ranks = [i / (3 * parts) for i in range(1, 3 * parts)]
    found = rows.agg(F.percentile_approx("key", ranks, 100 * parts).alias("q"), F.max("key").alias("top")).first()
    bounds = np.unique([*(found.q or []), found.top]) if found.top is not None else np.empty(0, np.int64)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ranges(keys: pd.Series, nulls: pd.Series) -> pd.Series:
        null, value = nulls.to_numpy(), keys.to_numpy()
        own = np.searchsorted(bounds, value) * ~null
        first = np.zeros(len(value), bool)
        if len(bounds):
            first = ~null & (bounds[np.minimum(own, len(bounds) - 1)] == value)
        above = np.where(own + 1 < len(bounds), own + 1, 0)
        return pd.Series([[2 * o, 2 * a + 1] if f else [2 * o] for o, a, f in zip(own.tolist(), above.tolist(), first.tolist())])

    dealt = rows.withColumn("place", F.explode(ranges(F.coalesce("key", F.lit(0)), F.col("key").isNull()))).withColumn("part", F.shiftright("place", 1))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "place", F.col("key").desc_nulls_last(), F.col("text").asc_nulls_first())

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(_with_next(batches))

    return in_arrow(dealt.select("part", "place", "key", "text"), stream, schema)


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, text, next text) from rows in order; a range's guest (odd place) only follows."""
    part = waiting = first = None
    for batch in batches:
        for at, place, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            if at != part:
                if waiting:  # a range without a guest: the only one, of null keys
                    yield *waiting, first
                part, waiting, first = at, None, text
            if waiting:
                yield *waiting, text
                waiting = None
            if place % 2 == 0:
                waiting = (key, text)
    if waiting:
        yield *waiting, first


def compared_with_edit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """How the fingerprint follows an edit: one row per document.

    The edited text is the document's with its last half (rounded down, in code
    points) replaced by as many first code points of the next document in
    descending order of the key (or all it has); after the last comes the first.
    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (resemblance to the edited text and to the next
    document). A null text is empty; cases else as in ``fingerprint`` and
    ``by_descending_key``. A single document is its own next.
    """
    kind = dict(docs.dtypes)[key]
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def block(rows: list[tuple]) -> pa.RecordBatch:
        own = [(t or "").encode() for _, t, _ in rows]
        edits = []
        for _, t, following in rows:
            t = t or ""
            half = len(t) // 2
            edits.append((t[: len(t) - half] + (following or "")[:half]).encode())
        prints = sketches([*own, (rows[-1][2] or "").encode()], k, words)
        edited = sketches(edits, k, words)
        sides = [(encoded(a), encoded(e), resemblance(a, e, k), resemblance(a, b, k)) for a, b, e in zip(prints, prints[1:], edited)]
        out = [(i, len(t or ""), hashlib.sha256(e).hexdigest(), *side) for (i, t, _), e, side in zip(rows, edits, sides)]
        return pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], pa.schema(list(zip(names, (key_type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())))))

    key_type = to_arrow_type(docs.schema[key].dataType)

    def run(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in rows:
            if held and (held[-1][2] is not row[1] or size > BLOCK_BYTES):  # a block is a chain of documents
                yield block(held)
                held, size = [], 0
            held.append(row)
            size += len(row[1] or "")
        if held:
            yield block(held)

    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return by_descending_key(docs, run, schema, key=key, text=text)
