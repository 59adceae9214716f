"""Near duplicates by ProbMinHash, banding and exact verification.

Every shingle of a text is the start of a Poisson process whose rate is the
shingle's weight: its arrivals fall on random registers, and a register keeps
the shingle that arrives first. Two texts agree in a register with the
probability Jaccard similarity of their weighted shingles. A process stops as
soon as it is later than the last register filled, so a text costs about
n + M log M arrivals.

A shingle weighs as often as it stands in its text. The probability Jaccard
similarity of weights x and y is the sum over the shingles i of both of
1 / sum_j max(x_j / x_i, y_j / y_i): it sees each text as a distribution, so a
text and its doubling are alike, and for texts without repeats it is the Jaccard
similarity of the sets. Links are defined and verified by the same similarity
that the registers estimate, so repeats never hide a link that is one.

Registers are banded; texts that agree in a band meet in a bucket. In a bucket
every member is compared with one leader only, exactly, on all weighted shingle
hashes; links join texts into classes. Leaders are drawn anew for each bucket,
so a text meets as many of them as it has bands. Links between members that the leader
misses are looked for afterwards: only in buckets that hold several classes,
only across classes, and only where the triangle inequality of the distance (one
less the similarity, a metric) leaves a link possible. So a group of copies costs comparisons in
proportion to its size, and no link between texts that share a band is lost.

Bands times rows are set so that a pair at the threshold of 0.8 shares no band
with a probability of 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import in_arrow, set_aside, shuffle_width, staged
from tidebook.llm.textblocks import as_bytes, mix, shingles, text_blocks

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 6
#: Up to this many ids (8 bytes each) are broadcast to filter rows; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bounds of a chunk of a bucket.
CHUNK_ROWS, CHUNK_BYTES = 512, 8 << 20
_U = np.uint64


def distinct(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, their counts, and each text's end in them."""
    hashes = hashes.copy()
    first = 0
    for end in ends.tolist():
        hashes[first:end].sort()
        first = end
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[ends[ends < len(hashes)]] = True
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(hashes)))
    return hashes[at], counts, np.searchsorted(at, ends)


def _uniform(seed: np.ndarray) -> np.ndarray:
    """In (0, 1], from 64 random bits."""
    return ((seed >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(elements: np.ndarray, weights: np.ndarray, ends: np.ndarray, registers: int) -> np.ndarray:
    """The element each register of each text keeps, texts x registers.

    Arrivals of all texts are drawn together, round by round; a round draws more
    arrivals at once when few processes are left. Texts without elements keep 0.
    """
    texts = len(ends)
    sizes = np.diff(ends, prepend=0)
    times = np.full(texts * registers, np.inf)
    kept = np.zeros(texts * registers, np.uint64)
    last = np.full(texts, np.inf)
    text = np.repeat(np.arange(texts), sizes)
    element, rate, time, drawn, burst = elements, 1.0 / weights, np.zeros(len(elements)), 0, 1
    while len(element):
        number = np.arange(drawn, drawn + burst, dtype=np.uint64)
        bits = mix(element[:, None] + (number + _U(1)) * _U(0xA0761D6478BD642F))
        arrival = time[:, None] + np.cumsum(-np.log(_uniform(bits)) * rate[:, None], axis=1)
        slot = text[:, None] * registers + (mix(bits ^ _U(0xE7037ED1A0B428DB)) % _U(registers)).astype(np.int64)
        row, col = np.nonzero(arrival < last[text][:, None])
        slot, early, who = slot[row, col], arrival[row, col], element[row]
        np.minimum.at(times, slot, early)
        won = early == times[slot]
        kept[slot[won]] = who[won]
        last = times.reshape(texts, registers).max(axis=1)
        time = arrival[:, -1]
        stays = time < last[text]
        element, rate, time, text = element[stays], rate[stays], time[stays], text[stays]
        drawn += burst
        if drawn >= 4:
            burst = min(64, burst * 2)
    return kept.reshape(texts, registers)


def band_keys(kept: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each text and band."""
    odd = np.arange(1, 2 * rows, 2, dtype=np.uint64) * _U(0x9FB21C651E98DF25)
    salt = np.arange(bands, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F)
    return mix((mix(kept.reshape(len(kept), bands, rows)) * odd).sum(axis=2, dtype=np.uint64) + salt)


def _sketch(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, row, keys = as_bytes(batch.column(2)), batch.column(1), batch.column(0)
            for a, z in text_blocks(texts):
                elements, counts, ends = distinct(*shingles(texts[a:z], words))
                kept = signatures(elements, counts.astype(float), ends, bands * rows)
                sums = np.concatenate(([_U(0)], np.cumsum(mix((elements ^ _U(0x8EBC6AF09C88C6E3)) + counts.astype(_U) * _U(0xA0761D6478BD642F)), dtype=np.uint64)))
                first = np.concatenate(([0], ends[:-1]))
                ids = mix(sums[ends] - sums[first] + (ends - first).astype(np.uint64))
                small = (elements >> _U(32)).astype("<u4")
                sets = [packed(small[i:j], counts[i:j]) for i, j in zip(first.tolist(), ends.tolist())]
                keys_of = band_keys(kept, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(ends > first, bands, 0)))), pa.int32()), pa.array(keys_of[ends > first].ravel()))
                yield pa.RecordBatch.from_arrays([keys[a:z], row[a:z], pa.array(ids.view(np.int64)), lists, pa.array(sets, pa.binary())], ["key", "row", "sid", "bands", "set"])

    return run


def packed(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes and their counts as 32-bit words; only counts above 1 take room.

    Words: how many such counts, the hashes, the places of those counts, the counts.
    """
    if (hashes[1:] == hashes[:-1]).any():  # two shingles fell on one hash
        hashes, where = np.unique(hashes, return_inverse=True)
        counts = np.bincount(where, counts)
    at = np.flatnonzero(counts > 1)
    return np.concatenate([[len(at)], hashes, at, counts[at]]).astype("<u4").tobytes()


def unpacked(data) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes and counts; None where all are 1."""
    words = np.frombuffer(data, "<u4")
    r = int(words[0])
    hashes = words[1 : len(words) - 2 * r]
    if not r:
        return hashes, None
    counts = np.ones(len(hashes))
    counts[words[len(words) - 2 * r : len(words) - r]] = words[len(words) - r :]
    return hashes, counts


def similarity(x: tuple[np.ndarray, np.ndarray | None], y: tuple[np.ndarray, np.ndarray | None]) -> float:
    """The probability Jaccard similarity of two unpacked texts.

    With the shared shingles in the order of x_i / y_i, the sum for one of them
    takes x_j from it on and y_j before it.
    """
    if x[1] is None and y[1] is None:
        both = len(np.intersect1d(x[0], y[0], assume_unique=True))
        return both / (len(x[0]) + len(y[0]) - both)
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    a, b = (np.ones(len(h)) if c is None else c for h, c in (x, y))
    p, q = a[i], b[j]
    order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    before = np.concatenate(([0.0], np.cumsum(q)[:-1])) + b.sum() - q.sum()
    after = np.cumsum(p[::-1])[::-1] + a.sum() - p.sum()
    return float((1 / (after / p + before / q)).sum())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sa, sb) of texts to (a, b, distance)."""
    for batch in batches:
        out = []
        for x, y in zip(batch.column(2), batch.column(3)):
            out.append(1.0 - similarity(unpacked(x.as_buffer()), unpacked(y.as_buffer())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "distance"])


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distances of the pairs (a, b)."""
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("sid").alias("b"), F.col("set").alias("sb")), "b")
    return staged(in_arrow(both.select("a", "b", "sa", "sb"), _compare, "a long, b long, distance double"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the least node of its component.

    Large-star and small-star steps in turn: each node links its larger (or
    smaller) neighbours to the least one it knows. Least neighbours are found
    by an aggregation and joined back, so a node with many links is no group in
    one task. Each round is staged; it ends when no edge changes.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = staged(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def _missed(seen: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): roots of classes with a link that no leader shows, enough of them to join the classes.

    ``seen``: bucket, sid, root and the distance to the bucket's leader. Buckets
    of one class are done. The others are dealt into chunks, bounded in rows and
    bytes, and each pair of chunks is compared by itself, so a large bucket is
    split and no pair of texts becomes a row.
    """
    mixed = seen.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    rows = seen.join(mixed.where("lo < hi").select("bucket"), "bucket").join(sets, "sid")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("set")).alias("bytes"))
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK_ROWS), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int").alias("chunks")
    rows = rows.join(sizes.select("bucket", chunks), "bucket").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    rows = rows.select("bucket", "sid", "root", "distance", "set", "own", other)
    rows = rows.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "root", "distance", "set")
    rows = rows.repartition(shuffle_width(seen.sparkSession), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return in_arrow(rows, _across(threshold), "a long, b long").distinct()


def _across(threshold: float):
    """Compare the sets of a pair of chunks, group after group of rows in order."""

    def links(group: list[tuple]) -> Iterator[tuple[int, int]]:
        own, root, distance = (np.array([r[k] for r in group]) for k in (0, 1, 2))
        x, y = own.min(), own.max()
        texts = [unpacked(r[3]) for r in group]
        hashes = [h for h, _ in texts]
        size = np.array([len(h) for h in hashes])
        common = _products(hashes)
        near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
        repeats = np.array([c is not None for _, c in texts])
        if repeats.any():  # the similarity is at most the sum of the roots of p_i * q_i
            roots = [np.full(len(h), len(h) ** -0.5) if c is None else np.sqrt(c / c.sum()) for h, c in texts]
            some = repeats[:, None] | repeats[None, :]
            near[some] = _products(hashes, roots)[some] >= threshold - 1e-5
        near &= (root[:, None] != root[None, :]) & (np.abs(distance[:, None] - distance[None, :]) <= 1 - threshold + 1e-9)
        if x != y:
            near &= own[:, None] != own[None, :]
        parent: dict[int, int] = {}

        def top(r: int) -> int:
            while r in parent:
                r = parent[r]
            return r

        for i, j in zip(*np.nonzero(np.triu(near, 1))):
            a, b = top(int(root[i])), top(int(root[j]))
            if a != b and (not (repeats[i] or repeats[j]) or similarity(texts[i], texts[j]) >= threshold - 1e-9):
                parent[max(a, b)] = min(a, b)
                yield max(a, b), min(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None
        for batch in batches:
            out = []
            for bucket, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, x, y) != at:
                    out += links(group) if len(group) > 1 else ()
                    group, at = [], (bucket, x, y)
                group.append(row)
            yield _pairs(out)
        if len(group) > 1:
            yield _pairs(list(links(group)))

    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _products(sets: list[np.ndarray], weights: list[np.ndarray] | None = None) -> np.ndarray:
    """Sums over the elements that each two sets share of the products of their weights, or how many these are; by blocks of elements."""
    values = np.concatenate(sets)
    weight = np.concatenate(weights).astype(np.float32) if weights else np.ones(len(values), np.float32)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    own = shared[column]
    column, row, weight = (np.cumsum(shared) - 1)[column[own]], row[own], weight[own]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, row, weight = column[order], row[order], weight[order]
    for first in range(0, int(shared.sum()), 4096):
        a, z = np.searchsorted(column, [first, first + 4096])
        block = np.zeros((len(sets), 4096), np.float32)
        block[row[a:z], column[a:z] - first] = weight[a:z]
        out += block @ block.T
    return out


def _rooted(docs: DataFrame, key: str, text: str, words: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """(key, row, root) of every document: a hash of key and text, and the name of its class."""
    sketched = docs.select(F.col(key).alias("key"), _row(key, text).alias("row"), F.col(text).alias("text"))
    schema = f"key {dict(docs.dtypes)[key]}, row long, sid long, bands array<long>, set binary"
    sketched = staged(in_arrow(sketched, _sketch(words, bands, rows), schema))
    banded = sketched.select("sid", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("sid", "bucket"), "sid")).alias("first"), F.min("sid").alias("lo"), F.max("sid").alias("hi"))
    shared = shared.where("lo < hi").select("bucket", F.col("first.sid").alias("leader"))
    members = staged(banded.join(shared, "bucket").distinct())

    ids = staged(members.select("sid").distinct())
    few = ids.count() <= BROADCAST_IDS
    sets = sketched.select("sid", "set").join(F.broadcast(ids) if few else ids, "sid", "left_semi")
    sets = staged(sets.groupBy("sid").agg(F.first("set").alias("set")))

    stars = members.where("sid <> leader").select(F.col("sid").alias("a"), F.col("leader").alias("b")).distinct()
    near = _distances(stars, sets)
    links = near.where(F.col("distance") <= 1 - threshold + 1e-9).select("a", "b")
    roots = components(links)

    # what the leaders miss: links between classes that share a bucket
    seen = members.join(near.withColumnsRenamed({"a": "sid", "b": "leader"}), ["sid", "leader"])
    seen = seen.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("bucket", "sid", "distance", F.coalesce("root", "sid").alias("root"))
    more = staged(_missed(seen, sets, threshold))
    if not more.isEmpty():
        again = components(more).select(F.col("node").alias("root"), F.col("root").alias("joined"))
        known = roots.join(again, "root", "left").select("node", F.coalesce("joined", "root").alias("root"))
        alone = again.select(F.col("root").alias("node"), F.col("joined").alias("root")).join(roots.select("node"), "node", "left_anti")
        roots = known.union(alone)

    of = sketched.select("key", "row", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    return of.select("key", "row", F.coalesce("root", "sid").alias("root"))


def _row(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: ``key``, ``class_id`` (the least key of its class), ``class_size``.

    Texts with the same shingles as often are copies. Two texts are linked if
    the probability Jaccard similarity of their shingles, weighted by their
    counts, is ``threshold`` or more; a class is what links connect. A text of fewer than ``words`` words has one
    shingle, all its words; texts without words, empty and null texts form one
    class. A null key is carried along but gives no class its name, unless all
    keys of the class are null. Repeated rows are copies. An empty table gives
    no rows.
    """
    of = _rooted(docs, key, text, words, threshold, bands, rows)
    named = of.groupBy("root").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return of.join(named, "root").select(F.col("key").alias(key), "class_id", "class_size")


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one document of each class: the one with the least key, nulls last.

    Of repeated rows one stays. Cases as in ``classes``; the texts are shuffled once.
    """
    moved, back = set_aside(docs, "_row")
    of = _rooted(docs, key, text, words, threshold, bands, rows)
    kept = of.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("no"), "key", "row")).alias("m")).select(F.col("m.row").alias("_row"))
    return back(moved.withColumn("_row", _row(key, text)).join(kept, "_row", "left_semi").dropDuplicates(["_row"]))
