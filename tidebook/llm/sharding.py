"""Sharding by a k-d tree over document metadata.

The tree's points are groups of equal texts, with their bytes as weight and
(source, language, length) as coordinates. A node that stands for several
shards is split along its widest dimension at the weighted quantile that gives
each side the bytes of its shards; a node of one shard is a leaf of about the
target bytes. The quantile is found for all nodes of a level at once: bytes are
summed per (node, bucket of the coordinate) with map-side combine, running sums
over the buckets of a node (8,192 at most) give the bucket that holds the
quantile, and a second pass splits that bucket by the low bits. The coordinate
ends in the text's hash, so points with equal metadata are split as well, and
no node's points meet in one task.

A group as large as ``LARGE`` of a shard would upset the medians, wherever they
fall. Such groups (at most 1 / LARGE for each shard) are first dealt, largest
first, to the emptiest shard, and the tree shares out what room is left. Equal
texts thus stay in one shard, unless their group alone exceeds a shard: then it
is dealt in parts.

Only DataFrame functions are used; the driver sees shard counts and sums, and
the list of large groups, which is bounded by the number of shards.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import fresh, local_table, staged, text_or_empty

#: A group of at least this part of a shard's bytes is placed by itself.
LARGE = 0.02
#: Shards up to this number keep their tables (a row per node) fit for a broadcast.
MAX_SHARDS = 1 << 16
_DIM_BITS, _HIGH_BITS, _LOW_BITS = 10, 3, 20
_SLOT_BUCKETS = 1024


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes of the text plus 1."""
    return (F.octet_length(text_or_empty(text)) + 1).cast("long")


def _coordinates(dimensions: dict[str, Column]) -> list[Column]:
    top = (1 << _DIM_BITS) - 1
    return [F.least(F.greatest(F.floor(c * top), F.lit(0)), F.lit(top)).cast("int").alias(f"d{i}") for i, c in enumerate(dimensions.values())]


def named(column: str) -> Column:
    """A coordinate from 0 to 1 for a name: equal names, equal coordinates."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(1000)) / 1000.0


def length(text: str = "text") -> Column:
    """A coordinate from 0 to 1 for a text's length, on a scale of doublings."""
    return F.log2(size_of(text)) / 40.0


def _groups(docs: DataFrame, text: str, dimensions: dict[str, Column]) -> DataFrame:
    """One row for each distinct text: its hash, bytes and coordinates (the least of its rows)."""
    n = len(dimensions)
    rows = docs.select(F.xxhash64(text_or_empty(text)).alias("h"), size_of(text).alias("size"), *_coordinates(dimensions))
    return rows.groupBy("h").agg(F.sum("size").alias("bytes"), *(F.min(f"d{i}").alias(f"d{i}") for i in range(n)))


def _deal(large: list[tuple[int, int]], shards: int, target: float) -> tuple[list[tuple[int, int, int]], list[float]]:
    """Place (hash, bytes), largest first, in the emptiest shard: (hash, part, shard); room left.

    A group larger than a shard goes in as many parts as it has shards' worth.
    """
    heap, out = [(0.0, s) for s in range(shards)], []
    used = [0.0] * shards
    parts = []
    for h, b in large:
        n = max(1, -int(-b // target))
        parts += [(b / n, h, p) for p in range(n)]
    for b, h, p in sorted(parts, key=lambda x: (-x[0], x[1], x[2])):
        full, s = heapq.heappop(heap)
        used[s] = full + b
        heapq.heappush(heap, (used[s], s))
        out.append((h, p, s))
    return out, [max(0.0, target - u) for u in used]


def _split(points: DataFrame, nodes: list[tuple[int, int, int, float]], n_dims: int) -> DataFrame:
    """One level: points (node, h, bytes, d*) with the node of the next level.

    ``nodes``: first shard, first shard of the right side, node, and the share
    of the left side. Node ids are the first shard of the node.
    """
    spark = points.sparkSession
    table = F.broadcast(local_table(spark, nodes, "node long, right long, share double"))
    stats = points.groupBy("node").agg(F.sum("bytes").cast("double").alias("total"), *(f(f"d{i}").alias(f"{a}{i}") for i in range(n_dims) for f, a in ((F.min, "lo"), (F.max, "hi"))))
    widths = [F.struct((F.col(f"hi{i}") - F.col(f"lo{i}")).alias("w"), F.lit(-i).alias("i")) for i in range(n_dims)]
    widest = stats.join(table, "node").select("node", "right", (F.col("share") * F.col("total")).alias("want"), (-(F.greatest(*widths) if n_dims > 1 else widths[0])["i"]).alias("dim"))
    widest = F.broadcast(widest)
    hashed = F.shiftrightunsigned("h", 64 - _HIGH_BITS - _LOW_BITS)
    value = F.coalesce(*(F.when(F.col("dim") == i, F.col(f"d{i}")) for i in range(n_dims))).cast("long")
    placed = points.join(widest, "node", "left").withColumn("code", F.shiftleft(value, _HIGH_BITS + _LOW_BITS).bitwiseOR(hashed))
    high = F.shiftright("code", _LOW_BITS).alias("bucket")

    def quantile(sums: DataFrame, base: Column) -> DataFrame:
        """The last bucket of each node that starts before the wanted bytes, and where it starts."""
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("bucket"))
        start = base + F.col("upto") - F.col("bytes")
        return sums.withColumn("upto", upto).where(start < F.col("want")).groupBy("node").agg(F.max(F.struct("bucket", start.alias("start"), (F.col("want") - start > F.col("bytes") / 2).alias("whole"))).alias("q"))

    sums = placed.where("right is not null").groupBy("node", high).agg(F.sum("bytes").alias("bytes"), F.first("want").alias("want"))
    first = quantile(sums, F.lit(0.0)).select("node", F.col("q.bucket").alias("edge"), F.col("q.start").alias("start"))
    placed = placed.join(F.broadcast(first), "node", "left")
    low = placed.where(F.shiftright("code", _LOW_BITS) == F.col("edge")).groupBy("node", F.col("code").alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.first("want").alias("want"), F.first("start").alias("start"))
    second = quantile(low, F.col("start")).select("node", F.when(F.col("q.whole"), F.col("q.bucket")).otherwise(F.col("q.bucket") - 1).alias("cut"))
    placed = placed.join(F.broadcast(second), "node", "left")
    goes_right = F.col("right").isNotNull() & F.coalesce(F.col("code") > F.col("cut"), F.col("want") <= 0, F.lit(False))
    return placed.select(F.when(goes_right, F.col("right")).otherwise(F.col("node")).alias("node"), "h", "bytes", *(f"d{i}" for i in range(n_dims)))


def leaves(docs: DataFrame, *, text: str = "text", dimensions: dict[str, Column] | None = None, shards: int | None = None, target_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Where texts go: (h, shard) for most, (h, part, parts, shard) for large groups.

    ``shards`` or ``target_bytes`` (of text) decide how many leaves there are.
    """
    if dimensions is None:
        dimensions = {c: named(c) for c in ("source", "lang") if c in docs.columns} | {"length": length(text)}
    spark, n_dims = docs.sparkSession, len(dimensions)
    points = staged(_groups(docs, text, dimensions))
    total = points.agg(F.sum("bytes")).first()[0] or 0
    shards = shards or max(1, -(-total // target_bytes))
    if shards > MAX_SHARDS:
        raise ValueError(f"{shards} shards; raise target_bytes so that there are at most {MAX_SHARDS}")
    target = max(total / shards, 1.0)
    large = [(r.h, r.bytes) for r in points.where(F.col("bytes") >= LARGE * target).select("h", "bytes").toLocalIterator()] if shards > 1 else []
    placed, room = _deal(large, shards, target)
    parts: dict[int, int] = {}
    for h, _, _ in placed:
        parts[h] = parts.get(h, 0) + 1
    big = local_table(spark, [(h, p, parts[h], s) for h, p, s in placed], "h long, part int, parts int, shard int")
    small = points.where(F.col("bytes") < LARGE * target) if shards > 1 else points
    small = small.select(F.pmod("h", F.lit(1)).cast("long").alias("node"), "h", "bytes", *(f"d{i}" for i in range(n_dims)))
    level = [(0, shards)]
    while any(k > 1 for _, k in level):
        nodes, after = [], []
        for at, k in level:
            if k == 1:
                after.append((at, 1))
                continue
            half = k // 2
            left, both = sum(room[at : at + half]), sum(room[at : at + k])
            nodes.append((at, at + half, left / both if both else half / k))
            after += [(at, half), (at + half, k - half)]
        small, level = staged(_split(small, nodes, n_dims)), after
    return small.select("h", F.col("node").cast("int").alias("shard")), big


def shard(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    A null text counts as an empty one; nulls in a dimension are one value. The
    slot follows no order that means anything. Rows that are equal in key and
    text are interchangeable. An empty table gives no rows; a shard may stay
    empty if there are fewer texts than shards. Other columns stay; one named
    like a result column is replaced by it, and so are names from ``_kd_`` on.
    """
    inner = ("_kd_h", "_kd_k", "_kd_part", "_kd_parts", "_kd_n", "_kd_before", "_kd_rank", "_kd_b")
    docs = fresh(docs, "shard", "slot", *inner, needs=(key, text))
    small, big = leaves(docs, text=text, **kw)
    rows = docs.withColumns({"_kd_h": F.xxhash64(text_or_empty(text)), "_kd_k": F.xxhash64(F.lit(7), F.col(key), size_of(text))})
    many = F.broadcast(big.select(F.col("h").alias("_kd_h"), F.col("parts").alias("_kd_parts")).distinct())
    rows = rows.join(many, "_kd_h", "left").withColumn("_kd_part", F.pmod(F.col("_kd_k"), F.col("_kd_parts")).cast("int"))
    places = F.broadcast(big.select(F.col("h").alias("_kd_h"), F.col("part").alias("_kd_part"), "shard"))
    in_big = rows.where("_kd_parts is not null").join(places, ["_kd_h", "_kd_part"])
    in_small = rows.where("_kd_parts is null").join(small.select(F.col("h").alias("_kd_h"), "shard"), "_kd_h")
    rows = _with_slots(in_small.unionByName(in_big), key)
    return rows.select(*docs.columns, "shard", "slot")


def _with_slots(rows: DataFrame, key: str) -> DataFrame:
    """Number the rows of each shard: per hash bucket, plus the rows of the buckets before."""
    rows = rows.withColumn("_kd_b", F.pmod(F.xxhash64("_kd_k", "_kd_h"), F.lit(_SLOT_BUCKETS)))
    counts = rows.groupBy("shard", "_kd_b").agg(F.count(F.lit(1)).alias("_kd_n"))
    before = counts.select("shard", "_kd_b", (F.sum("_kd_n").over(Window.partitionBy("shard").orderBy("_kd_b")) - F.col("_kd_n")).alias("_kd_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_kd_b").orderBy(F.col(key), "_kd_k", "_kd_h")) - 1
    return rows.withColumn("_kd_rank", rank).join(before, ["shard", "_kd_b"]).withColumn("slot", (F.col("_kd_rank") + F.col("_kd_before")).cast("long"))
