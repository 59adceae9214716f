"""Language identification by the nearest centroid.

A text is the vector of its character n-grams of one to four characters inside
words, with the edges of words: n-grams are hashed to ``FEATURES`` numbers, and a
number weighs (1 + ln tf) * idf, over the length of the vector. A language has
several centroids, found by spherical k-means among its texts; a text belongs to
the language of the centroid with the largest cosine. It is rejected if its
distance (one less the cosine) is beyond what texts of that language and of about
that length are from it.

Document frequencies are counted over all texts that may be learnt from. The
centroids of a language are fitted to at most ``SAMPLE`` of its distinct texts,
those of the least hashes, each taken whole; a group of k-means is no larger, so
it is one task. All texts are scored whole, in one pass without a shuffle for
every ``SLICE_BYTES`` of centroids, which are broadcast.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import extended, fresh, in_arrow, staged
from tidebook.llm.textblocks import mix, text_blocks

ORDERS = (1, 2, 3, 4)
FEATURES = 1 << 16
CLUSTERS, ROUNDS = 4, 12
#: Distinct texts of a language that its centroids are fitted to, at most.
SAMPLE = 400
#: Centroids broadcast at once; more of them take another pass.
SLICE_BYTES = 32 << 20
#: Sample tables of up to so many rows are broadcast.
BROADCAST_KEYS = 1_000_000
BLOCK_CHARS = 1 << 18
#: Lengths, in letters, for which distances are calibrated: a text belongs to the last it reaches, or to the first.
LENGTHS = (16, 64, 256, 1024, 4096)
#: The share of calibration distances within the limit.
KEPT = 0.995
UNKNOWN = "und"
_U = np.uint32
_ODD = (_U(0x9E3779B1), _U(0x85EBCA77), _U(0xC2B2AE3D), _U(0x27D4EB2F))


def letter_runs() -> tuple[np.ndarray, np.ndarray]:
    """Runs of code points that are letters (2), marks (1) or neither (0), as kinds and lengths: small enough to go along with a task."""
    kinds = np.array(["NML".find(unicodedata.category(chr(i))[0]) for i in range(0x110000)]).clip(0)
    first = np.flatnonzero(np.diff(kinds, prepend=-1))
    return kinds[first].astype(np.int8), np.diff(first, append=0x110000)


def _tables(runs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Code point to symbol, 0 for what is no letter or mark; and which are letters."""
    kinds = np.repeat(*runs)
    return np.where(kinds > 0, np.arange(0x110000), 0).astype(_U), kinds == 2


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _ngrams(symbols: np.ndarray, owner: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-grams that end at position ``last`` or later, and whose they are.

    Inner characters are letters or marks; the first and the last may be the
    edge of a word, but not both of a pair.
    """
    inside = symbols > 0
    features, owners = [], []
    for n in ORDERS:
        if len(symbols) < n:
            break
        size = len(symbols) - n + 1
        total = np.full(size, _U(0x165667B1) * _U(n), _U)
        for k in range(n):
            total += symbols[k : k + size] * _ODD[k]
        good = inside[:size].copy() if n == 1 else inside[:size] | inside[1 : 1 + size] if n == 2 else np.ones(size, bool)
        for k in range(1, n - 1):
            good &= inside[k : k + size]
        if last >= n:
            good[: last - n + 1] = False
        total ^= total >> _U(15)
        total *= _U(0x2C1B3C6D)
        features.append((total[good] >> _U(16)).astype(_U))
        owners.append(owner[n - 1 :][good])
    return (np.concatenate(features), np.concatenate(owners)) if features else (np.zeros(0, _U), np.zeros(0, owner.dtype))


def _counted(texts: list[str | None], tables: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: its range, then text, feature and count of every feature of a text, in order, and the letters of each text."""
    symbol_of, letter = tables
    for a, z in text_blocks(texts, BLOCK_CHARS):
        if z == a + 1:  # a long text, piece by piece
            points = _points(texts[a] or "")
            counts = np.zeros(FEATURES, np.int64)
            padded = np.concatenate([[_U(0)], symbol_of[points], [_U(0)]]).astype(_U)
            for at in range(0, len(padded), BLOCK_CHARS):
                first = max(0, at - len(ORDERS) + 1)
                piece = padded[first : at + BLOCK_CHARS]
                counts += np.bincount(_ngrams(piece, piece, at - first)[0], minlength=FEATURES)
            feature = np.flatnonzero(counts)
            yield a, z, np.zeros(len(feature), np.int64), feature, counts[feature], np.array([letter[points].sum()])
            continue
        parts = [_points(t or "") for t in texts[a:z]]
        sizes = np.array([len(p) for p in parts])
        points = np.zeros(int(sizes.sum()) + 2 * (z - a), np.uint32)  # an edge before and after each text
        owner = np.repeat(np.arange(z - a, dtype=_U), sizes + 2)
        real = np.ones(len(points), bool)
        ends = np.cumsum(sizes + 2)
        real[ends - 1] = real[ends - sizes - 2] = False
        points[real] = np.concatenate(parts)
        feature, of = _ngrams(symbol_of[points], owner, 0)
        keys = np.sort((of << _U(16)) | feature)
        new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        counts = np.diff(np.append(new, len(keys)))
        letters = np.bincount(owner[letter[points]], minlength=z - a)
        yield a, z, (keys[new] >> _U(16)).astype(np.int64), (keys[new] & _U(0xFFFF)).astype(np.int64), counts, letters


def _weighted(text: np.ndarray, feature: np.ndarray, count: np.ndarray, idf: np.ndarray, texts: int) -> np.ndarray:
    """The entries of unit vectors."""
    w = (1 + np.log(count)) * idf[feature]
    norm = np.sqrt(np.bincount(text, w * w, texts))
    return w / norm[text]


def length_class(letters: np.ndarray) -> np.ndarray:
    return np.maximum(np.searchsorted(LENGTHS, letters, "right") - 1, 0)


# learning


def _document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts with letters and, for each feature, of those that hold it."""
    runs = letter_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, tables = np.zeros(FEATURES, np.int64), 0, _tables(runs)
        for batch in batches:
            for _, _, _, feature, _, letters in _counted(batch.column(0).to_pylist(), tables):
                df += np.bincount(feature, minlength=FEATURES)
                n += int((letters > 0).sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1), pa.int32()), pa.array(np.append(df[held], n))], ["feature", "n"])

    out, n = np.zeros(FEATURES), 0
    for feature, count in in_arrow(texts, run, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect():  # FEATURES rows
        if feature < 0:
            n = count
        else:
            out[feature] = count
    return n, out


def _sampled(rows: DataFrame, sample: int) -> DataFrame:
    """(lang, t) with at most ``sample`` distinct texts of a language, those of the least hashes.

    Hashes beyond twice the share wanted go before any are ranked, so a language
    of any size leaves a bounded group.
    """
    hashed = rows.withColumn("h", F.xxhash64("t"))
    distinct = staged(hashed.select("lang", "h").distinct())
    sizes = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(2.0 * sample + 50) / F.col("n")
    low = distinct.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_KEYS else sizes, "lang").where(F.col("h").cast("double") < (2 * share - 1) * 2.0**63)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    keys = staged(low.withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "h"))
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return hashed.join(keys, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])


def _vectors(sampled: DataFrame, idf) -> DataFrame:
    """For each text its vector and, as size ``k``, that of one piece of each of ``LENGTHS`` that it is longer than.

    A piece's place follows from the hash of its text, so all of a text can be one.
    """
    runs = letter_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(runs)
        for batch in batches:
            langs, texts, hashes = (c.to_pylist() for c in batch.columns)
            parts, source, size = [], [], []
            for i, (t, h) in enumerate(zip(texts, hashes)):
                for k, n in enumerate((None, *LENGTHS)):
                    if n is None or len(t) > n:
                        at = 0 if n is None else int(mix(np.array([h], np.int64).view(np.uint64) + np.uint64(k))[0]) % (len(t) - n)
                        parts.append(t if n is None else t[at : at + n])
                        source.append(i)
                        size.append(k - 1)
            for a, z, text, feature, count, letters in _counted(parts, tables):
                w = _weighted(text, feature, count, idf.value, z - a).astype(np.float32)
                offsets = pa.array(np.searchsorted(text, np.arange(z - a + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[i] for i in source[a:z]], pa.string()), pa.array([hashes[i] for i in source[a:z]], pa.int64()), pa.array(size[a:z], pa.int32()), pa.array(letters, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(feature, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(w))],
                    ["lang", "h", "size", "letters", "features", "weights"],
                )

    return in_arrow(sampled.select("lang", "t", "h"), run, "lang string, h long, size int, letters long, features array<int>, weights array<float>").where("letters > 0")


def k_means(x: np.ndarray, clusters: int, rounds: int = ROUNDS) -> np.ndarray:
    """The cluster of each unit vector; starts at vectors evenly spaced in the order of their cosine with the sum of all.

    Starts farthest from each other would be outliers.
    """
    order = np.argsort(x @ x.sum(axis=0), kind="stable")
    k = min(clusters, len(x))
    seeds = order[(2 * np.arange(k) + 1) * len(x) // (2 * k)]
    centres = x[seeds]
    own = np.full(len(x), -1)
    for _ in range(rounds):
        now = np.argmax(x @ centres.T, axis=1)
        if (now == own).all():
            break
        own = now
        held = np.unique(own)
        centres = np.stack([x[own == c].sum(axis=0) for c in held])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        own = np.searchsorted(held, own)
    return own


def _fitted(group: pa.Table, clusters: int) -> pa.Table:
    """The centroids of one language's sample, and how far texts of each length are from those of the other texts."""
    group = group.combine_chunks()
    features, weights = (group["features"].combine_chunks(), group["weights"].combine_chunks())
    lengths = np.diff(features.offsets.to_numpy())
    active, column = np.unique(features.flatten().to_numpy(), return_inverse=True)
    x = np.zeros((len(group), len(active)), np.float32)
    x[np.repeat(np.arange(len(group)), lengths), column] = weights.flatten().to_numpy()
    size, h, letters = (group[c].to_numpy() for c in ("size", "h", "letters"))
    order = np.flatnonzero(size == -1)
    order = order[np.argsort(h[order])]
    whole = x[order]
    own = k_means(whole, clusters)
    sums = np.stack([whole[own == c].sum(axis=0) for c in range(own.max() + 1)])
    centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)

    # every vector against the centroids, that of its text's cluster without the text
    text = np.searchsorted(h[order], h)
    others = x @ centres.T
    without = sums[own] - whole
    norm = np.linalg.norm(without, axis=1)
    rest = np.einsum("ij,ij->i", x, without[text]) / np.maximum(norm[text], 1e-6)
    others[np.arange(len(x)), own[text]] = np.where(norm[text] > 1e-3, rest, 0)
    distance = 1 - others.max(axis=1)
    kind = length_class(letters)
    limits, limit = [], 1.0
    for k in range(len(LENGTHS)):
        if len(order) > 1 and (kind == k).any():
            limit = float(np.quantile(distance[kind == k], KEPT, method="higher"))
        limits.append(limit)
    rows = [(np.flatnonzero(c), c[c != 0]) for c in centres]
    return pa.table(
        {
            "lang": pa.array([group["lang"][0].as_py()] * len(rows), pa.string()),
            "features": pa.array([active[at] for at, _ in rows], pa.list_(pa.int32())),
            "weights": pa.array([v for _, v in rows], pa.list_(pa.float32())),
            "limits": pa.array([limits] * len(rows), pa.list_(pa.float64())),
        }
    )


@dataclass
class Model:
    """Inverse document frequencies and the table (lang, features, weights, limits) of centroids."""

    idf: np.ndarray
    centroids: DataFrame | None = None
    slices: list[list[str]] = field(default_factory=list)


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """Centroids of every language that has a text with a letter; rows with a null text or language are left out.

    The caller decides what rows may be learnt from. Repeated texts of a
    language count once for its centroids and each time for the document
    frequencies. Without rows there is no language.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"))
    n, df = _document_frequencies(rows.select("t"))
    idf = np.log((1 + n) / (1 + df)) + 1
    sent = docs.sparkSession.sparkContext.broadcast(idf)  # FEATURES doubles
    vectors = _vectors(_sampled(rows, sample), sent)

    def fit(group: pa.Table) -> pa.Table:
        return _fitted(group, clusters)

    centroids = staged(vectors.groupBy("lang").applyInArrow(fit, "lang string, features array<int>, weights array<float>, limits array<double>"))
    per_slice = max(1, SLICE_BYTES // (4 * FEATURES * clusters))
    langs = sorted(r.lang for r in centroids.select("lang").distinct().collect())  # one value for each language
    return Model(idf, centroids, [langs[i : i + per_slice] for i in range(0, len(langs), per_slice)])


# scoring


@dataclass
class _Slice:
    """Centroids of some languages as one matrix, features x centroids."""

    idf: np.ndarray
    langs: list[str]
    lang_of: np.ndarray
    table: np.ndarray
    limits: np.ndarray


def _slice(model: Model, langs: list[str]) -> _Slice:
    rows = model.centroids.where(F.col("lang").isin(langs)).collect()  # at most SLICE_BYTES
    rows.sort(key=lambda r: (r.lang, r.features[:50], r.weights[:50]))
    table = np.zeros((FEATURES, len(rows)), np.float32)
    for k, r in enumerate(rows):
        table[r.features, k] = r.weights
    limits = {r.lang: r.limits for r in rows}
    return _Slice(model.idf, langs, np.array([langs.index(r.lang) for r in rows]), table, np.array([limits[x] for x in langs]))


def _cosines(own: _Slice, text: np.ndarray, feature: np.ndarray, w: np.ndarray, texts: int) -> np.ndarray:
    """Texts x centroids."""
    out = np.zeros((texts, own.table.shape[1]))
    for a in range(0, len(text), 1 << 16):
        part = text[a : a + (1 << 16)]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        products = own.table[feature[a : a + (1 << 16)]] * w[a : a + (1 << 16), None].astype(np.float32)
        out[part[starts]] += np.add.reduceat(products, starts, axis=0)
    return out


_FOUND = {"nearest": "string", "score": "double", "rejected": "boolean"}


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``nearest``, ``score`` and ``rejected``.

    ``nearest`` is the language of the nearest centroid (of equals, the first by
    code point) and ``score`` the cosine with it, from 0 to 1. ``rejected`` tells
    that its distance is beyond the language's limit; ``lang_pred`` is ``nearest``,
    or ``und`` where rejected. A null text, one without a letter (an empty one,
    too) and every text under a model without languages is ``und`` in both,
    with score 0, and rejected. Repeated rows are judged alike; an empty table
    gives no rows. Other columns stay; one named like a result column is
    replaced by it.
    """
    out = fresh(docs, "lang_pred", *_FOUND, needs=(text,))
    schema = extended(out, ", ".join(f"{k} {v}" for k, v in _FOUND.items()))
    if not model.slices:
        out = out.withColumns({"nearest": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    for k, langs in enumerate(model.slices):
        own = docs.sparkSession.sparkContext.broadcast(_slice(model, langs))  # SLICE_BYTES at most
        out = in_arrow(out, _judge(own, text, k > 0), schema)
    return out.withColumn("lang_pred", F.when(F.col("rejected"), UNKNOWN).otherwise(F.col("nearest")))


def _judge(sent, text: str, later: bool):
    runs = letter_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = sent.value, _tables(runs)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            names = batch.schema.names[: len(batch.schema.names) - len(_FOUND) * later]
            nearest, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for a, z, of, feature, count, letters in _counted(texts, tables):
                cosine = _cosines(own, of, feature, _weighted(of, feature, count, own.idf, z - a), z - a)
                best = np.argmax(cosine, axis=1)  # centroids are in the order of their languages
                top = np.clip(cosine[np.arange(z - a), best], 0, 1)
                lang = own.lang_of[best]
                has = letters > 0
                score[a:z] = np.where(has, top, 0)
                rejected[a:z] = ~has | (1 - top > own.limits[lang, length_class(letters)])
                nearest[a:z] = [own.langs[i] if h else UNKNOWN for i, h in zip(lang, has)]
            if later:
                before = [batch.column(c) for c in _FOUND]
                held = before[1].to_numpy(zero_copy_only=False) >= score  # languages of former slices come first
                nearest = [b if h else x for b, x, h in zip(before[0].to_pylist(), nearest, held)]
                score = np.where(held, before[1], score)
                rejected = np.where(held, before[2].to_numpy(zero_copy_only=False), rejected)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(nearest, pa.string()), pa.array(score), pa.array(rejected)], [*names, *_FOUND])

    return run


def held_out(key: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: a quarter, by the checksum of the key as text."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
