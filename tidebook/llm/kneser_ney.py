"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, in fours; every character of the trusted text is a
symbol of its own, beside a boundary and one symbol for characters never trusted.
An n-gram is its context (up to three symbols of 21 bits) and its last symbol.
Counts are taken over all trusted documents and sharded by the n-gram.
Continuation counts of the lower orders, the discounts for counts of one, two and
three or more, the weights of the contexts and the interpolated probabilities
come from aggregations and joins of these shards. These tables grow with the
trusted text and stay tables.

Documents are scored whole. The most frequent n-grams of each order (``HEAD``)
are sent to the tasks, which look up what they can; what remains of a document is
counted and joined to the tables, with the shorter n-grams where one was never
seen. ``HEAD`` decides where a probability is looked up, not what it is.

Documents are scored by the model of all trusted documents. Those of a language
are kept up to a quantile of the perplexities of its trusted documents, each
under a model that was not trained on it: the n-grams are counted once for each
fold of the trusted documents, and such a model takes the counts of all folds but
one. This holds for any number of trusted documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import extended, fresh, in_arrow, staged
from tidebook.llm.textblocks import mix, text_blocks

ORDER, BITS = 4, 21
#: The uniform distribution below the first order is over so many symbols at least.
LEAST_SYMBOLS = 64
QUANTILE = 0.99
LEAST_DISCOUNT = 1e-3
#: Parts of the trusted documents; each is scored by a model of the others.
FOLDS = 5
#: Key tables of up to so many rows are broadcast.
BROADCAST_KEYS = 2_000_000
#: So many n-grams of each order, the most frequent, are broadcast; others are joined.
HEAD = 1_000_000
BLOCK_CHARS = 1 << 20
_END = chr(0x10FFFF)  # not a character; becomes the boundary
_U = np.uint64


def _symbols(alphabet: list[int]) -> np.ndarray:
    """Code point to symbol: 0 the boundary, from 1 on the alphabet, then one for all others."""
    table = np.full(0x110000, len(alphabet) + 1, np.int32)
    table[alphabet] = np.arange(1, len(alphabet) + 1)
    table[0x10FFFF] = 0
    return table


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _fours(symbols: np.ndarray) -> np.ndarray:
    """Context and last symbol of the four that ends at each symbol from the fourth on, one row each."""
    s = symbols.astype(np.int64)
    return np.stack([(s[:-3] << 2 * BITS) | (s[1:-2] << BITS) | s[2:-1], s[3:]], axis=1)


def _hashed(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64 bits that stand for an n-gram inside a task; 0 is no n-gram."""
    return np.maximum(mix(mix(context.view(_U) + _U(1)) + last.astype(_U) * _U(0x9FB21C651E98DF25)), _U(1))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of all parts and their sums."""
    rows, n = (np.concatenate(x) for x in zip(*parts))
    _, first, where = np.unique(_hashed(rows[:, 0].copy(), rows[:, 1]), return_index=True, return_inverse=True)
    return rows[first], np.bincount(where, n, len(first)).astype(np.int64)


def _events(texts: list[str | None], table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fours of blocks of texts and the text each belongs to; three boundaries before a text, one after it.

    A text longer than a block comes in pieces.
    """
    for a, z in text_blocks(texts, BLOCK_CHARS):
        part = [t or "" for t in texts[a:z]]
        if len(part) == 1:
            padded = _END * 3 + part[0] + _END
            for at in range(3, len(padded), BLOCK_CHARS):
                fours = _fours(table[_points(padded[at - 3 : at + BLOCK_CHARS])])
                yield fours, np.full(len(fours), a)
            continue
        fours = _fours(table[_points(_END * 3 + (_END * 3).join(part) + _END)])
        sizes = np.array([len(t) for t in part])
        owner = np.repeat(np.arange(a, z), sizes + 3)[: len(fours)]
        real = np.ones(len(fours), bool)
        ends = np.cumsum(sizes + 3)[:-1]
        real[ends - 1] = real[ends - 2] = False  # the second and third boundary between two texts
        yield fours[real], owner[real]


def trusted_rows(docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is in ``trusted``, staged: their texts are looked for, and perhaps shuffled, once."""
    keys = staged(trusted.select(F.col(key).alias("_key")).where("_key is not null").distinct())
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return staged(docs.join(keys, F.col(key) == F.col("_key"), "left_semi"))


def _alphabet(texts: DataFrame) -> list[int]:
    """All code points of the texts, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(0x110000, bool)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for at in range(0, len(t), BLOCK_CHARS):
                    found[_points(t[at : at + BLOCK_CHARS])] = True
        found[0x10FFFF] = False
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found), pa.int64())], ["point"])

    return sorted(r.point for r in in_arrow(texts, run, "point long").distinct().collect())


def _counts(texts: DataFrame, alphabet: list[int]) -> DataFrame:
    """(fold, context, last, n): how often each four stands in the texts of a fold, summed in each task before the shuffle."""

    def batch_of(fold: int, rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), fold, np.int32)), pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(n)], ["fold", "context", "last", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = _symbols(alphabet), {fold: [] for fold in range(FOLDS)}
        for batch in batches:
            folds = batch.column(1).to_numpy()
            for fours, owner in _events(batch.column(0).to_pylist(), table):
                for fold in np.unique(folds[owner]).tolist():
                    own = fours[folds[owner] == fold]
                    held[fold].append((own, np.ones(len(own))))
                    if sum(len(n) for _, n in held[fold]) > 2 * BLOCK_CHARS // FOLDS:
                        held[fold] = [_summed(held[fold])]
                        if len(held[fold][0][1]) > BLOCK_CHARS // FOLDS:
                            yield batch_of(fold, *held[fold].pop())
        for fold, rest in held.items():
            if rest:
                yield batch_of(fold, *_summed(rest))

    return in_arrow(texts, run, "fold int, context long, last long, n long").groupBy("fold", "context", "last").agg(F.sum("n").alias("n"))


def _shorter(k: int) -> Column:
    """The context of an n-gram of order ``k`` without its first symbol."""
    return F.col("context").bitwiseAND(F.lit((1 << BITS * (k - 2)) - 1))


def _discounts(grams: DataFrame) -> tuple[float, float, float]:
    """The discounts of counts of one, of two, and of three or more, from the counts of counts.

    At least ``LEAST_DISCOUNT``, so that every symbol stays possible.
    """
    row = grams.agg(*(F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4))).first()
    y = row[0] / max(1, row[0] + 2 * row[1])
    return tuple(min(float(k), max(LEAST_DISCOUNT, k - (k + 1) * y * row[k] / max(1, row[k - 1]))) for k in (1, 2, 3))


def _interpolated(grams: DataFrame, lower: DataFrame | None, k: int, symbols: int) -> tuple[DataFrame, DataFrame]:
    """Order ``k``: (context, last, n, p) of the n-grams seen and (context, n, gamma), the weight left to the shorter n-gram.

    ``lower`` is that of the order below; every shorter n-gram of one seen is in
    it. Below the first order stands the uniform distribution.
    """
    one, two, more = _discounts(grams)
    discount = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
    rows = grams.select("context", "last", "n", discount.alias("d"))
    contexts = staged(rows.groupBy("context").agg(F.sum("n").alias("n"), (F.sum("d") / F.sum("n")).alias("gamma")))
    rows = rows.join(contexts.withColumnRenamed("n", "total"), "context")
    if lower is None:
        rows = rows.withColumn("q", F.lit(1.0 / symbols))
    else:
        rows = rows.withColumn("shorter", _shorter(k)).join(lower.select(F.col("context").alias("shorter"), "last", F.col("p").alias("q")), ["shorter", "last"])
    p = (F.col("n") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("q")
    return staged(rows.select("context", "last", "n", p.alias("p"))), contexts


class _Lookup:
    """Values by 64-bit key: open addressing in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, (2 * len(keys)).bit_length())
        self.down = _U(64 - bits)
        self.keys, self.values = np.zeros(1 << bits, _U), np.zeros(1 << bits)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]  # of several, one stays
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.down).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, NaN where there is none."""
        out, at, slot = np.full(len(keys), np.nan), np.arange(len(keys)), self._slot(keys)
        while len(at):
            own = self.keys[slot]
            hit = own == keys[at]
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (own != 0)
            at, slot = at[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


@dataclass
class _Head:
    """For each order, from the first: frequent n-grams, contexts, and whether these are all."""

    alphabet: list[int]
    symbols: int
    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]

    def log_probabilities(self):
        """A function from contexts and last symbols to logarithms, NaN where the tables must be asked."""
        known = [(_Lookup(g, np.log(p)), _Lookup(c, np.log(w)), whole) for g, p, c, w, whole in self.orders]

        def of(context: np.ndarray, last: np.ndarray) -> np.ndarray:
            out, at, left = np.full(len(last), np.nan), np.arange(len(last)), np.zeros(len(last))
            for k in range(ORDER, 0, -1):
                grams, contexts, whole = known[k - 1]
                found = grams.get(_hashed(context, last))
                out[at] = left + found
                if not whole:
                    return out
                on = np.isnan(found)
                at, context, last = at[on], context[on], last[on]
                left = left[on] + np.nan_to_num(contexts.get(_hashed(context, np.zeros(len(last), np.int64))))
                context = context & ((1 << BITS * max(0, k - 2)) - 1)
            out[at] = left - np.log(self.symbols)
            return out

        return of


@dataclass
class Model:
    """For each order, from the first: the tables (context, last, n, p) and (context, n, gamma)."""

    alphabet: list[int]
    symbols: int
    orders: list[tuple[DataFrame, DataFrame]]

    def head(self) -> _Head:
        """What is broadcast: at most ``HEAD`` n-grams of each order and, where these are all, its contexts."""
        out = []
        for grams, contexts in self.orders:
            whole = grams.count() <= HEAD
            g = (grams if whole else grams.orderBy(F.desc("n"), "context", "last").limit(HEAD)).select("context", "last", "p").toPandas()
            c = contexts.select("context", "gamma").where(F.lit(whole)).toPandas()
            c0 = c["context"].to_numpy(np.int64)
            out.append((_hashed(g["context"].to_numpy(np.int64), g["last"].to_numpy(np.int64)), g["p"].to_numpy(float), _hashed(c0, np.zeros(len(c0), np.int64)), c["gamma"].to_numpy(float), whole))
        return _Head(self.alphabet, self.symbols, out)

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """(context, last, p) of the distinct fours of ``asked``, by joins to the tables of all orders."""
        wanted = [staged(asked.select("context", "last").distinct())]
        for k in range(ORDER, 1, -1):
            wanted.insert(0, staged(wanted[0].select(_shorter(k).alias("context"), "last").distinct()))
        lower = None
        for k, (own, (grams, contexts)) in enumerate(zip(wanted, self.orders), 1):
            rows = own.join(grams.select("context", "last", F.col("p").alias("seen")), ["context", "last"], "left").join(contexts.select("context", "gamma"), "context", "left")
            if lower is None:
                rows = rows.withColumn("q", F.lit(1.0 / self.symbols))
            else:
                rows = rows.withColumn("shorter", _shorter(k)).join(lower.select(F.col("context").alias("shorter"), "last", F.col("p").alias("q")), ["shorter", "last"])
            lower = staged(rows.select("context", "last", F.coalesce("seen", F.coalesce("gamma", F.lit(1.0)) * F.col("q")).alias("p")))
        return lower


def _model(counts: DataFrame, alphabet: list[int]) -> Model:
    """The model of n-grams counted in any folds."""
    symbols = max(LEAST_SYMBOLS, len(alphabet) + 2)
    seen = [staged(counts.groupBy("context", "last").agg(F.sum("n").alias("n")))]
    for k in range(ORDER, 1, -1):  # in how many contexts each shorter n-gram stands
        seen.insert(0, staged(seen[0].groupBy(_shorter(k).alias("context"), "last").agg(F.count(F.lit(1)).alias("n"))))
    orders = []
    for k, grams in enumerate(seen, 1):
        orders.append(_interpolated(grams, orders[-1][0] if orders else None, k, symbols))
    return Model(alphabet, symbols, orders)


def _counted(own: DataFrame, key: str, text: str) -> tuple[DataFrame, list[int]]:
    texts = own.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), _fold(key).cast("int").alias("fold"))
    alphabet = _alphabet(texts.select("t"))
    return _counts(texts, alphabet), alphabet


def train(docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text") -> Model:
    """The model of the documents whose key is in ``trusted``; null keys and texts are left out.

    Without trusted documents every symbol is as likely as any other.
    """
    return _model(*_counted(trusted_rows(docs.select(key, text), trusted, key=key), key, text))


def train_folds(own: DataFrame, *, key: str = "doc_id", text: str = "text") -> tuple[Model, dict[int, Model]]:
    """From the ``trusted_rows``, the model of all of them and, for the first fold and every other one with a row, that of all other folds; as ``train``.

    The n-grams are counted once. All models know the characters of all trusted documents.
    """
    counts, alphabet = _counted(own, key, text)
    counts = staged(counts)
    whole = _model(counts, alphabet)
    folds = {0} | {r.fold for r in own.select(_fold(key).cast("int").alias("fold")).distinct().collect()}
    counted = {r.fold for r in counts.select("fold").distinct().collect()}  # a fold of null texts takes nothing from the model
    return whole, {fold: _model(counts.where(F.col("fold") != fold), alphabet) if fold in counted else whole for fold in sorted(folds)}


def score(docs: DataFrame, model: Model, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``perplexity``: per symbol, the end of the text included; without the text unless ``keep_text``.

    A null or empty text has only its end to predict. Repeated rows are scored
    alike. Other columns stay; one named like the result column is replaced by it.
    """
    docs = fresh(docs, "perplexity", needs=(text,))
    head = model.head()
    sent = docs.sparkSession.sparkContext.broadcast(head)  # at most HEAD n-grams of each order
    columns = [c for c in docs.columns if keep_text or c != text]
    schema = extended(docs.select(columns), "_known double, _symbols long, _rest array<struct<context: long, last: long, n: long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, likely = _symbols(sent.value.alphabet), sent.value.log_probabilities()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            total, n, rest = np.zeros(len(texts)), np.zeros(len(texts), np.int64), [[] for _ in texts]
            for fours, owner in _events(texts, table):
                first, last = owner[0], owner[-1] + 1
                logs = likely(fours[:, 0].copy(), fours[:, 1].copy())
                total[first:last] += np.bincount(owner - first, np.nan_to_num(logs), last - first)
                n[first:last] += np.bincount(owner - first, minlength=last - first)
                asked = np.flatnonzero(np.isnan(logs))
                for part in np.split(asked, np.flatnonzero(np.diff(owner[asked])) + 1) if len(asked) else ():
                    own, count = _summed([(fours[part], np.ones(len(part)))])
                    rest[owner[part[0]]] += [{"context": c, "last": s, "n": m} for (c, s), m in zip(own.tolist(), count.tolist())]
            kind = pa.list_(pa.struct([("context", pa.int64()), ("last", pa.int64()), ("n", pa.int64())]))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total), pa.array(n), pa.array(rest, kind)], [*columns, "_known", "_symbols", "_rest"])

    rows = in_arrow(docs, run, schema)
    perplexity = lambda known: F.exp(-known / F.greatest("_symbols", F.lit(1))).alias("perplexity")
    if all(order[-1] for order in head.orders):
        return rows.select(*columns, perplexity(F.col("_known")))
    rows = staged(rows.withColumn("_id", F.monotonically_increasing_id()))
    asked = rows.select("_id", F.explode("_rest").alias("r")).select("_id", "r.*")
    likely = asked.join(model.probabilities(asked), ["context", "last"]).groupBy("_id").agg(F.sum(F.col("n") * F.log("p")).alias("_more"))
    rows = rows.drop("_rest").join(likely, "_id", "left")
    return rows.select(*columns, perplexity(F.col("_known") + F.coalesce("_more", F.lit(0.0))))


def _fold(key: str) -> Column:
    return F.crc32(F.concat(F.lit("fold:"), F.col(key).cast("string")).cast("binary")) % FOLDS


def cross_fitted(own: DataFrame, models: dict[int, Model], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each of the ``trusted_rows``, scored by the model without its fold."""
    out = None
    for fold, model in models.items():
        part = staged(score(own.where(_fold(key) == fold), model, text=text, keep_text=False))
        out = out.union(part) if out else part
    return out


def thresholds(calibration: DataFrame, *, lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """(lang, n, limit) of scored trusted documents; a row with n null stands for all languages together."""
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    each = calibration.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"), limit.alias("limit"))
    return each.union(calibration.agg(F.lit(None).cast("string"), F.lit(None).cast("long"), limit))


def judged(scored: DataFrame, limits: DataFrame, *, lang: str = "lang") -> DataFrame:
    """``scored`` with ``threshold`` and ``keep``: perplexity up to the threshold of the language.

    A null language is one of its own; a language without any trusted document
    takes the threshold of all together, and without any trusted document all rows are kept.
    """
    scored = fresh(scored, "threshold", "keep", "_lang", "_limit", needs=(lang, "perplexity"))
    own = limits.where("n is not null").select(F.col("lang").alias("_lang"), F.col("limit").alias("_limit"))
    anyone = limits.where("n is null").agg(F.max("limit")).first()[0]
    rows = scored.join(own, F.col(lang).eqNullSafe(F.col("_lang")), "left").withColumn("threshold", F.coalesce("_limit", F.lit(anyone).cast("double")))
    return rows.drop("_lang", "_limit").withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def classify(docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """(key, lang, perplexity, threshold, keep) of every document; ``trusted`` holds keys of trusted ones.

    The perplexity, of trusted documents too, is under the model of all trusted
    ones; the thresholds are of models that leave a trusted document's fold out. A null or empty text has only its end to predict. Repeated rows are scored
    alike; repeated keys in ``trusted`` count once, null ones are left out. A null
    language is one of its own. A language without trusted documents takes the
    threshold of all together; without any, all rows are kept. Rows at the
    threshold are kept. An empty table gives no rows.
    """
    docs = docs.select(key, lang, text)
    own = trusted_rows(docs, trusted, key=key)
    whole, without = train_folds(own, key=key, text=text)
    scored = staged(score(docs, whole, text=text, keep_text=False))
    calibration = cross_fitted(own, without, key=key, text=text)
    return judged(scored, staged(thresholds(calibration, lang=lang, quantile=quantile)), lang=lang)
