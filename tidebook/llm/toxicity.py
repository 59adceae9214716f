"""Toxicity by compression distance to two zstandard dictionaries.

One dictionary is trained on windows of ordinary text, one on windows of toxic
text. Windows are of two widths, over the whole text: each different word between blanks,
and ``SPAN`` words, a new one every ``STEP`` words, which show phrases of ordinary
words. A window is compressed with each dictionary; how many bytes the toxic one
saves over the ordinary one is its distance. A window that shares too little with
the toxic dictionary to save bytes that count (``RUNS``, ``LEAST``) is counted
with a distance of 0 and not compressed. A text's score is a logistic
function, for both widths, of how many windows are beyond each of some thresholds
more than ordinary texts of that length have, calibrated on labelled texts that
the dictionaries have not seen.

Toxic texts are mostly made of ordinary words, so the toxic dictionary is trained
on what has a mark: for words on those that hold a marked fragment, for the wide
windows on passages, runs of words covered by marks, with the ordinary dictionary
before them, as the other words of a window are ordinary. A mark is a fragment of a word, or two to four words in a
row, that stands in many toxic texts and in next to no ordinary ones. Texts count,
not occurrences, so that a long text names no marks, and different contexts
(word before, word after) must be as many, so that a text with many copies
doesn't either.

The model is fitted on a bounded sample of the labelled rows, each taken whole
(``SAMPLE`` documents of each class), in folds: each third is scored by
dictionaries of the other two, for any number of rows; the first of these
dictionaries are used. Contexts, passages, windows and features are found in
tasks; only marks, at most ``PASSAGES`` passages and ``WINDOWS``
windows (those of the least hashes) and the features reach the driver. Scoring
covers all texts whole, in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import probminhash
from tidebook.llm.common import extended, fresh, in_arrow, set_aside, staged
from tidebook.llm.textblocks import folded_words, mix, word_hashes

SAMPLE = 2000
FOLDS = 3
SPAN, STEP = 8, 4
ORDINARY_BYTES, TOXIC_BYTES = 16_000, 8_192
#: What is sent to the driver to train dictionaries on, at most.
PASSAGES, WINDOWS = 20_000, 30_000
PHRASES = (2, 3, 4)
MIN_TEXTS, MIN_RATIO, MIN_EVIDENCE = 4, 8.0, 8.0
#: Phrases are many, so more evidence is asked of them.
MIN_PHRASE_EVIDENCE = 14.0
#: Distances from this on count as this.
TOP = 15
#: Distances that words and windows are counted from: few ordinary ones reach them, in any language.
STEPS = ((3, 4, 5, 6, 7, 8, 9), (7, 8, 10, 12))
#: Those whose numbers of words and windows are features.
COUNTED = ((3, 4, 6), (7, 8, 10, 12))
#: A width's threshold is the first distance that at most this share of the ordinary texts reach with any window.
REACHED = 0.005
#: Level and usual input size of the compressor of words and of that of windows.
LEVELS = ((6, 96), (4, 160))
CACHE = 100_000
#: Words and windows are compressed that share so many bytes in a row with their toxic dictionary, from so many places on: a window six bytes, or five twice.
RUNS, LEAST = (4, 5), (1, 2)
#: Fragments and phrases that a task holds before it sums them, and the share of ordinary texts, one in so many, that are looked at first.
HELD, PART = 2_000_000, 4
_CARRIER = bytes(range(0x21, 0x61))  # follows every window: short inputs are else stored as they are
_U = np.uint64


def words_of(text: str) -> list[bytes]:
    return folded_words(text.lower().encode(errors="replace"))


def _spaced(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def windows_of(words: list[bytes]) -> list[bytes]:
    """Windows over all words; a text of fewer words than a window has one of them all."""
    return [_spaced(words[k : k + SPAN]) for k in range(0, max(1, len(words) - SPAN + STEP), STEP)] if words else []


def _fragments(word: bytes) -> tuple[int, ...]:
    """Hashes of the runs of five to seven bytes of a word and the blanks beside it; even."""
    w = _spaced([word])
    return tuple({xxhash.xxh64_intdigest(w[i : i + n]) & ~1 for n in (5, 6, 7) for i in range(len(w) - n + 1)})


def _phrases(words: list[bytes], n: int) -> np.ndarray:
    """A hash of each run of ``n`` words; odd."""
    h = word_hashes(b" ".join(words))[1]
    out = np.full(max(0, len(h) - n + 1), _U(n))
    for k in range(n):
        out = mix(out + h[k : k + len(out)] * _U(2 * k + 3))
    return out | _U(1)


def _evidence(n, u, share: float):
    """Log-likelihood ratio, in nats, of own rates of toxic and ordinary texts against one rate for both."""
    n, u = np.asarray(n, float), np.asarray(u, float)
    return n * np.log(n / ((n + u) * share)) + np.where(u > 0, u * np.log(np.maximum(u, 1) / ((n + u) * (1 - share))), 0.0)


def _are_marks(hashes, n, u, share: float) -> np.ndarray:
    """Which of the hashed fragments and phrases, in ``n`` toxic texts and ``u`` ordinary ones, are marks; ``share`` of all texts are toxic."""
    n, u = np.maximum(n, 1e-9), np.asarray(u, float)
    least = np.where(hashes & _U(1), MIN_PHRASE_EVIDENCE, MIN_EVIDENCE)
    return (n >= MIN_TEXTS) & (n * (1 - share) >= MIN_RATIO * share * (u + 1)) & (_evidence(n, u, share) >= least)


@dataclass
class Marks:
    """Hashes of the fragments and of the phrases that mark a passage."""

    fragments: frozenset[int]
    phrases: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray) -> Marks:
        odd = (hashes & _U(1)).astype(bool)
        return Marks(frozenset(hashes[~odd].tolist()), hashes[odd])

    def passages(self, words: list[bytes]) -> Iterator[tuple[bool, bytes]]:
        """Words with a marked fragment (False), and the longest runs of words covered by marks (True)."""
        marked = {w: not self.fragments.isdisjoint(_fragments(w)) for w in set(words)}
        covered = np.array([marked[w] for w in words], bool)
        for k in np.flatnonzero(covered):
            yield False, _spaced([words[k]])
        for n in PHRASES:
            for at in np.flatnonzero(np.isin(_phrases(words, n), self.phrases)):
                covered[at : at + n] = True
        edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
        for a, z in zip(edges[::2], edges[1::2]):
            yield True, _spaced(words[a:z])


def _marks_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The fragments and phrases of a text, each once, and the context of each where it stands first."""
    padded = np.concatenate([[_U(1)], word_hashes(b" ".join(words))[1], [_U(1)]])
    first: dict[bytes, int] = {}  # each different word and where it stands first
    seen: dict[int, int] = {}
    around = mix(padded[:-2] * _U(3) + padded[2:] * _U(5)).tolist() if words else []
    for w, context in zip(reversed(words), reversed(around)):
        first[w] = context
    for w, context in first.items():
        for f in _fragments(w):
            seen.setdefault(f, context)
    marks, contexts = [np.fromiter(seen.keys(), _U, len(seen))], [np.fromiter(seen.values(), _U, len(seen))]
    for n in PHRASES:
        own, at = np.unique(_phrases(words, n), return_index=True)
        marks.append(own)
        contexts.append(mix(padded[at] * _U(3) + padded[at + n + 1] * _U(5)))
    return np.concatenate(marks).view(np.int64), np.concatenate(contexts).view(np.int64)


def _columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of whole numbers, as Arrow: neither side of the driver makes an object of a row."""
    return [c.to_numpy().astype(np.int64) for c in df.toArrow().columns]


def _often(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What stands in at least ``MIN_TEXTS`` of the texts, in order, and in how many; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            marks, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(marks), pa.array(n)], ["mark", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(_marks_of(words_of(t))[0])
                if sum(map(len, held)) > HELD:
                    yield summed()
        if held:
            yield summed()

    found = in_arrow(rows.select("t"), run, "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n"))
    mark, n = _columns(found.where(F.col("n") >= MIN_TEXTS).select("mark", "n"))
    order = np.argsort(mark)
    return mark[order], n[order]


def _counts(rows: DataFrame, of: np.ndarray) -> DataFrame:
    """(y, fold, mark, n): in how many texts each of the marks ``of``, which are in order, stands, or, if they are fewer, in how many contexts."""
    asked = rows.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = asked.value
        for batch in batches:
            for y, fold, t in zip(*(c.to_pylist() for c in batch.columns)):
                mark, context = _marks_of(words_of(t))
                at = np.searchsorted(known, mark)
                own = known[np.minimum(at, len(known) - 1)] == mark if len(known) else np.zeros(len(mark), bool)
                mark, context = mark[own], context[own]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mark), y, np.int32)), pa.array(np.full(len(mark), fold, np.int32)), pa.array(mark), pa.array(context)], ["y", "fold", "mark", "context"])

    found = in_arrow(rows.select("y", "fold", "t"), run, "y int, fold int, mark long, context long")
    contexts = found.groupBy("y", "fold", "mark", "context").agg(F.count(F.lit(1)).alias("texts"))
    return contexts.groupBy("y", "fold", "mark").agg(F.least(F.sum("texts"), F.count(F.lit(1))).alias("n"))


def _candidates(rows: DataFrame, odds: float) -> np.ndarray:
    """All that can be a mark, in order, so that no contexts of anything else are counted.

    It stands in enough toxic texts, and a part of the ordinary texts doesn't
    show yet that it stands in too many of them.
    """
    marks, n = _often(rows.where("y = 1"))
    part = _counts(rows.where((F.col("y") == 0) & (F.pmod(F.xxhash64("t"), F.lit(PART)) == 0)), marks)
    least = part.groupBy("mark").agg(*(F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(FOLDS)))
    mark, *each = _columns(least)
    usual = np.zeros(len(marks), np.int64)
    usual[np.searchsorted(marks, mark)] = np.sum(each, axis=0) - np.max(each, axis=0, initial=0)
    return marks[n * odds >= MIN_RATIO * (usual + 1)]


def _all_marks(rows: DataFrame) -> list[Marks]:
    """The marks of all folds but one, for each."""
    texts = {(r.y, r.fold): r["count"] for r in rows.groupBy("y", "fold").count().collect()}
    folds = range(FOLDS)
    by = {y: [f"n{y}{f}" for f in folds] for y in (1, 0)}

    def share(own) -> float:
        toxic, ordinary = (max(1, sum(texts.get((y, f), 0) for f in own)) for y in (1, 0))
        return toxic / (toxic + ordinary)

    own = [[f for f in folds if f != left] for left in folds]
    odds = max((1 - share(f)) / share(f) for f in own)
    counts = _counts(rows, _candidates(rows, odds)).groupBy("mark").agg(*(F.sum(F.when((F.col("y") == y) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(by[y][f]) for y in by for f in folds))
    seen, usual = (F.expr(" + ".join(by[y])) for y in (1, 0))
    likely = counts.where((seen >= MIN_TEXTS) & (seen * odds >= MIN_RATIO * (usual - F.greatest(*by[0]) + 1)))  # whichever fold is left out
    found = np.stack(_columns(likely), axis=1)
    found = found[np.argsort(found[:, 0])]
    hashes, n = found[:, 0].copy().view(_U), found[:, 1:].reshape(-1, 2, FOLDS)
    return [Marks.of(hashes[_are_marks(hashes, n[:, 0, f].sum(axis=1), n[:, 1, f].sum(axis=1), share(f))]) for f in own]


def _training_texts(rows: DataFrame, marks: list[Marks], n_windows: int) -> tuple[list[list[tuple[bytes, int]]], list[tuple[int, bytes]]]:
    """For each list of marks the toxic words, then the passages, of the folds it may see and their numbers; and ordinary windows with their folds."""
    sent = rows.sparkSession.sparkContext.broadcast(marks)
    least = int(min(1.0, WINDOWS / max(1, n_windows)) * 2**63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for y, fold, t in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(t)
                if y:
                    out += [(2 * left + wide, 0, p) for left, own in enumerate(sent.value) if left != fold for wide, p in own.passages(words)]
                else:
                    hashes = mix(_phrases(words, SPAN)[::STEP] + _U(fold)) if len(words) >= SPAN else mix(np.array([len(words)], _U))
                    windows = windows_of(words)
                    out += [(-1, fold, windows[k]) for k in np.flatnonzero(hashes >> _U(1) <= _U(least)) if k < len(windows)]
            m, f, p = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(f, pa.int32()), pa.array(p, pa.binary())], ["marks", "fold", "text"])

    found = staged(in_arrow(rows.select("y", "fold", "t"), run, "marks int, fold int, text binary"))
    passages = found.where("marks >= 0").groupBy("marks", "text").count().orderBy(F.desc("count"), "text").limit(2 * PASSAGES * FOLDS).toArrow()
    plain = found.where("marks < 0").select("fold", "text").orderBy(F.xxhash64("text", "fold"), "text").limit(2 * WINDOWS).toArrow()
    out: list[list[tuple[bytes, int]]] = [[] for _ in range(2 * len(marks))]
    for m, p, n in zip(*(c.to_pylist() for c in passages.columns)):
        if len(out[m]) < PASSAGES:
            out[m].append((p, n))
    return out, list(zip(*(c.to_pylist() for c in plain.columns)))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's content; the samples themselves where they are too few to train on."""
    if sum(map(len, samples)) <= 2 * size:
        return b"".join(dict.fromkeys(samples))[-size:]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(dictionary: bytes, level: int, size: int):
    data = dictionary + _CARRIER
    known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        level, dict_size=ORDINARY_BYTES + TOXIC_BYTES, source_size=size, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=how).compress


def _runs(data: bytes, n: int) -> np.ndarray:
    """The ``n`` bytes, eight at most, from each place on as a number; beyond the end are zeros."""
    return np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,)) & _U((1 << 8 * n) - 1)


def _shared(dictionary: bytes, n: int):
    """A function from bytes to the places where a run of ``n`` bytes starts that ``dictionary`` has too."""
    known = np.unique(_runs(dictionary, n)[: max(0, len(dictionary) - n + 1)])
    spread, shift = _U(0x9E3779B97F4A7C15), _U(46)
    likely = np.zeros(1 << 18, bool)
    likely[(known * spread) >> shift] = True

    def places(data: bytes) -> np.ndarray:
        runs = _runs(data, n)[: max(0, len(data) - n + 1)]  # the zeros beyond the end are no bytes, a trained dictionary has zeros too
        at = np.flatnonzero(likely[(runs * spread) >> shift])
        if not len(at):
            return at
        return at[known[np.minimum(np.searchsorted(known, runs[at]), len(known) - 1)] == runs[at]]

    return places


@dataclass
class Model:
    """The dictionaries (ordinary, toxic for words, toxic for windows), the weights of the features, the thresholds and how usual it is to reach them.

    ``prior`` is the score where nothing was learnt.
    """

    ordinary: bytes
    toxic: bytes
    passages: bytes = b""
    weights: tuple[float, ...] = ()
    far: tuple[int, int] = (1, 1)
    usual: tuple[np.ndarray, ...] = ()
    prior: float = 0.0

    def distances(self):
        """A function from a text's words to the bytes that the toxic dictionary saves on each different word and on each window."""
        usual, bad = (_compressor(d, *LEVELS[0]) for d in (self.ordinary, self.toxic))
        usual_wide, bad_wide = (_compressor(d, *LEVELS[1]) for d in (self.ordinary, self.ordinary + self.passages))
        in_toxic, in_passages = (_shared(d, n) for d, n in zip((self.toxic, self.passages), RUNS))
        known: dict[bytes, int] = {}

        def of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            if not words:
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if len(known) > CACHE:
                known.clear()
            text = _spaced(words)
            blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)  # before each word and behind the last
            at = in_toxic(text)
            word = np.searchsorted(blanks, at, "right") - 1
            near = np.bincount(word[at + RUNS[0] <= blanks[word + 1] + 1], minlength=len(words))
            each = np.zeros(len(set(words)), np.int64)
            for i, w in enumerate({words[k] for k in np.flatnonzero(near >= LEAST[0])}):
                d = known.get(w)
                if d is None:
                    window = _spaced([w]) + _CARRIER
                    d = known[w] = len(usual(window)) - len(bad(window))
                each[i] = d

            at = in_passages(text)
            first, last = np.searchsorted(blanks, at, "right") - 1, np.searchsorted(blanks, at + RUNS[1] - 1) - 1  # words that a run is of
            spans = np.zeros(len(range(0, max(1, len(words) - SPAN + STEP), STEP)), np.int64)
            near = np.zeros(len(spans), np.int64)
            for back in range(-(-SPAN // STEP)):
                k = first // STEP - back
                near += np.bincount(k[(k >= 0) & (k < len(near)) & (last < k * STEP + SPAN)], minlength=len(near))
            for k in np.flatnonzero(near >= LEAST[1]).tolist():
                window = text[blanks[k * STEP] : blanks[min(k * STEP + SPAN, len(words))] + 1] + _CARRIER
                spans[k] = len(usual_wide(window)) - len(bad_wide(window))
            return each, spans

        return of

    def score(self, summaries: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(summaries), self.prior)
        return 1.0 / (1.0 + np.exp(-np.clip(features(summaries, self.usual) @ np.array(self.weights), -60, 60)))


def summary(distances: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of a text: for its different words and for its windows how many have each distance from 0 to ``TOP``."""
    return np.concatenate([np.bincount(d.clip(0, TOP), minlength=TOP + 1) for d in distances])


def _widths(summaries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.asarray(summaries, float).reshape(-1, 2 * (TOP + 1))
    return s[:, : TOP + 1], s[:, TOP + 1 :]


def _largest(counts: np.ndarray) -> np.ndarray:
    """The largest distance of each text."""
    return (np.cumsum(counts[:, ::-1], axis=1)[:, -2::-1] > 0).sum(axis=1)


def features(summaries: np.ndarray, usual: tuple[np.ndarray, ...]) -> np.ndarray:
    """1 and, for both widths, the windows from each of ``COUNTED`` on beyond those that are usual, and the largest of ``STEPS`` that has some.

    Usual is what ordinary texts have of so many windows, and three standard
    deviations more: a long text has more of them far by chance.
    """
    widths = _widths(summaries)
    out = [np.ones(len(widths[0]))]
    for counts, steps, counted, rate in zip(widths, STEPS, COUNTED, usual):
        expected = np.outer(counts.sum(axis=1), rate)
        beyond = np.maximum(0, np.stack([counts[:, at:].sum(axis=1) for at in steps], axis=1) - expected - 3 * np.sqrt(expected))
        out += [np.log1p(beyond[:, steps.index(at)]) for at in counted]
        out.append(np.max(np.where(beyond > 0.5, steps, 0), axis=1))
    return np.stack(out, axis=1)


def calibrated(summaries: np.ndarray) -> tuple[tuple[int, int], tuple[np.ndarray, ...]]:
    """Of ordinary texts: the threshold of each width, and the share of windows from each of ``STEPS`` on."""
    widths = _widths(summaries)
    far = tuple(int(np.quantile(np.append(_largest(c), 1), 1 - REACHED, method="higher")) + 1 for c in widths)
    return far, tuple(np.array([(c[:, at:].sum() + 1) / (c.sum() + 1) for at in steps]) for c, steps in zip(widths, STEPS))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weighted ridge logistic regression by Newton steps; the constant is not shrunk."""
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _summaries(rows: DataFrame, models: list[Model]) -> list[tuple]:
    """(y, summary) of the sample's texts, each by the model that left its fold out."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = [m.distances() for m in sent.value]
        for batch in batches:
            found = [(y, summary(of[fold](words_of(t))).tolist()) for y, fold, t in zip(*(c.to_pylist() for c in batch.columns))]
            y, counts = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(counts, pa.list_(pa.int64()))], ["y", "counts"])

    return sorted(zip(*(c.to_pylist() for c in in_arrow(rows.select("y", "fold", "t"), run, "y int, counts array<long>").toArrow().columns)))


def _samples(passages: list[tuple[bytes, int]]) -> list[bytes]:
    """Passages as often as they stand, up to a bound, four to a sample and equal ones apart."""
    found = sorted((p for p, n in passages for _ in range(min(n, 50))), key=lambda p: (zlib.crc32(p), p))
    mixed = [found[i] for k in range(7) for i in range(k, len(found), 7)]
    return [b"".join(mixed[k : k + 4]) for k in range(0, len(mixed), 4)]


def fit(rows: DataFrame, share: float) -> Model:
    """From a sample (y, fold, t); ``share`` of all documents are toxic."""
    marks = _all_marks(rows)
    n_words = rows.where("y = 0").agg(F.sum(F.regexp_count("t", F.lit(r"\S++")))).first()[0] or 0
    passages, plain = _training_texts(rows, marks, n_words // STEP)
    models = []
    for left in range(FOLDS):
        usual = [w for f, w in plain if f != left]
        models.append(Model(_dictionary(usual, ORDINARY_BYTES), *(_dictionary(_samples(own), TOXIC_BYTES) for own in passages[2 * left : 2 * left + 2])))
    found = _summaries(rows, models)
    y, s = np.array([r[0] for r in found], float), np.array([r[1] for r in found], float)
    model = models[0]  # as large as those that the distances are from
    model.far, model.usual = calibrated(s[y == 0])
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    model.weights = _logistic(features(s, model.usual), y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from ``labels`` (key, label 0 or 1), which decides what rows may be learnt from.

    Up to ``sample`` documents of each class are taken in the order of a hash of
    the key, whole; of near duplicates among them one is learnt from. Rows with a
    null key or label and labels without a document are left out. Without toxic (or ordinary) rows
    every score is 0 (or 1).
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    order = F.md5(F.col("k").cast("string"))
    picked = rows.where("y = 1").orderBy(order).limit(sample).union(rows.where("y = 0").orderBy(order).limit(sample))
    texts = docs.where(F.col(text).isNotNull()).join(F.broadcast(picked), F.col(key) == F.col("k"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "k"), F.lit(FOLDS)).cast("int")
    found = staged(texts.select("y", fold.alias("fold"), F.col(text).alias("t"), F.xxhash64(text, "y").alias("h")).distinct())
    found = staged(probminhash.deduplicate(found, key="h", text="t").drop("h"))  # many copies of a text would be evidence for its words
    kinds = {r.y for r in found.select("y").distinct().collect()}
    if len(kinds) < 2:
        return Model(b"", b"", prior=1.0 if 1 in kinds else 0.0)
    total = sum(counts.values())
    return fit(found, min(max(counts.get(1, 0) / max(total, 1), 0.01), 0.99))


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1; from 0.5 on toxic is likelier) and ``n_far``, the words and windows that reach a threshold.

    Nulls, empty texts and texts without words have no windows and get the
    score of that. Repeated rows are scored alike. Other columns stay; one named
    like a result column is replaced by it.
    """
    docs = fresh(docs, "score", "n_far", needs=(text,))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size
    schema = extended(docs, "score double, n_far long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        of = own.distances()
        for batch in batches:
            found = [summary(of(words_of(t or ""))) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            counts = np.array(found, float).reshape(-1, 2 * (TOP + 1))
            scores = own.score(counts)
            far = sum(c[:, t:].sum(axis=1) for c, t in zip(_widths(counts), own.far)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(far, pa.int64())], [*batch.schema.names, "score", "n_far"])

    return in_arrow(docs, run, schema)


def held_out(key: str = "doc_id"):
    """Rows whose labels no model sees: a fifth, by the checksum of the key as text."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keep_clean(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` without those whose score is 0.5 or more; cases as in ``score``."""
    moved, back = set_aside(docs, "score", "n_far")
    return back(score(moved, model, text=text).where("score < 0.5"))
