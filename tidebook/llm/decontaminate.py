"""Benchmark decontamination with a generalised suffix automaton.

The items' words form one automaton over all items. A document's words are
streamed through it; the state gives, at every word, the longest run of words
ending there that stands in some item. Where that run reaches ``window`` words
(or is a whole shorter item), its words are hit.

Each task builds the automaton from a broadcast list of items.
The list is bounded by ``group_bytes``: a larger benchmark is dealt into groups
by hash, and the documents pass through one automaton after the other, with the
hits so far carried along in a staged table. Nothing of the documents is
shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import extended, fresh, in_arrow, set_aside, staged
from tidebook.llm.textblocks import FOLD_BLANK, as_bytes, folded_words

WINDOW = 10
GROUP_BYTES = 8 << 20
_WORD = re.compile(rb"[^ ]+")
_FOUND = {"n_words": "long", "longest": "int", "items": "array<string>", "runs": "array<int>"}


class SuffixAutomaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.shorts: dict[int, list[tuple[int, str | None]]] = {}
        seen: dict[int, set[str | None]] = {}
        whole: dict[int, set[tuple[int, str | None]]] = {}
        for name, words in items:
            if not words:
                continue
            last = 0
            for w in words:
                last = self._extend(last, w)
                seen.setdefault(last, set()).add(name)
            if len(words) < window:
                whole.setdefault(last, set()).add((len(words), name))
        self._pass_up(seen)
        self._pass_down(whole)

    def _new(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, state: int, word: bytes) -> int:
        """The target of ``state`` by ``word``, cut so that its longest run is one word longer."""
        old = self.next[state][word]
        if self.length[old] == self.length[state] + 1:
            return old
        new = self._new(self.length[state] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = new
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]
        return new

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:  # another item has this run
            return self._split(last, word)
        new, state = self._new(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def _pass_up(self, seen: dict[int, set]) -> None:
        """``windows[state]``: the items of the window that ends where the state's runs end.

        Items are gathered up the suffix links only as far as the states of
        window length, so all sets together hold a name for each item and window.
        """
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for v in order:
            if self.length[v] >= self.window and self.length[self.link[v]] >= self.window:
                seen.setdefault(self.link[v], set()).update(seen.pop(v, ()))
        self.at = list(range(len(self.length)))
        for v in reversed(order):
            if self.length[self.link[v]] >= self.window:
                self.at[v] = self.at[self.link[v]]
        self.windows = {v: frozenset(s) for v, s in seen.items() if self.length[v] >= self.window}

    def _pass_down(self, whole: dict[int, set]) -> None:
        """``shorts[state]``: the short items that are suffixes of the state's runs."""
        if not whole:
            return
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            if found := [*self.shorts.get(self.link[v], ()), *whole.get(v, ())]:
                self.shorts[v] = found

    def hits(self, words: list[bytes]) -> tuple[list[int], set, int]:
        """Hit runs as flat, sorted, disjoint (start, end) pairs, the items, the longest run."""
        step, link, length, shorts, window = self.next, self.link, self.length, self.shorts, self.window
        state = run = longest = 0
        runs: list[int] = []
        items: set = set()
        for i, w in enumerate(words):
            to = step[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = step[state].get(w)
                run = length[state]
                if to is None:
                    continue
            state = to
            run += 1
            if run > longest:
                longest = run
            start = i + 1
            if run >= window:
                start -= window
                items |= self.windows[self.at[state]]
            if state in shorts:
                for n, name in shorts[state]:
                    if n <= run:
                        start = min(start, i + 1 - n)
                        items.add(name)
            if start <= i:
                add_run(runs, start, i + 1)
        return runs, items, longest


def add_run(runs: list[int], start: int, end: int) -> None:
    """Append a run that ends after all before it, joining those it touches."""
    while runs and runs[-1] >= start:
        start = min(start, runs[-2])
        end = max(end, runs[-1])
        del runs[-2:]
    runs += (start, end)


def merged(a: list[int], b: list[int]) -> list[int]:
    """The union of two flat lists of runs."""
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        add_run(out, start, end)
    return out


def cut(text: bytes, runs: list[int]) -> bytes:
    """``text`` without the characters from the first to the last word of each run."""
    spans = [m.span() for m in _WORD.finditer(text.translate(FOLD_BLANK))]
    out, at = [], 0
    for first, end in zip(runs[::2], runs[1::2]):
        out.append(text[at : spans[first][0]])
        at = spans[end - 1][1]
    return b"".join([*out, text[at:]])


def _groups(benchmark: DataFrame, item_id: str, text: str, group_bytes: int) -> Iterator:
    """Broadcast lists of (item id as text, UTF-8 text), each of about ``group_bytes`` at most."""
    items = benchmark.select(F.col(item_id).cast("string").alias("n"), F.col(text).cast("binary").alias("t")).where("t is not null")
    total, largest = items.agg(F.sum(F.length("t") + 32), F.max(F.length("t"))).first()
    n = -(-(total or 1) // group_bytes)
    for g in range(n):
        part = items.where(F.pmod(F.xxhash64("n", "t"), F.lit(n)) == g) if n > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()])


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with n_words, longest, items and runs.

    ``runs`` is a flat list of word positions (start, end exclusive, ...) of the
    words inside an occurrence of ``window`` item words, or of a whole shorter
    item; ``items`` are the ids, as text and in order, of the items concerned;
    ``longest`` is the longest run of words shared with any item.

    A null or empty text has no words. Items without words are no windows; an
    item without an id hits words but is not listed. Repeated items and
    documents count as they stand. An empty benchmark hits nothing. Other
    columns stay; one named like a result column is replaced by it.
    """
    return _found(fresh(docs, *_FOUND, needs=(text,)), _groups(benchmark, item_id, item_text, group_bytes), text, window)


def _found(docs: DataFrame, groups: Iterator, text: str, window: int, then: Callable | None = None) -> DataFrame:
    """``find``, one pass for each group; ``then`` goes on with the batches of the last one in the same worker, back to the columns of ``docs``."""
    schema = extended(docs, ", ".join(f"{k} {v}" for k, v in _FOUND.items()))
    groups = list(groups)
    out = docs
    for k, items in enumerate(groups):
        if k:
            out = staged(out)
        run, last = _finder(items, text, window, k > 0), then is not None and k == len(groups) - 1
        out = in_arrow(out, _one_after(run, then) if last else run, docs.schema if last else schema)
    return out


def _one_after(first: Callable, then: Callable) -> Callable:
    return lambda batches: then(first(batches))


def _finder(items, text: str, window: int, later: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton(((n, folded_words(t)) for n, t in items.value), window)
        for batch in batches:
            found = []
            texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
            before = [batch.column(k).to_pylist() for k in range(batch.num_columns - 4, batch.num_columns)] if later else None
            for i, t in enumerate(texts):
                words = folded_words(t or b"")
                runs, names, longest = automaton.hits(words)
                if later:
                    longest, names, runs = max(longest, before[1][i]), names | {*before[2][i]}, merged(runs, before[3][i])
                found.append((len(words), longest, sorted(names - {None}), runs))
            columns = batch.columns[: batch.num_columns - 4 * later]
            names = batch.schema.names[: len(columns)]
            new = zip(*found) if found else ((), (), (), ())
            types = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(new, types))], [*names, *_FOUND])

    return run


def n_hit():
    """Words inside the runs of ``find``."""
    return F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")), lambda a: a["n"])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = WINDOW, max_coverage: float = 0.5, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """``docs`` without benchmark passages.

    Passages of ``min_words`` benchmark words (or whole shorter items) are cut
    out of the text; a document of which more than ``max_coverage`` of the words
    are such goes. Documents without passages stay as they are, also those
    without words or text. Null cases and repeats are as in ``find``.
    """
    moved, back = set_aside(docs, *_FOUND)
    names = moved.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, runs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n_words", "runs"))
            batch = batch.filter(pa.array([sum(r[1::2]) - sum(r[::2]) <= max_coverage * n for n, r in zip(n_words, runs)], pa.bool_()))
            at, runs = batch.schema.get_field_index(text), batch.column(batch.num_columns - 1).to_pylist()
            if any(runs):
                texts = [cut(t, r) if r else t for t, r in zip(as_bytes(batch.column(at)), runs)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(batch.schema.field(at).type))
            yield batch.select(names)

    return back(_found(moved, _groups(benchmark, item_id, item_text, group_bytes), text, min_words, run))
