"""Word and shingle hashes of many texts at once, as numpy arrays.

A word is a run of digits, letters A-Z (folded to lower case) and all
characters beyond ASCII. Work is done on UTF-8 bytes: every byte of a
character beyond ASCII is 0x80 or more, so byte runs and character runs agree.

Blocks of about ``BLOCK_BYTES`` bound the memory; a longer text is a block of
its own and is hashed in pieces that end between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
PIECE_BYTES = 1 << 20

#: Byte to folded byte; 0 separates words.
FOLD = np.zeros(256, np.uint8)
FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)
#: The same for ``bytes.translate``; separators become blanks.
FOLD_BLANK = bytes(int(b) or 0x20 for b in FOLD)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def folded_words(text: bytes) -> list[bytes]:
    """The words of one text, folded."""
    return text.translate(FOLD_BLANK).split()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection that spreads 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return _Powers, ()  # tasks make their own

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, PIECE_BYTES + 1)
            up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up, self.down


_powers = _Powers()


def _piece_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    folded = FOLD[raw]
    edges = np.flatnonzero(np.diff((folded != 0).view(np.int8), prepend=0, append=0))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    up, down = _powers.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(folded * up[: len(raw)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words of ``blob``, in order."""
    raw = np.frombuffer(blob, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE_BYTES)
        while end < len(raw):  # end a piece between words
            gap = np.flatnonzero(FOLD[raw[max(at, end - 4096) : end]] == 0)
            if len(gap):
                end = max(at, end - 4096) + int(gap[-1]) + 1
                break
            end = min(len(raw), end + 4096)
        s, h = _piece_words(raw[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def text_blocks(texts: list[bytes | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of at most ``limit`` bytes, or of one longer text."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def shingles(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``words`` words, text after text, and each text's end in them.

    A text of fewer words, but not none, has one shingle of all its words; a
    text without words or a null has none. Repeats are kept.
    """
    texts = [t or b"" for t in texts]
    starts, h = word_hashes(b"\0".join(texts))
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    last = np.searchsorted(starts, np.cumsum(sizes))  # words up to the end of each text
    first = np.concatenate(([0], last[:-1]))
    counts = last - first
    total = np.zeros(len(h), np.uint64)
    for j in range(words):
        total[: max(0, len(h) - j)] += h[j:] * _U((0xD6E8FEB86659FD93 * (2 * j + 3)) % (1 << 64) | 1)
    full = np.maximum(counts - words + 1, 0)
    n = np.where(counts == 0, 0, np.maximum(full, 1))
    ends = np.cumsum(n)
    take = np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
    out = mix(total[take])
    for i in np.flatnonzero((counts > 0) & (counts < words)):  # short texts, length included
        own = h[first[i] : last[i]]
        odd = _U(2) * np.arange(1, len(own) + 1, dtype=np.uint64) + _U(1)
        out[ends[i] - 1] = mix(np.array([(own * odd).sum(dtype=np.uint64) + _U(len(own))]))[0]
    return out, ends


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()
