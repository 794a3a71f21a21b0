"""Words, lines and their 64-bit hashes over blocks of whole texts, as numpy array operations.

A block joins some texts with a newline between them. A prefix sum of ``value[byte] * base ** position`` (mod 2**64) gives
the hash of any byte span as ``(prefix[end] - prefix[start]) * base ** -start``, so equal spans have equal hashes wherever
they stand, and no loop runs over words or characters. Texts are never cut: a text longer than a block has one of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


def rest() -> None:
    """Give back to the machine what this process has freed: its allocators keep that, in each of an executor's idle workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def resting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after whose last batch the worker rests."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        rest()

    return runs


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (three xor-shifts, two odd factors)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, BLOCK_BYTES + 64)  # what a block of texts takes that are not longer than a block
        with np.errstate(over="ignore"):
            _powers, _inverses = (np.multiply.accumulate(x, out=x) for x in (np.full(size, _BASE, _U), np.full(size, _INVERSE, _U)))
            _powers *= _U(_INVERSE)  # from exponent 0
            _inverses *= _U(_BASE)


class Block:
    """Some texts (UTF-8), with their words. ``doc_at[i] : doc_at[i + 1] - 1`` is text i in ``buf``."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        self.doc_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, self.n) + 1)])
        _grow(len(self.buf) + 1)
        self.prefix = np.zeros(len(self.buf) + 1, _U)
        np.cumsum(_BYTE[self.buf] * _powers[: len(self.buf)], out=self.prefix[1:])
        self.in_word = ~SEPARATOR[self.buf]
        edge = np.flatnonzero(np.diff(self.in_word, prepend=False))  # a block ends in a separator
        self.starts, self.ends = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.doc_at)  # words of text i: first[i] : first[i + 1]
        self.n_words = np.diff(self.first)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * _inverses[starts])

    def word_hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def word_docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the lines that a newline split gives."""
        ends = np.flatnonzero(self.buf == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        return starts, ends, np.searchsorted(self.doc_at, starts, "right") - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a byte-aligned array over each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.doc_at[1:]] - total[self.doc_at[:-1]]


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k consecutive items that stay in one text, and the position of each one's first item."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    out = np.zeros(n, _U)
    for i in range(k):
        out += hashes[i : n + i] * _powers[i + 1]
    inside = np.ones(len(hashes), bool)
    for i in range(1, k):
        at = first[1:] - i
        inside[at[(at >= 0) & (at < len(hashes))]] = False
    short = np.flatnonzero(np.diff(first) < k)
    for i in short:
        inside[first[i] : first[i + 1]] = False
    at = np.flatnonzero(inside[:n])
    return mix(out[at]), at


def sums_by(docs: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, weights=values, minlength=n) if len(docs) else np.zeros(n)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Whole texts as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], lower: bool = False, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(from, to, block) over consecutive texts of about ``size`` bytes together."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= size):
            held += len(texts[to]) + 1
            to += 1
        yield at, to, Block(texts[at:to], lower)
        at = to
