"""Vectorised word hashing over the bytes of Arrow string columns.

A batch of texts is one byte buffer. Words are runs of ``[^\\x20\\x09-\\x0D]``; a word's hash is a polynomial of
random per-byte values modulo 2^64, taken from one running sum, and mixed. Work goes in pieces of about
``PIECE_BYTES`` of text, so memory does not depend on the batch; a longer text is a piece of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUES = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_VALUES = _BYTE_VALUES[_LOWER]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = _RANDOM.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit changes about half of the output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def release() -> None:
    """Give freed memory back: Python workers stay for later tasks, and executors share one limit."""
    global _powers
    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Piece(NamedTuple):
    """Some consecutive texts of a batch: their bytes, the words' places, and each text's range of words."""

    first: int  # number of the first text in the batch
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # words of text i are offsets[i] .. offsets[i + 1]

    def word_hashes(self, *, lower: bool = False) -> np.ndarray:
        global _powers
        n = len(self.data)
        if len(_powers[0]) < n:
            steps = np.full(n - 1, _BASE, np.uint64), np.full(n - 1, _INVERSE, np.uint64)
            _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(s)]) for s in steps)
        if not len(self.starts):
            return np.empty(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER_VALUES if lower else _BYTE_VALUES)[self.data] * _powers[0][:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * _powers[1][self.starts])


#: Word breaks where punctuation and symbols separate words as white space does.
PUNCTUATION_TOO = _IS_SPACE.copy()
PUNCTUATION_TOO[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


#: Code points of scripts written without spaces: Thai to Tibetan, Burmese, Khmer, kana, Han; and of their punctuation.
UNSPACED = [
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3031, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF),
]
WIDE_PUNCTUATION = [(0x3000, 0x3004), (0x3008, 0x3030), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]


def _places_in(data: np.ndarray, ranges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """First bytes, and bytes behind the last, of the characters of three and four bytes in ``ranges``."""
    found = []
    for low, high, size, bits in ((0xE0, 0xEF, 3, 0x0F), (0xF0, 0xF7, 4, 0x07)):
        at = np.flatnonzero((data >= low) & (data <= high))
        at = at[at + size <= len(data)]
        code = data[at].astype(np.int64) & bits
        for k in range(1, size):
            code = code << 6 | data[at + k] & 0x3F
        at = at[np.any([(code >= a) & (code <= b) for a, b in ranges], axis=0)]
        found.append((at, at + size))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def pieces(column: pa.Array, breaks: np.ndarray = _IS_SPACE, *, characters: bool = False) -> Iterator[Piece]:
    """The texts of a string column (null: empty), piece by piece; ``breaks`` marks the bytes between words.

    With ``characters`` each character of a script without spaces is a word, and its punctuation breaks words.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offset_buffer, data_buffer = column.buffers()
    bounds = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + len(column) + 1]
    everything = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE_BYTES, "right")) - 1)
        data = everything[bounds[at] : bounds[stop]]
        edges = bounds[at : stop + 1] - bounds[at]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~breaks[data]
        unspaced = characters and len(data) and data.max() >= 0xE0
        if unspaced:
            first, _ = _places_in(data, WIDE_PUNCTUATION)
            for k in range(1, 4):  # its three bytes
                inside[first + k] = False
        begins = inside[1:-1] & ~inside[:-2]
        finishes = inside[1:-1] & ~inside[2:]
        if unspaced:
            first, behind = _places_in(data, UNSPACED)
            begins[first] = finishes[behind - 1] = True
            behind, first = behind[behind < len(data)], first[first > 0]
            begins[behind] |= inside[1:-1][behind]
            finishes[first - 1] |= inside[1:-1][first - 1]
        at_edge = edges[:-1][edges[:-1] < len(data)]
        begins[at_edge] |= inside[1:-1][at_edge]
        before_edge = edges[1:][edges[1:] > 0] - 1
        finishes[before_edge] |= inside[1:-1][before_edge]
        starts = np.flatnonzero(begins)
        yield Piece(at, data, starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, edges))
        at = stop


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbouring words (runs may cross texts: the caller keeps those inside one)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * _PLACES[k]
    return mix(total)


def shingle_set(hashes: np.ndarray, spread: np.ndarray, start: int, stop: int, width: int) -> np.ndarray:
    """Sorted distinct shingles of the text with words start .. stop; ``spread`` is ``grams(hashes, width)``."""
    n = stop - start
    if n == 0:
        return np.empty(0, np.uint64)
    if n < width:
        short = (hashes[start:stop] * _PLACES[:n]).sum(dtype=np.uint64) + np.uint64(n)
        return mix(np.array([short], np.uint64))
    return np.unique(spread[start : stop - width + 1])
