"""Word hashing over whole Arrow batches of text, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: Bytes of text that are hashed at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 18
#: Rows that are hashed at once.
BLOCK_ROWS = 1 << 12

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
#: Words end at ASCII white space.
BY_SPACE = _space
_symbol = np.ones(256, bool)
_symbol[128:] = False
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    _symbol[_low:_high] = False
#: Words end at every ASCII byte that is no letter or digit.
BY_SYMBOL = _symbol

_powers: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least; those of a block's size are kept."""
    if _powers and len(_powers[0][0]) >= n:
        return _powers[0]
    size = max(2 * BLOCK_BYTES, n)
    made = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (BASE, BASE_INVERSE))
    if size == 2 * BLOCK_BYTES:
        _powers[:] = [made]
    return made


@dataclass
class Words:
    """Words of a block: hash, row of the block, first byte and the byte after the last; ``data`` are the block's bytes."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    rows: int


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (0-based) of a string array without nulls."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    values = texts.buffers()[2]
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array with nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one prefix sum over the block."""
    up, down = _powers_to(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words_of(texts: pa.Array, separators: np.ndarray = BY_SPACE) -> Words:
    """Words of a block of texts (no nulls), in reading order."""
    data, offsets = string_buffers(texts)
    inside = np.empty(len(data) + 1, bool)
    inside[:-1] = ~separators[data]
    inside[-1] = False
    first, last = inside[:-1].copy(), inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    last &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]  # a row's first byte starts a word whatever stands before it
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, offsets)))
    return Words(hash_spans(data, start, end), row, start, end, data, len(texts))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[tuple[int, pa.Array]]:
    """Slices of at most ``limit`` bytes and ``rows`` rows (one row at least), with the index of their first row."""
    _, offsets = string_buffers(texts)
    at = 0
    while at < len(texts):
        stop = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield at, texts.slice(at, stop - at)
        at = stop


def shingles_of(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, Words]:
    """Hashes and rows of each run of ``width`` lower-case words; a shorter text has one shingle of all its words, an empty text none."""
    words = words_of(pc.utf8_lower(texts))
    n = np.bincount(words.row, minlength=words.rows)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    made = max(0, len(words.hash) - width + 1)
    total = np.zeros(made, np.uint64)
    for k in range(width):
        total += words.hash[k : k + made] * np.uint64(pow(int(BASE), k + 1, 2**64))
    good = words.row[:made] == words.row[width - 1 :] if made else np.zeros(0, bool)
    value, row = [total[good]], [words.row[:made][good]]
    for r in np.flatnonzero((n > 0) & (n < width)):
        powers = np.array([pow(int(BASE), k + 1, 2**64) for k in range(n[r])], np.uint64)
        value.append(np.array([(words.hash[first[r] : first[r] + n[r]] * powers).sum(dtype=np.uint64)]))
        row.append(np.array([r]))
    return mix(np.concatenate(value)), np.concatenate(row).astype(np.int64), words
