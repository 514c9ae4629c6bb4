"""Words of whole Arrow text columns as numpy arrays: byte classes, spans and 64-bit hashes.

Texts are read as UTF-8 bytes. Both word classes used here are closed under UTF-8: a byte of 0x80 or
more always belongs to a word. Words are identified by a 64-bit hash of their lower-cased bytes (A-Z
only); two of n different words share one with a probability of about n^2 / 2^65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but space and the controls 0x09 to 0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, letters and every byte outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_29, _32 = np.uint64(29), np.uint64(32)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return _buffers(pc.fill_null(column.cast(pa.large_string()), ""))


def binary_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets of a binary column; nulls count as empty."""
    return _buffers(pc.fill_null(column.cast(pa.large_binary()), b""))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def binary_column(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose rows are runs of ``sizes`` elements of a flat array."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * flat.itemsize
    data = pa.py_buffer(np.ascontiguousarray(flat))
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), data]).cast(pa.binary())


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system; a worker lives on and would hold its largest batch's."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(offsets: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each, or one longer row alone; freed memory is released after the last."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to
    release()


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of every row."""
    inside = word[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One step of a 64-bit hash chain."""
    h = (h ^ x) * _A
    h ^= h >> _29
    h *= _B
    h ^= h >> _32
    return h


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, read eight bytes at a time."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(low) + 1,), "<u8", padded.data, strides=(1,))
    left = ends - starts
    h = left.astype(np.uint64) * _B
    some, at = slice(None), starts
    while len(at):
        h[some] = mix(h[some], eight[at] & _FIRST_BYTES[np.minimum(left, 8)])
        more = left > 8
        if not more.any():
            break
        some = np.flatnonzero(more) if isinstance(some, slice) else some[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word in order, and the number of words of every row."""
    starts, ends, counts = word_spans(data, offsets, word)
    return hash_spans(LOWER[data], starts, ends), counts


def hash_word(text: str) -> int:
    """The hash of one word, as ``word_hashes`` gives it."""
    raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return int(hash_spans(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0])


def ngrams(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a row, and how many each row has."""
    have = np.maximum(counts - n + 1, 0)
    if len(h) < n:
        return np.zeros(0, np.uint64), have
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = mix(out, h[k : len(h) - n + 1 + k])
    first = np.cumsum(counts) - counts
    within = np.ones(len(h), dtype=bool)
    ends = first + counts
    for k in range(1, n):
        at = ends - k
        within[at[at >= first]] = False
    return out[within[: len(out)]], have


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


_ODD = np.uint64(0xD6E8FEB86659FD93)


def longer_runs(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Hashes of runs put together from a first and a second part each; order matters."""
    return mix(first[: len(then)] * _ODD + np.uint64(1), then)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of ``counts`` words each, the byte ranges in order, joined by one space."""
    sizes = ends - starts + 1
    places = np.concatenate([[0], np.cumsum(sizes)])
    source = np.arange(places[-1]) + np.repeat(starts - places[:-1], sizes)
    out = np.append(data, np.uint8(32))[source]
    out[places[1:] - 1] = 32
    row = places[np.concatenate([[0], np.cumsum(counts)])]
    keep = np.ones(len(out), bool)
    keep[row[1:][counts > 0] - 1] = False  # no space after a last word
    offsets = row - np.concatenate([[0], np.cumsum(counts > 0)])
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[keep])]
    return pa.Array.from_buffers(pa.large_string(), len(counts), buffers).cast(pa.string())


def marked(inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mask over ``inside`` places that is true in the given ranges."""
    steps = np.zeros(inside + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
