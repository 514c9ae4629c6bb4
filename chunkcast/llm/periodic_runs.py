"""Periodic runs of words: maximal stretches that repeat with a smallest period q at least four times.

Periods below ``SHORTEST`` come from direct scans: words are compared with those q places on. Longer ones
come from minimizers at doubling scales. At the scale of W words (for periods W <= q < 2W) the value of a
place is a hash of the k = W / 4 words from there, and a place is a minimizer if it has the least value of
some window of W words. Inside a run the window q places on has the same words, so its least places lie
q places on as well: equal minimizers at a distance within [W, 2W) are the seeds. Each seed is extended word
by word and kept if it makes a run.

No run is missed. Places whose k words have a period of at most k / 4 lie in runs of smaller scales and are no
minimizers; if every k words of a run were such, neighbouring ones would share that period and the whole run
would have it. So one of every q windows of a run has a minimizer. This rule also keeps equal minimizers more
than k / 4 places apart, so a place has at most a few dozen partners.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from chunkcast.llm.textbytes import NOT_SPACE, hash_spans, joined_words, longer_runs, marked, mix, slices, text_buffers, word_spans

SHORTEST = 16
LEAST_LENGTH = 6
PERIODS = 4
_GAP = np.uint64(0x5E9A4A7E05E9A4A7)
_NEVER = np.uint32(0xFFFFFFFF)


def _flat(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes with a value of its own after each row, and the place of each row's first word."""
    ends = np.cumsum(counts)
    gaps = mix(np.arange(len(counts), dtype=np.uint64), np.full(1, _GAP))
    return np.insert(h, ends, gaps), ends - counts + np.arange(len(counts))


def _lag_stretches(seq: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of all maximal stretches of at least ``PERIODS`` * q words with period q."""
    if len(seq) <= q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    equal = np.zeros(len(seq) - q + 2, np.int8)
    equal[1:-1] = seq[:-q] == seq[q:]
    turns = np.flatnonzero(np.diff(equal))
    starts, ends = turns[::2], turns[1::2]
    long = ends - starts >= (PERIODS - 1) * q
    return starts[long], ends[long] + q


def _sliding(least, values: np.ndarray, width: int) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of every window of ``width`` values."""
    out, have = values, 1
    while 2 * have <= width:
        out = least(out[:-have], out[have:])
        have *= 2
    return least(out[: len(values) - width + 1], out[width - have :]) if have < width else out


def minimizers(values: np.ndarray, width: int) -> np.ndarray:
    """Places that have the least value of some window of ``width`` places, but no ``_NEVER``."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    window = _sliding(np.minimum, values, width)
    edge = np.zeros(width - 1, values.dtype)
    return np.flatnonzero((values == _sliding(np.maximum, np.concatenate([edge, window, edge]), width)) & (values != _NEVER))


def _seeds(places: np.ndarray, values: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of equal values at a distance in [low, high): the distance and the first place."""
    key = np.sort(values[places].astype(np.uint64) << np.uint64(32) | places.astype(np.uint64))
    at, value = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), key >> np.uint64(32)
    distances, firsts, k = [], [], 1
    alive = np.arange(max(len(at) - 1, 0))
    while len(alive):
        apart = at[alive + k] - at[alive]
        near = (value[alive + k] == value[alive]) & (apart < high)
        alive, apart = alive[near], apart[near]
        distances.append(apart[apart >= low])
        firsts.append(at[alive[apart >= low]])
        k += 1
        alive = alive[alive + k < len(at)]
    return np.concatenate([*distances, np.zeros(0, np.int64)]), np.concatenate([*firsts, np.zeros(0, np.int64)])


def _reach(seq: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The maximal range of places around ``at`` whose words equal those q places on."""
    end, most, step = at, len(seq) - q, 64
    while end < most:
        to = min(end + step, most)
        wrong = seq[end:to] != seq[end + q : to + q]
        if wrong.any():
            end += int(wrong.argmax())
            break
        end, step = to, step * 2
    start, step = at, 64
    while start > 0:
        to = max(start - step, 0)
        wrong = seq[to:start] != seq[to + q : start + q]
        if wrong.any():
            start -= int(wrong[::-1].argmax())
            break
        start, step = to, step * 2
    return start, end


def find_runs(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word, length and period of every run, by row, first word and period.

    ``h`` has the word hashes of rows of ``counts`` words one after the other.
    """
    seq, first = _flat(h, counts)
    found = []  # row, start, end, period; also the stretches that are too short for a run but four periods long
    known = np.zeros(0, np.int64)
    for q in range(1, SHORTEST):
        start, end = _lag_stretches(seq, q)
        key = start * (len(seq) + 1) + end
        new = ~np.isin(key, known)  # the same stretch with a smaller period
        known = np.concatenate([known, key[new]])
        row = np.searchsorted(first, start[new], "right") - 1
        found.append(np.stack([row, start[new] - first[row], end[new] - first[row], np.full(len(row), q)]))
    found = np.concatenate(found, axis=1)
    rows, k, grams = np.arange(len(counts)), 1, seq
    while k < SHORTEST // 4:
        grams, k = longer_runs(grams, grams[k:]), 2 * k
    scale = SHORTEST
    while True:
        large = counts[rows] >= PERIODS * scale
        if not large.any():
            break
        if not large.all():  # go on with the rows that are long enough
            keep = np.repeat(large, counts[rows] + 1)
            seq = seq[keep]
            grams = grams[keep[: len(grams)]][: len(seq) - k + 1]
            rows = rows[large]
            first = np.cumsum(counts[rows] + 1) - counts[rows] - 1
        values = (grams >> np.uint64(32)).astype(np.uint32)
        own = np.full(len(counts), -1)
        own[rows] = first
        short = found[:, (found[3] <= k // 4) & (found[2] - found[1] >= k) & (own[found[0]] >= 0)]
        base = own[short[0]]
        values[marked(len(values), base + short[1], base + short[2] - k + 1)] = _NEVER
        distance, place = _seeds(minimizers(values, scale - k + 1), values, scale, 2 * scale)
        order = np.lexsort((place, distance))
        taken = set(zip(*found[:3].tolist()))
        new, last, done = [], 0, 0
        for q, at in zip(distance[order].tolist(), place[order].tolist()):
            if q == last and at < done:
                continue
            start, end = _reach(seq, at, q)
            last, done = q, end
            if end - start >= (PERIODS - 1) * q:
                r = int(np.searchsorted(first, start, "right")) - 1
                one = (int(rows[r]), start - int(first[r]), end + q - int(first[r]))
                if one not in taken:
                    taken.add(one)
                    new.append((*one, q))
        if new:
            found = np.concatenate([found, np.array(new).T], axis=1)
        grams, k, scale = longer_runs(grams, grams[k:]), 2 * k, 2 * scale
    row, start, end, period = found
    order = np.lexsort((period, start, row))
    order = order[(end - start)[order] >= LEAST_LENGTH]
    return row[order], start[order], (end - start)[order], period[order]


RUNS = "struct<n_words bigint, runs array<struct<start bigint, length bigint, period bigint>>, collapsed string>"


def _of_texts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    starts, ends, counts = word_spans(data, offsets, NOT_SPACE)
    row, at, length, period = find_runs(hash_spans(data, starts, ends), counts)
    base = (np.cumsum(counts) - counts)[row]
    dropped = marked(len(starts), base + at + period, base + at + length)
    keep = np.concatenate([[0], np.cumsum(~dropped)])
    ends_of = np.concatenate([[0], np.cumsum(counts)])
    left = np.diff(keep[ends_of])
    each = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (at, length, period)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(counts) + 1)), pa.int32()), each)
    text = joined_words(data, starts[~dropped], ends[~dropped], left)
    return pa.StructArray.from_arrays([pa.array(counts), lists, text], ["n_words", "runs", "collapsed"])


def periodic_runs(text: Column) -> Column:
    """``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed`` of whole texts.

    Words are what stands between white space, unchanged; a run has at least six words and four periods.
    ``collapsed`` has the words that no run contains after its first period, joined by one space. A null or
    empty text has no words, no runs and an empty ``collapsed``.
    """

    def find(column: pa.Array) -> pa.Array:
        data, offsets = text_buffers(column)
        parts = [_of_texts(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]) for low, high in slices(offsets)]
        return pa.concat_arrays(parts) if parts else _of_texts(data, offsets)

    return F.arrow_udf(find, RUNS)(text)
