"""Document quality with a factorisation machine over hashed words, structure and metadata.

A document is a sparse vector x: its distinct words in hashed buckets, its structure statistics in
quantile bins and its metadata values. The score is the logistic of
``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``, where the pairwise sum over factors f is
``((sum v_if x_i)^2 - sum (v_if x_i)^2) / 2``: linear in the number of features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chunkcast.llm.labelled import fitted, training_rows
from chunkcast.llm.textbytes import LOWER, NOT_SPACE, hash_spans, slices, text_buffers, word_spans

STATISTICS = (
    "bytes", "words", "word_length", "longest", "upper", "digits", "marks", "white", "lines", "beyond_ascii",
    "distinct", "top_word", "same_as_last", "ends_in_mark", "bars", "two_marks",
)
WORD_BUCKETS = 1 << 17
BINS = 12
META_BUCKETS = 1 << 10

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


@dataclass
class Batch:
    """Word buckets (distinct, flat), how many each row has, and the statistics of each row."""

    words: np.ndarray
    n: np.ndarray
    stats: np.ndarray


def describe(data: np.ndarray, offsets: np.ndarray) -> Batch:
    """Features of a run of texts; an empty text has no words and statistics of zero."""
    rows = len(offsets) - 1
    starts, ends, counts = word_spans(data, offsets, NOT_SPACE)
    first = np.cumsum(counts) - counts
    size = np.diff(offsets)
    per_byte, per_word = np.maximum(size, 1), np.maximum(counts, 1)

    def share(of_byte: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_byte, dtype=np.int32)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def by_word(of_word: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_word)])
        return total[first + counts] - total[first]

    letters = share(_LETTER[data])
    length = ends - starts
    h = hash_spans(LOWER[data], starts, ends)
    bucket = (h >> np.uint64(47)).astype(np.int64)
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    same[first[counts > 0]] = 0
    last = _MARK[data[ends - 1]].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    two = last * (length > 1) * (_MARK[data[np.maximum(ends - 2, 0)]] if len(ends) else last)
    longest, top = np.zeros(rows), np.zeros(rows)
    new = np.ones(len(h), bool)
    for k, (a, b) in enumerate(zip(first.tolist(), (first + counts).tolist())):
        if b > a:
            longest[k] = length[a:b].max()
            bucket[a:b].sort()
    new[1:] = bucket[1:] != bucket[:-1]
    new[first[counts > 0]] = True
    distinct = by_word(new)
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    if len(runs):
        begin = np.cumsum(distinct) - distinct
        some = distinct > 0
        top[some] = np.maximum.reduceat(runs, begin[some])
    stats = np.stack(
        [
            np.log1p(size), np.log1p(counts), by_word(length) / per_word, np.log1p(longest), share(_UPPER[data]) / np.maximum(letters, 1),
            share(_DIGIT[data]) / per_byte, share(_MARK[data]) / per_byte, (size - by_word(length)) / per_byte,
            share(data == 10) / per_byte, share(data >= 128) / per_byte,
            distinct / per_word, top / per_word, by_word(same) / per_word, by_word(last) / per_word,
            share(data == 124) / per_byte, by_word(two) / per_word,
        ],
        axis=1,
    )
    return Batch(bucket[new], distinct, stats)


@dataclass
class FactorMachine:
    """Bin edges of the statistics and the parameters w0, w and V."""

    edges: list[np.ndarray]
    bias: float
    w: np.ndarray
    v: np.ndarray

    @staticmethod
    def width(n_meta: int) -> int:
        return WORD_BUCKETS + len(STATISTICS) * BINS + n_meta * META_BUCKETS

    def rows(self, batch: Batch, meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers, values and number of features of every row."""
        n_rows, dense = len(batch.n), len(STATISTICS) + len(meta)
        binned = [
            WORD_BUCKETS + k * BINS + np.minimum(np.searchsorted(e, batch.stats[:, k], "right"), BINS - 1)
            for k, e in enumerate(self.edges)
        ]
        base = WORD_BUCKETS + len(STATISTICS) * BINS
        binned += [base + k * META_BUCKETS + m for k, m in enumerate(meta)]
        n = batch.n + dense
        index = np.empty(int(n.sum()), np.int64)
        value = np.empty(len(index), np.float32)
        begin = np.cumsum(n) - n
        at = np.repeat(begin + dense - (np.cumsum(batch.n) - batch.n), batch.n) + np.arange(len(batch.words))
        index[at] = batch.words
        value[at] = np.repeat(1 / np.sqrt(np.maximum(batch.n, 1)), batch.n)
        for k, b in enumerate(binned):
            index[begin + k] = b
            value[begin + k] = 1 / np.sqrt(dense)
        return index, value, n if n_rows else np.zeros(0, np.int64)

    def margin(self, index: np.ndarray, value: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not len(n):
            return np.zeros(0)
        begin = np.cumsum(n) - n
        vx = self.v[index] * value[:, None]
        s = np.add.reduceat(vx, begin)
        squares = np.add.reduceat((vx * vx).sum(1), begin)
        return self.bias + np.add.reduceat(self.w[index] * value, begin) + 0.5 * ((s * s).sum(1) - squares)

    def scores(self, column: pa.Array, meta: list[pa.Array]) -> np.ndarray:
        data, offsets = text_buffers(column)
        keys = [meta_buckets(m) for m in meta]
        out = []
        for low, high in slices(offsets, 1_000_000):  # of every byte and word there are many numbers at once
            batch = describe(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            out.append(self.margin(*self.rows(batch, [k[low:high] for k in keys])))
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -35, 35)))


def meta_buckets(column: pa.Array) -> np.ndarray:
    """A bucket of every metadata value: numbers by their magnitude, other values by hash, null its own."""
    out = np.zeros(len(column), np.int64)
    for k, x in enumerate(column.to_pylist()):
        if x is None:
            continue
        try:
            out[k] = 2 + min(60, int(abs(float(x))).bit_length())
        except (ValueError, OverflowError):
            raw = np.frombuffer(x.encode(), np.uint8)
            out[k] = 64 + int(hash_spans(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0] % np.uint64(META_BUCKETS - 64))
    return out


def fit(texts: pa.Table, meta: tuple[str, ...] = (), factors: int = 8, epochs: int = 12, rate: float = 0.15, decay: float = 1e-4) -> FactorMachine:
    """Minimise the logistic loss with adaptive gradient steps over shuffled mini-batches.

    Without examples the score is 0.5; with examples of one label it tends to that label.
    """
    labels = texts.column("label").to_numpy().astype(np.float64)
    rng = np.random.default_rng(10)
    size = FactorMachine.width(len(meta))
    machine = FactorMachine([np.zeros(0)] * len(STATISTICS), 0.0, np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
    if not len(labels):
        return machine
    data, offsets = text_buffers(texts.column("text"))
    parts = [describe(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, 1_000_000)]
    batch = Batch(*(np.concatenate([getattr(x, f) for x in parts]) for f in ("words", "n", "stats")))
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    machine.edges = [np.unique(np.quantile(batch.stats[:, k], quantiles)) for k in range(len(STATISTICS))]
    machine.v = rng.normal(0, 0.05, (size, factors)).astype(np.float32)
    index, value, n = machine.rows(batch, [meta_buckets(texts.column(c).combine_chunks()) for c in meta])
    begin = np.cumsum(n) - n
    past_w, past_v, past_b = np.full(size, 1e-6, np.float32), np.full((size, factors), 1e-6, np.float32), 1e-6
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    machine.bias = float(np.log(share / (1 - share)))
    for _ in range(epochs):
        order = rng.permutation(len(n))
        for low in range(0, len(order), 128):
            some = order[low : low + 128]
            k = n[some]
            pick = np.repeat(begin[some] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            i, x = index[pick], value[pick]
            row = np.repeat(np.arange(len(some)), k)
            z = machine.margin(i, x, k)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]).astype(np.float32)
            vx = machine.v[i] * x[:, None]
            s = np.add.reduceat(vx, np.cumsum(k) - k)
            distinct, place = np.unique(i, return_inverse=True)
            dw, dv = np.zeros(len(distinct), np.float32), np.zeros((len(distinct), factors), np.float32)
            np.add.at(dw, place, g[row] * x)
            np.add.at(dv, place, (g[row] * x)[:, None] * (s[row] - vx))
            dw = dw / len(some) + decay * machine.w[distinct]
            dv = dv / len(some) + decay * machine.v[distinct]
            past_w[distinct] += dw * dw
            past_v[distinct] += dv * dv
            machine.w[distinct] -= rate * dw / np.sqrt(past_w[distinct])
            machine.v[distinct] -= 0.3 * rate * dv / np.sqrt(past_v[distinct])
            db = float(g.mean())
            past_b += db * db
            machine.bias -= rate * db / np.sqrt(past_b)
    return machine


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", meta: tuple[str, ...] = (), **sample) -> FactorMachine:
    """Fit on the bounded sample of ``labelled.training_rows``, whose limits are passed on."""
    return fitted(training_rows(docs, labels, label, meta, **sample), lambda texts: fit(texts, meta))


def quality_score(docs: DataFrame, machine: FactorMachine, meta: tuple[str, ...] = ()) -> Column:
    """Score of every row from its whole ``text`` and metadata columns: 0 to 1, higher for label 1.

    Null texts are empty texts, null metadata is a value of its own, other columns have no influence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(rows: pa.Array) -> pa.Array:
        text, *more = rows.flatten()
        return pa.array(shared.value.scores(text, more))

    columns = [F.col(c).cast("string").alias(f"_{k}") for k, c in enumerate(("text", *meta))]
    return F.arrow_udf(score, T.DoubleType())(F.struct(*columns))
