"""Toxic spans with a linear-chain conditional random field, and document scores from its marginals.

The field tags every word as clean or toxic. A word's potential is the sum of weights of its hashed
features (the word, its beginnings, its endings, its length and shape, and one of all words); neighbouring tags have
transition weights. Token labels come from document labels: a feature marks a word as toxic where its
documents are toxic far more often than chance allows. Forward-backward marginals give the offending
offsets and, through their sums, the score of a document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chunkcast.llm.labelled import fitted, training_rows
from chunkcast.llm.textbytes import ALNUM, LOWER, hash_spans, mix, ngrams, slices, text_buffers, word_spans

BUCKETS = 1 << 20
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7), (3, 4, 5)
BLOCK = 64
FOUND = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


@dataclass
class Words:
    """Words of a run of texts: byte spans, words per text, and the distinct words behind them."""

    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    place: np.ndarray  # of every word among the distinct ones
    features: np.ndarray  # of every distinct word, one column for each kind of feature
    hashes: np.ndarray


def _some(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a range holds a marked byte."""
    before = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, dtype=np.int32, out=before[1:])
    return before[ends] > before[starts]


def describe(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, counts = word_spans(data, offsets, ALNUM)
    low = LOWER[data]
    h = hash_spans(low, starts, ends)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    at = order[new]
    s, e = starts[at], ends[at]
    length = e - s
    kinds = [h[at]]
    kinds += [hash_spans(low, s, np.minimum(s + k, e)) for k in PREFIXES]
    kinds += [hash_spans(low, np.maximum(e - k, s), e) for k in SUFFIXES]
    kinds.append(np.minimum(length, 24).astype(np.uint64))
    shape = np.zeros(len(s), np.int64)
    if len(s):
        shape += _some((data >= 48) & (data < 58), s, e)
        shape += 2 * _some(data >= 128, s, e)
        shape += 4 * (data[s] != low[s])
    kinds += [shape.astype(np.uint64), np.zeros(len(s), np.uint64)]
    features = [(mix(x, np.full(1, np.uint64(k + 1))) % np.uint64(BUCKETS)).astype(np.int64) for k, x in enumerate(kinds)]
    return Words(starts, ends, counts, place, np.stack(features, axis=1), h)


class Chains:
    """Forward-backward over many chains at once, exact for any length.

    Words lie in blocks of a fixed length; the products of the blocks' 2 x 2 matrices are chained per
    text, then messages run inside all blocks together.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.blocks = -(-counts // BLOCK)
        self.first = np.cumsum(self.blocks) - self.blocks
        total = int(self.blocks.sum())
        begin = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(counts)), self.blocks)
        at = begin[row] + (np.arange(total) - self.first[row]) * BLOCK
        left = np.minimum(begin[row] + counts[row] - at, BLOCK)
        self.index = at[None, :] + np.arange(BLOCK)[:, None]
        self.real = np.arange(BLOCK)[:, None] < left[None, :]
        self.index[~self.real] = 0

    def marginals(self, u: np.ndarray, t: np.ndarray, pairs: bool = False):
        """Probability of tag 1 for every word; ``u`` its potential, ``t`` the 2 x 2 transition weights.

        With ``pairs`` also the expected number of every transition. A chain starts after a clean word.
        """
        if not len(u):
            return np.zeros(0), np.zeros((2, 2))
        e = np.exp(t - t.max())
        u = u[self.index]
        psi0 = np.where(self.real, np.exp(-np.maximum(u, 0)), 1.0)
        psi1 = np.where(self.real, np.exp(np.minimum(u, 0)), 1.0)
        n = u.shape[1]
        p00, p11 = np.ones(n), np.ones(n)
        p01, p10 = np.zeros(n), np.zeros(n)
        for k in range(BLOCK):
            on = self.real[k]
            q00, q01 = (p00 * e[0, 0] + p01 * e[1, 0]) * psi0[k], (p00 * e[0, 1] + p01 * e[1, 1]) * psi1[k]
            q10, q11 = (p10 * e[0, 0] + p11 * e[1, 0]) * psi0[k], (p10 * e[0, 1] + p11 * e[1, 1]) * psi1[k]
            z = np.where(on, q00 + q01 + q10 + q11, 1.0)
            p00, p01, p10, p11 = (np.where(on, q / z, p) for q, p in ((q00, p00), (q01, p01), (q10, p10), (q11, p11)))
        a0, a1 = np.ones(n), np.zeros(n)  # messages into each block, from both sides
        b0, b1 = np.ones(n), np.ones(n)
        order = np.argsort(-self.blocks, kind="stable")
        longest = int(self.blocks.max()) if len(self.blocks) else 0
        sizes = self.blocks[order]
        for k in range(1, longest):
            here = self.first[order[: np.searchsorted(-sizes, -k, "left")]] + k
            x0, x1 = a0[here - 1], a1[here - 1]
            y0, y1 = x0 * p00[here - 1] + x1 * p10[here - 1], x0 * p01[here - 1] + x1 * p11[here - 1]
            a0[here], a1[here] = y0 / (y0 + y1), y1 / (y0 + y1)
        last = self.first + self.blocks - 1
        for k in range(1, longest):
            here = last[order[: np.searchsorted(-sizes, -k, "left")]] - k
            x0, x1 = b0[here + 1], b1[here + 1]
            y0, y1 = p00[here + 1] * x0 + p01[here + 1] * x1, p10[here + 1] * x0 + p11[here + 1] * x1
            b0[here], b1[here] = y0 / (y0 + y1), y1 / (y0 + y1)
        f0, f1 = np.empty_like(u), np.empty_like(u)
        for k in range(BLOCK):
            on = self.real[k]
            y0, y1 = (a0 * e[0, 0] + a1 * e[1, 0]) * psi0[k], (a0 * e[0, 1] + a1 * e[1, 1]) * psi1[k]
            z = y0 + y1
            f0[k], f1[k] = np.where(on, a0, 0), np.where(on, a1, 0)  # before this word
            a0, a1 = np.where(on, y0 / z, a0), np.where(on, y1 / z, a1)
        out = u  # not needed any more
        seen = np.zeros((2, 2))
        for k in range(BLOCK - 1, -1, -1):
            on = self.real[k]
            c0, c1 = psi0[k] * b0, psi1[k] * b1
            w00, w01 = f0[k] * e[0, 0] * c0, f0[k] * e[0, 1] * c1
            w10, w11 = f1[k] * e[1, 0] * c0, f1[k] * e[1, 1] * c1
            z = np.where(on, w00 + w01 + w10 + w11, 1.0)
            out[k] = (w01 + w11) / z
            if pairs:
                seen += [[(w00 / z)[on].sum(), (w01 / z)[on].sum()], [(w10 / z)[on].sum(), (w11 / z)[on].sum()]]
            y0, y1 = e[0, 0] * c0 + e[0, 1] * c1, e[1, 0] * c0 + e[1, 1] * c1
            s = y0 + y1
            b0, b1 = np.where(on, y0 / s, b0), np.where(on, y1 / s, b1)
        flat = np.zeros(int(self.counts.sum()))
        flat[self.index[self.real]] = out[self.real]
        return flat, seen


def summaries(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: 1, the log odds that some word is toxic, and the log of the expected number."""
    first = np.cumsum(counts) - counts
    p = np.clip(p, 0, 1 - 1e-9)
    none = np.concatenate([[0], np.cumsum(np.log1p(-p))])
    some = np.concatenate([[0], np.cumsum(p)])
    none, some = none[first + counts] - none[first], np.maximum(some[first + counts] - some[first], 0)
    none = np.minimum(none, -1e-9)
    odds = np.log(-np.expm1(none)) - none
    return np.stack([np.ones(len(counts)), np.clip(odds, -12, 12), np.log1p(some)], axis=1)


@dataclass
class ToxicityField:
    weights: np.ndarray
    transitions: np.ndarray
    doc: np.ndarray

    def tag(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
        """Words, marginals of every word, and the score of every text."""
        words = describe(data, offsets)
        u = np.clip(self.weights[words.features].sum(1), -30, 30)[words.place]
        p, _ = Chains(words.counts).marginals(u, self.transitions)
        z = summaries(p, words.counts) @ self.doc
        return words, p, 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of two columns of small numbers."""
    both = a.astype(np.int64)
    both <<= 32
    both |= b
    both.sort()
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return both >> 32, both & 0xFFFFFFFF


def token_labels(words: Words, labels: np.ndarray, groups: np.ndarray, chance: float = 0.01) -> np.ndarray:
    """Weak labels of the words of labelled texts.

    A feature of a word counts the groups of near-equal texts that hold it. It marks its words where the
    share of toxic groups exceeds the overall share by more than all features together would reach by
    chance (a Chernoff bound, ``chance`` for all). Marked words of toxic texts are toxic.
    """
    row = np.repeat(np.arange(len(words.counts), dtype=np.int32), words.counts)
    share = np.clip(labels.mean(), 1e-3, 0.9)
    kinds = words.features[:, : 1 + len(PREFIXES)]
    bound = np.log(max(kinds.size, 1) / chance)
    _, group = np.unique(groups, return_inverse=True)
    word, owner = _distinct_pairs(words.place, (2 * group + labels).astype(np.int32)[row])
    marked = np.zeros(len(words.features), bool)
    for k in range(kinds.shape[1]):
        feature, of = _distinct_pairs(kinds[word, k], owner)
        good = np.bincount(feature[of % 2 == 1], minlength=BUCKETS)
        some = np.flatnonzero(good)  # no others can be marked
        good, bad = good[some].astype(float), np.bincount(feature[of % 2 == 0], minlength=BUCKETS)[some].astype(float)
        total = good + bad
        rate = np.clip(good / total, 1e-9, 1 - 1e-9)
        far = total * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
        mark = np.zeros(BUCKETS, bool)
        mark[some] = (rate > max(share, 0.8)) & (far > bound)
        marked |= mark[kinds[:, k]]
    return marked[words.place] & (labels[row] == 1)


def fit(texts: pa.Table, width: int = 200, clean_per_toxic: int = 4, steps: int = 100, rate: float = 0.5, decay: float = 1e-5) -> ToxicityField:
    """Maximise the conditional likelihood of the token labels, then fit the document score.

    The field sees stretches of ``width`` words: those with toxic words and ``clean_per_toxic`` times as
    many others. Without examples of both labels every text gets the share of toxic examples.
    """
    labels = texts.column("label").to_numpy()
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    field = ToxicityField(np.zeros(BUCKETS), np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    if len(np.unique(labels)) < 2:
        return field
    words, groups = _described(texts)
    y = token_labels(words, labels, groups)
    if not y.any():
        return field
    rng = np.random.default_rng(9)
    pieces = -(-words.counts // width)
    of = np.repeat(np.arange(len(pieces)), pieces)
    first = np.cumsum(words.counts) - words.counts
    k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[of] + k * width
    size = np.minimum(words.counts[of] - k * width, width)
    toxic = _some(y, begin, begin + size)
    clean = np.flatnonzero(~toxic & (labels[of] == 0))
    clean = rng.permutation(clean)[: max(200, clean_per_toxic * int(toxic.sum()))]
    use = np.sort(np.concatenate([np.flatnonzero(toxic), clean]))
    begin, size = begin[use], size[use]
    pick = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    distinct, place = np.unique(words.place[pick], return_inverse=True)
    used, compact = np.unique(words.features[distinct], return_inverse=True)
    compact = compact.reshape(len(distinct), -1).astype(np.int32)
    tags = y[pick].astype(np.int8)
    weights = np.zeros(len(used))
    wanted = np.bincount(place, tags, len(distinct))
    chains = _chains_in_parts(size)
    before = np.concatenate([[0], tags[:-1]])
    before[np.cumsum(size) - size] = 0
    observed = np.zeros((2, 2))
    np.add.at(observed, (before, tags), 1)
    del pick, tags, before
    past, past_t = np.full(len(used), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        u = np.clip(weights[compact].sum(1), -30, 30)[place]
        p, seen = [], np.zeros((2, 2))
        for low, high, part in chains:
            own, pairs = part.marginals(u[low:high], field.transitions, True)
            p.append(own)
            seen += pairs
        gap = np.bincount(place, np.concatenate(p), len(distinct)) - wanted
        g = np.bincount(compact.ravel(), np.repeat(gap, compact.shape[1]), len(used)) / len(size) + decay * weights
        gt = (seen - observed) / len(size) + decay * field.transitions
        past += g * g
        past_t += gt * gt
        weights -= rate * g / np.sqrt(past)
        field.transitions -= rate * gt / np.sqrt(past_t)
    field.weights[used] = weights
    x = _summaries_in_parts(field, words)
    beta = field.doc.copy()
    for _ in range(60):  # damped Newton steps on the penalised logistic loss
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.diag([1e-3, 0.1, 0.1])
        hessian = (x * (q * (1 - q))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, x.T @ (q - labels) + ridge @ beta)
        beta -= step / max(1.0, float(np.abs(step).max()))
    beta[1:] = np.maximum(beta[1:], 0)
    field.doc = beta
    return field


def _described(texts: pa.Table) -> tuple[Words, np.ndarray]:
    """The words of all texts, without their spans, and a group for each text: those with the same least run of
    three words count once. Described part by part, as a part takes many times its bytes."""
    data, offsets = text_buffers(texts.column("text"))
    counts, places, features, hashes, groups, before = [], [], [], [], [], 0
    for low, high in slices(offsets, 1_000_000):
        words = describe(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        grams, have = ngrams(words.hashes, words.counts, 3)
        at, some = np.cumsum(have) - have, np.flatnonzero(have)
        group = np.arange(low, high)
        if len(some):
            group[some] = np.minimum.reduceat(mix(grams, np.full(1, np.uint64(9))), at[some]).view(np.int64)
        distinct = np.zeros(len(words.features), np.uint64)
        distinct[words.place] = words.hashes
        for own, part in zip((counts, places, features, hashes, groups), (words.counts, (words.place + before).astype(np.int32), words.features.astype(np.int32), distinct, group)):
            own.append(part)
        before += len(distinct)
    del words, grams
    _, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    none, place = np.zeros(0, np.int64), place.astype(np.int32)
    places = np.concatenate([place[p] for p in places])
    least = np.empty((len(first), features[0].shape[1]), np.int32)
    for low, part in zip(np.cumsum([0] + [len(x) for x in hashes]).tolist(), features):
        own = np.flatnonzero((first >= low) & (first < low + len(part)))
        least[own] = part[first[own] - low]
    return Words(none, none, np.concatenate(counts), places, least, none), np.concatenate(groups)


def _chains_in_parts(counts: np.ndarray, most: int = 250_000) -> list[tuple[int, int, Chains]]:
    """First and last word, and the chains, of about ``most`` words at a time, as the messages take many times a word."""
    ends, parts, low = np.cumsum(counts), [], 0
    while low < len(counts):
        first = int(ends[low] - counts[low])
        high = max(int(np.searchsorted(ends, first + most, "right")), low + 1)
        parts.append((first, int(ends[high - 1]), Chains(counts[low:high])))
        low = high
    return parts


def _summaries_in_parts(field: ToxicityField, words: Words, most: int = 100_000) -> np.ndarray:
    """``summaries`` of all texts, a part of about ``most`` words at a time, as the messages take many times a word."""
    potential = np.clip(field.weights[words.features].sum(1), -30, 30)
    ends = np.cumsum(words.counts)
    cuts = np.unique(np.searchsorted(ends, np.arange(most, ends[-1] + most, most), "right").clip(1, len(ends)))
    parts, low = [], 0
    for high in cuts.tolist():
        counts = words.counts[low:high]
        place = words.place[ends[low] - words.counts[low] : ends[high - 1]]
        parts.append(summaries(Chains(counts).marginals(potential[place], field.transitions)[0], counts))
        low = high
    if low < len(ends):
        parts.append(summaries(np.zeros(0), words.counts[low:]))
    return np.concatenate(parts)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", **sample) -> ToxicityField:
    """Fit on the bounded sample of ``labelled.training_rows``, whose limits are passed on."""
    return fitted(training_rows(docs, labels, label, **sample), fit)


def toxicity(docs: DataFrame, field: ToxicityField, marginal: float = 0.5, slice_bytes: int = 4_000_000) -> Column:
    """A struct of every row's ``score`` (0 to 1) and ``spans``: UTF-8 byte ranges of toxic words.

    Neighbouring words of at least ``marginal`` probability share a span. Null texts are empty texts; an
    empty text has the score of a text without toxic words. Other columns have no influence. ``slice_bytes`` of text
    are tagged at once; a word's shape is that of its first occurrence there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def tag(column: pa.Array) -> pa.Array:
        data, offsets = text_buffers(column)
        scores, spans = [], []
        for low, high in slices(offsets, slice_bytes):
            own = offsets[low : high + 1] - offsets[low]
            words, p, z = shared.value.tag(data[offsets[low] : offsets[high]], own)
            scores.append(z)
            rows: list = [[] for _ in range(high - low)]
            ends = np.cumsum(words.counts)
            last = -2
            for k in np.flatnonzero(p >= marginal).tolist():
                row = int(np.searchsorted(ends, k, "right"))
                start, end = int(words.starts[k] - own[row]), int(words.ends[k] - own[row])
                if rows[row] and last == k - 1:
                    rows[row][-1]["end"] = end
                else:
                    rows[row].append({"start": start, "end": end})
                last = k
            spans += rows
        flat = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(flat), pa.array(spans, _SPANS)], ["score", "spans"])

    return F.arrow_udf(tag, FOUND)(F.col("text").cast("string"))
