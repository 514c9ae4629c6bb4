"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of runs of one to ``order`` words are taken over all training texts. An n-gram whose count is c
gets the level 1 + floor(log2 c) and its keys (n-gram, 1) to (n-gram, level) are put into a Bloom filter;
a lookup probes level after level until one is missing. The score of a word interpolates the
probabilities of its contexts, from the shortest to the longest, with the counts so found: a context
keeps as much for other words as words have been new after contexts of its level (Witten and Bell).

Every n-gram of the training texts is stored, so a filter grows with the corpus: ``BITS_PER_KEY`` bits for
each training word and order. It is a table of segments that no process holds as a whole. The n-grams of
all texts are dealt out by segment, packed for a slice of text at a time and each once a slice; the task of a
segment adds up their counts, fills the segment, and answers the same n-grams by probing it, so they
are shuffled once an order. The answers go back to the slices, where they are also the levels of the contexts
of the next order. Levels of the most frequent words come from their exact counts, which every task holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chunkcast.llm.labelled import remainder
from chunkcast.llm.textbytes import NOT_SPACE, binary_buffers, binary_column, mix, ngrams, signed, slices, text_buffers, word_hashes
from chunkcast.session import freed_shuffles, staged as written

END, BEGIN = np.uint64(0xE4D00000000000E1), np.uint64(0xBE61000000000B01)
SEGMENT_BITS = 1 << 22
SEGMENT_MASK = np.int64(SEGMENT_BITS - 1)
PROBES = 5
BITS_PER_KEY = 10
LEVELS = 48
#: Most frequent words whose exact counts every worker holds, 16 bytes each.
EXACT_WORDS = 1 << 19
#: Rows of a slice at most.
MOST_ROWS = 1 << 20


def staged(df: DataFrame, name: str) -> DataFrame:
    with freed_shuffles(df.sparkSession):
        return written(df, name)


@dataclass
class CountFilter:
    """Bloom filter of one order's quantised counts, in segments of ``SEGMENT_BITS`` bits."""

    bits: np.ndarray | None  # uint8, packed; None where the segments stay in their table
    segments: int
    means: np.ndarray  # mean count of the n-grams of a level; [0] is that of n-grams not stored
    number: np.ndarray  # n-grams of each level
    novel: np.ndarray | None = None  # mean number of distinct words after an n-gram of a level

    def probes(self, keys: np.ndarray, level: int):
        """A start and a step of each key's probes at a level, to be taken modulo the segment's bits."""
        a = mix(keys, np.full(1, np.uint64(level))).view(np.int64)
        return a, a >> 32 | 1

    def levels(self, keys: np.ndarray, repeated: bool = False) -> np.ndarray:
        """Levels found by repeated probes, 0 for n-grams not stored; ``repeated`` looks equal keys up once."""
        if repeated and len(keys):
            order = np.argsort(keys)
            new = np.ones(len(keys), bool)
            new[1:] = keys[order][1:] != keys[order][:-1]
            out = np.empty(len(keys), np.int8)
            out[order] = self.levels(keys[order][new])[np.cumsum(new) - 1]
            return out
        out = np.zeros(len(keys), np.int8)
        alive, base = np.arange(len(keys)), segment_of(keys, self.segments) * SEGMENT_BITS
        for level in range(1, LEVELS):
            if not len(alive) or not self.segments:
                break
            a, step = self.probes(keys[alive], level)
            for _ in range(PROBES):
                place = base + (a & SEGMENT_MASK)
                hit = (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
                alive, base, a, step = alive[hit], base[hit], a[hit], step[hit]
                a = a + step
            out[alive] = level
        return out

    def put(self, keys: np.ndarray, top: np.ndarray) -> None:
        """Set the bits of the keys' levels up to ``top``."""
        base = segment_of(keys, self.segments) * SEGMENT_BITS
        on = np.zeros(self.segments * SEGMENT_BITS, bool)
        for level in range(1, int(top.max(initial=0)) + 1):
            high = top >= level
            a, step = self.probes(keys[high], level)
            for k in range(PROBES):
                on[base[high] + (a + k * step & SEGMENT_MASK)] = True
        self.bits |= np.packbits(on, bitorder="little")

    def as_context(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and number of distinct following words of contexts; 0 and 1 of those not stored."""
        stored = level > 0
        return np.where(stored, self.means[level], 0.0), np.where(stored, self.novel[level], 1.0)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """By the first 32 bits of the key, so that segments are ranges of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(max(segments, 1)) >> np.uint64(32)).astype(np.int64)


def segment_start(segment: np.ndarray, segments: int) -> np.ndarray:
    """A key that no key of the segment is below."""
    return (segment.astype(np.uint64) << np.uint64(32)) // np.uint64(max(segments, 1)) << np.uint64(32)


def distinct_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, ascending, and the place there of each: ``np.unique`` with its inverse.

    Sorts numbers of a hash's first bits and its place; only where these leave hashes out of order, the hashes.
    """
    mask = np.uint64((1 << max(len(h) - 1, 1).bit_length()) - 1)
    by = np.sort(h & ~mask | np.arange(len(h), dtype=np.uint64)) & mask
    ordered = h[by]
    if (ordered[1:] < ordered[:-1]).any():
        return np.unique(h, return_inverse=True)
    new = np.ones(len(h), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    place = np.empty(len(h), np.int64)
    place[by] = np.cumsum(new) - 1
    return ordered[new], place


def planes(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of ``sizes`` numbers as binaries, their bytes by significance, which compression shortens."""
    width, at = flat.itemsize, 0
    raw = flat.view(np.uint8).reshape(-1, width)
    out = np.empty(raw.size, np.uint8)
    for n in sizes.tolist():
        out[at * width : (at + n) * width].reshape(width, n)[:] = raw[at : at + n].T
        at += n
    return binary_column(out, sizes * width)


def from_planes(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``planes`` and the sizes of their runs."""
    width = np.dtype(kind).itemsize
    data, offsets = binary_buffers(column.combine_chunks())
    sizes, at = np.diff(offsets) // width, 0
    raw = np.empty((int(sizes.sum()), width), np.uint8)
    for n in sizes.tolist():
        raw[at : at + n] = data[at * width : (at + n) * width].reshape(width, n).T
        at += n
    return raw.reshape(-1).view(kind), sizes


@dataclass
class NgramModel:
    """Filters of all orders, totals of the training words and the exact counts of frequent words.

    ``segments`` is the table ``order, segment, bits`` of all filters; it stays out of what tasks are sent.
    """

    order: int
    n: int = 0
    v: int = 0
    filters: list[CountFilter] = field(default_factory=list)
    segments: DataFrame | None = None
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def load(self) -> None:
        """Bring all segments here, for a small model that is asked outside of Spark."""
        for own in self.filters:
            own.bits = np.zeros(own.segments * SEGMENT_BITS // 8, np.uint8)
        for r in self.segments.toLocalIterator():
            low = r.segment * SEGMENT_BITS // 8
            self.filters[r.order - 1].bits[low : low + SEGMENT_BITS // 8] = np.frombuffer(r.bits, np.uint8)

    def lean(self) -> NgramModel:
        """What every task is sent: totals, levels' means and the frequent words, no segments."""
        return replace(self, segments=None, filters=[replace(f, bits=None) for f in self.filters])

    def exact(self, h: np.ndarray) -> np.ndarray:
        """Training counts of frequent words; 0 for all others."""
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        near = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[near] == h, self.counts[near], 0)

    def log_probabilities(self, h: np.ndarray, counts: np.ndarray, levels: list[np.ndarray] | None = None) -> np.ndarray:
        """log10 probability of every word and end of a run of texts; rows have ``counts + 1`` values.

        ``levels`` are those of all n-grams of each order, and then ``h`` has the marks already; without them the
        segments are brought here.

        P_1(w) = mean count of w's level / (N + V + 1), with one added to counts, which sums to one over
        all words and one unknown word; P_n = (c(context, w) + T * P_{n-1}) / (c(context) + T) with T distinct
        words after a context of that level.
        """
        seq, n = with_marks(h, counts) if levels is None else (h, counts + 2)
        first = np.cumsum(n) - n
        at = np.ones(len(seq), bool)
        at[first] = False  # no score for the beginning
        if levels is None:
            if any(own.bits is None for own in self.filters):
                self.load()
            levels = [own.levels(grams, repeated=True) for own, grams in zip(self.filters, runs(seq, n, self.order))]
            c = self.exact(seq)
            levels[0] = np.where(c > 0, level_of(c), levels[0])
        one = levels[0]
        p = (self.filters[0].means[one] + 1) / (self.n + self.v + 1)
        context, new = self.filters[0].as_context(one) if self.order > 1 else (p, p)
        for k in range(2, self.order + 1):
            if len(seq) < k:
                break
            level = levels[k - 1]
            found = np.where(level > 0, self.filters[k - 1].means[level], 0.0)
            ends = np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))])
            place = np.arange(len(level)) + np.repeat(first + k - 1 - ends[:-1], np.diff(ends))  # the last word's place
            before, other = context[place - 1], new[place - 1]
            p[place] = (np.minimum(found, before) + other * p[place]) / (before + other)
            if k < self.order:
                context, new = np.zeros(len(seq)), np.ones(len(seq))
                context[place], new[place] = self.filters[k - 1].as_context(level)
        return np.log10(p[at])


def with_marks(h: np.ndarray, counts: np.ndarray, begin=BEGIN, end=END) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, or other names of words, with a beginning and an end in every row."""
    ends = np.cumsum(counts)
    return np.insert(np.insert(h, ends, end), ends - counts + np.arange(len(counts)), begin), counts + 2


def runs(seq: np.ndarray, n: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams of one to ``order`` words of marked texts."""
    return [seq, *(ngrams(seq, n, k)[0] for k in range(2, order + 1))]


def _tallies(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[at], np.diff(np.append(at, len(h)))


def _rows(docs: DataFrame, held: int, modulo: int) -> DataFrame:
    out = F.coalesce(remainder("doc_id", modulo) == held, F.lit(False))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def count_words(texts: DataFrame) -> DataFrame:
    """``h, c`` of all words and ends of a table ``text``, added up per task before the shuffle."""

    def count(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for low, high in slices(offsets, 8_000_000):
                h, n = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], NOT_SPACE)
                keys, c = _tallies(np.insert(h, np.cumsum(n), END))
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(c)], ["h", "c"])

    return texts.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def dealt(segment: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The segments that occur, ascending, and each column's values of a segment as one binary."""
    by = np.argsort(segment, kind="stable")
    at = np.flatnonzero(np.diff(segment[by], prepend=-1))
    sizes = np.diff(np.append(at, len(by)))
    return segment[by][at], [binary_column(c[by], sizes) for c in columns]


def joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return binary_buffers(table.column(column).combine_chunks())[0].view(kind)


def level_of(c: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), 0 for c = 0."""
    return np.frexp(c.astype(np.float64))[1].astype(np.int8)


def filter_of(counts: DataFrame, least: int = 1) -> tuple[CountFilter, DataFrame | None]:
    """The filter of the n-grams ``h, c`` of a count of ``least`` or more, and its table ``segment, bits``."""
    level = F.when(F.col("c") >= least, F.floor(F.log2(F.col("c") / least) + 1e-12) + 1).otherwise(0).cast("int")
    rows = counts.withColumn("level", level)
    seen = {r.level: r for r in rows.groupBy("level").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}
    means, number = np.zeros(LEVELS), np.zeros(LEVELS, np.int64)
    for k, r in seen.items():
        means[k], number[k] = r.c / r.n, r.n
    segments = -(-sum(k * r.n for k, r in seen.items()) * BITS_PER_KEY // SEGMENT_BITS)
    own = CountFilter(None, segments, means, number)

    def fill(key, table):
        one = CountFilter(np.zeros(SEGMENT_BITS // 8, np.uint8), 1, means, number)
        one.put(table.column("h").to_numpy().view(np.uint64), table.column("level").to_numpy())
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([one.bits.tobytes()], pa.binary())})

    def segment(h: pa.Array) -> pa.Array:
        return pa.array(segment_of(h.to_numpy().view(np.uint64), segments))

    numbered = rows.where("level > 0").select("h", "level").withColumn("segment", F.arrow_udf(segment, "long")("h"))
    return own, numbered.groupBy("segment").applyInArrow(fill, "segment long, bits binary")


def build_filter(counts: DataFrame, least: int) -> CountFilter:
    """The filter of ``filter_of`` with all its bits, for a small table."""
    own, table = filter_of(counts, least)
    NgramModel(1, filters=[own], segments=table.select(F.lit(1).alias("order"), "segment", "bits")).load()
    return own


@dataclass
class Learned:
    """A model, the exact counts ``h, c`` of its words, and the slices of all texts with the levels of their n-grams."""

    model: NgramModel
    words: DataFrame
    sliced: DataFrame
    levels: DataFrame


def learn(docs: DataFrame, order: int = 3, modulo: int = 7, held: int = 2, keep: bool = True) -> Learned:
    """The model of all documents but the held-out ones, and the levels of the n-grams of all documents.

    Without ``keep`` the filters of two words and more last as long as the tasks that fill and probe them,
    and the model can score no other documents.

    A document is held out if crc32(doc_id as text) modulo ``modulo`` is ``held``; null doc_ids are not.
    Without training documents every word has the probability of an unknown one.
    """
    spark = docs.sparkSession
    rows = _rows(docs, held, modulo)
    words = staged(count_words(rows.where("not held_out").select("text")), "word-counts")
    totals = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    model = NgramModel(order, totals.n or 0, totals.v)
    ends = words.where(F.col("h") == int(END.view(np.int64))).first()
    begin = spark.createDataFrame([(int(BEGIN.view(np.int64)), ends.c)] if ends else [], "h long, c long")
    with freed_shuffles(spark):
        one, table = filter_of(words.unionByName(begin))
        top = words.orderBy(F.col("c").desc(), "h").limit(EXACT_WORDS).unionByName(begin).toArrow()
    keys, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    by = np.argsort(keys)
    model.words, model.counts = keys[by], c[by]
    model.filters.append(one)
    model.segments = staged(table, "filter-1").select(F.lit(1).alias("order"), "segment", "bits")
    contexts = one.number.copy()
    if ends:
        contexts[level_of(np.array([ends.c]))] -= 1  # nothing follows an end

    sliced = staged(cut_slices(rows), "slices")
    levels = last = staged(find_levels(sliced, model, [1]), "levels-1")
    segments = -(-model.n * BITS_PER_KEY // SEGMENT_BITS)  # an n-gram of count c has at most c levels
    for k in range(2, order + 1):
        dealt_out = deal_ngrams(sliced, last, model, k, segments)
        table = staged(dealt_out.groupBy("segment").applyInArrow(fill_and_answer(segments, keep), FILLED), f"filter-{k}")
        bits, zipped = table.where("slice is null"), F.arrays_zip("number", "mass", "contexts", "types")
        at = bits.select(F.posexplode(zipped).alias("level", "x")).groupBy("level")
        sums = np.zeros((4, LEVELS))
        with freed_shuffles(spark):
            for r in at.agg(*[F.sum(f"x.{name}").alias(name) for name in ("number", "mass", "contexts", "types")]).collect():
                sums[:, r.level] = r.number, r.mass, r.contexts, r.types
        number, mass, after, types = sums
        model.filters[-1].novel = np.maximum(types / np.maximum(contexts, 1), 1)
        contexts = after
        model.filters.append(CountFilter(None, segments, mass / np.maximum(number, 1), number.astype(np.int64)))
        model.segments = model.segments.unionByName(bits.select(F.lit(k).alias("order"), "segment", "bits"))
        last = table.where("slice is not null").select("slice", F.lit(k).alias("order"), "segment", "levels")
        levels = levels.unionByName(last)
    return Learned(model, words, sliced, levels)


def train(docs: DataFrame, order: int = 3, modulo: int = 7, held: int = 2) -> tuple[NgramModel, DataFrame]:
    """The model of ``learn`` and the exact counts ``h, c`` of its words, to score other documents."""
    learned = learn(docs, order, modulo, held)
    return learned.model, learned.words


def cut_slices(rows: DataFrame) -> DataFrame:
    """``slice, rows, words, at``: all rows, a slice of text at a time, with words hashed once.

    ``rows`` has ids, held_out and numbers of words in Arrow's stream format, ``words`` the steps between the hashes of
    the distinct words, the most frequent first, and ``at`` the place there of every word of the slice.
    """

    def cut(batches):
        part, number, zstd = TaskContext.get().partitionId() << 16, 0, pa.Codec("zstd")
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for low, high in slices(offsets, 8_000_000):
                for first in range(low, high, MOST_ROWS):
                    last = min(first + MOST_ROWS, high)
                    h, n = word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], NOT_SPACE)
                    words, at = distinct_places(h)
                    by = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
                    rank = np.empty(len(by), "<u4")
                    rank[by] = np.arange(len(by))
                    own = pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in (0, 1)), pa.array(n)], ["doc_id", "held_out", "n"])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, own.schema) as writer:
                        writer.write_batch(own)
                    packed = zstd.compress(planes(rank[at], np.array([len(at)]))[0].as_buffer(), asbytes=True)
                    steps = planes(np.diff(words[by], prepend=np.uint64(0)), np.array([len(by)]))  # equally frequent words ascend
                    cells = [part + number, sink.getvalue().to_pybytes(), steps[0].as_py(), packed]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in cells], ["slice", "rows", "words", "at"])
                    number += 1

    return rows.mapInArrow(cut, "slice long, rows binary, words binary, at binary")


@dataclass
class Slice:
    """Rows of a slice, words of each, the distinct words with the marks at the end, and every marked word's place there."""

    number: int
    rows: pa.Table
    n: np.ndarray
    words: np.ndarray
    at: np.ndarray

    @cached_property
    def seq(self) -> np.ndarray:
        return self.words[self.at]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the runs of k marked words, and how many each row has."""
        return (self.seq, self.n + 2) if k == 1 else ngrams(self.seq, self.n + 2, k)

    def rare(self, model: NgramModel) -> tuple[np.ndarray, np.ndarray]:
        """The training counts of ``words``, 0 for all that are not frequent, and the places of these."""
        c = model.exact(self.words)
        return c, np.flatnonzero(c == 0)

    def levels(self, k: int, model: NgramModel, answers: pa.Table) -> np.ndarray:
        """Levels of the runs of k words from the slice's answers; frequent words need none."""
        found = answers.filter(pc.equal(answers.column("order"), k)).sort_by("segment")
        found = joined(found, "levels", np.int8) if found.num_rows else None
        if k > 1:
            keys = self.grams(k)[0]
            return found[distinct_places(keys)[1]] if found is not None else np.zeros(len(keys), np.int8)
        c, rest = self.rare(model)
        level = level_of(c)
        if found is not None:
            level[rest] = found[distinct_places(self.words[rest])[1]]
        return level[self.at]


def opened(table) -> list[Slice]:
    """The slices of a table of ``cut_slices``."""
    out = []
    for number, raw, words, at in zip(*(table.column(k) for k in range(4))):
        rows = pa.ipc.open_stream(raw.as_buffer()).read_all()
        n = rows.column("n").to_numpy()
        total = int(n.sum())
        flat = pa.Codec("zstd").decompress(at.as_buffer(), decompressed_size=4 * total, asbytes=True) if total else b""
        at = from_planes(pa.chunked_array([pa.array([flat])]), "<u4")[0].astype(np.int64)
        words = np.cumsum(from_planes(pa.chunked_array([pa.array([words.as_py()])]), "<u8")[0])
        marked, _ = with_marks(at, n, len(words), len(words) + 1)
        out.append(Slice(number.as_py(), rows, n, np.append(words, [BEGIN, END]), marked))
    return out


#: Added to the level of an n-gram's context where the n-gram ends its text.
LAST = 64


def deal_ngrams(sliced: DataFrame, answers: DataFrame, model: NgramModel, k: int, segments: int) -> DataFrame:
    """``segment, slice, h, c, tag``: the distinct n-grams of k words of every slice, by filter segment.

    ``h`` packs the ascending keys as steps, ``c`` how often each occurs in the slice's training texts, and ``tag``
    the level that the filter of k - 1 words gives for the context, with ``LAST`` added at ends.
    """
    shared = sliced.sparkSession.sparkContext.broadcast(model.lean())

    def deal(own, answers):
        model, done = shared.value, [pa.RecordBatch.from_pylist([], pa.schema(DEALT))]
        for own in opened(own):
            grams, ends = own.grams(k)
            if not len(grams):
                continue
            parts, have = own.grams(k - 1)
            follows = np.ones(len(parts), bool)
            follows[np.cumsum(have)[have > 0] - 1] = False
            tag = own.levels(k - 1, model, answers)[follows].astype(np.uint8)
            tag[np.cumsum(ends)[ends > 0] - 1] += LAST
            distinct, place = distinct_places(grams)
            held = own.rows.column("held_out").to_numpy()
            c = np.bincount(place, np.repeat(~held, ends), len(distinct)).astype("<u4")
            tags = np.empty(len(distinct), np.uint8)
            tags[place] = tag
            segment = segment_of(distinct, segments)
            first = np.flatnonzero(np.diff(segment, prepend=-1))
            sizes, of = np.diff(np.append(first, len(distinct))), segment[first]
            steps = np.diff(distinct, prepend=distinct[:1])
            steps[first] = distinct[first] - segment_start(of, segments)
            packed = [planes(x, sizes) for x in (steps, c, tags)]
            done.append(pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.full(len(of), own.number)), *packed], [name for name, _ in DEALT]))
        return pa.Table.from_batches(done)

    kinds = ", ".join(f"{name} {'long' if kind == pa.int64() else 'binary'}" for name, kind in DEALT)
    return sliced.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(deal, kinds)


DEALT = [("segment", pa.int64()), ("slice", pa.int64()), ("h", pa.binary()), ("c", pa.binary()), ("tag", pa.binary())]
FILLED = (
    "segment long, bits binary, number array<long>, mass array<long>, contexts array<long>, types array<long>, slice long, levels binary"
)


def fill_and_answer(segments: int, keep: bool):
    """Of a segment's rows of ``deal_ngrams``: its bits, if they are to be kept, and, by level, the number and occurrences of its n-grams, of those
    among them that can be contexts (by the level that probes find), and of those that follow contexts of
    the level; then for every slice the levels that probes find for its n-grams.
    """

    def fill(key, table):
        steps, sizes = from_planes(table.column("h"), "<u8")
        (c, _), (tag, _) = from_planes(table.column("c"), "<u4"), from_planes(table.column("tag"), "u1")
        sums = np.cumsum(steps)  # modulo 2^64, as the differences are
        first = np.cumsum(sizes) - sizes
        h = sums - np.repeat(sums[first] - steps[first], sizes) + segment_start(np.array([key[0].as_py()]), segments)
        by = np.argsort(h, kind="stable")
        h = h[by]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        keys, times = h[first], np.diff(np.append(first, len(h)))
        c, tag = np.add.reduceat(c[by].astype(np.int64), first), tag[by][first]
        seen = c > 0
        level = level_of(c[seen])
        own = CountFilter(np.zeros(SEGMENT_BITS // 8, np.uint8), 1, np.zeros(0), np.zeros(0))
        own.put(keys[seen], level)
        found = own.levels(keys)
        levels = np.empty(len(h), np.int8)
        levels[by] = np.repeat(found, times)
        sums = {
            "number": np.bincount(level, minlength=LEVELS),
            "mass": np.bincount(level, c[seen], LEVELS).astype(np.int64),
            "contexts": np.bincount(found[seen & (tag < LAST)], minlength=LEVELS),
            "types": np.bincount(tag[seen] % LAST, minlength=LEVELS),
        }
        none = len(sizes)
        return pa.table({
            "segment": pa.array([key[0].as_py()] * (none + 1), pa.int64()),
            "bits": pa.array([own.bits.tobytes() if keep else None, *[None] * none], pa.binary()),
            **{name: pa.array([x.tolist(), *[None] * none], pa.list_(pa.int64())) for name, x in sums.items()},
            "slice": pa.concat_arrays([pa.nulls(1, pa.int64()), *table.column("slice").chunks]),
            "levels": pa.concat_arrays([pa.nulls(1, pa.binary()), binary_column(levels, sizes)]),
        })

    return fill


def find_levels(sliced: DataFrame, model: NgramModel, orders: list[int] | None = None) -> DataFrame:
    """``slice, order, segment, levels``: the levels of a slice's distinct n-grams, by key.

    Frequent words, whose counts every task holds, are not asked.
    """
    shared = sliced.sparkSession.sparkContext.broadcast(model.lean())
    orders = orders or list(range(1, model.order + 1))

    def probe(batches):
        model = shared.value
        for batch in batches:
            for own in opened(batch):
                for k in orders:
                    keys = np.unique(own.grams(k)[0] if k > 1 else own.words[own.rare(model)[1]])
                    if model.filters[k - 1].segments and len(keys):
                        of, (packed,) = dealt(segment_of(keys, model.filters[k - 1].segments), keys)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(of), own.number)), pa.array(np.full(len(of), k, np.int32)), pa.array(of), packed], ["slice", "order", "segment", "h"]
                        )

    def answer(probes, segment):
        h = joined(probes, "h", np.uint64)
        sizes = pc.binary_length(probes.column("h")).to_numpy() // 8
        level = np.zeros(len(h), np.int8)
        if segment.num_rows:
            own = CountFilter(np.frombuffer(segment.column("bits")[0].as_buffer(), np.uint8), 1, np.zeros(0), np.zeros(0))
            level = own.levels(h, repeated=True)
        return probes.drop_columns(["h"]).append_column("levels", binary_column(level, sizes))

    probes = sliced.mapInArrow(probe, "slice long, order int, segment long, h binary").groupBy("order", "segment")
    segments = model.segments.where(F.col("order").isin(orders)).groupBy("order", "segment")
    return probes.cogroup(segments).applyInArrow(answer, "slice long, order int, segment long, levels binary")


SCORED = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, h long, m int"


def score_documents(docs: DataFrame, model: NgramModel, words: DataFrame, modulo: int = 7, held: int = 2) -> DataFrame:
    """The scores of ``scored_slices`` of any documents by a trained model."""
    sliced = staged(cut_slices(_rows(docs, held, modulo)), "slices")
    return scored_slices(Learned(model, words, sliced, staged(find_levels(sliced, model), "levels")))


def learn_and_score(docs: DataFrame, order: int = 3, modulo: int = 7, held: int = 2) -> DataFrame:
    """The scores of ``scored_slices`` of the documents that the model is learned from and of those held out."""
    return scored_slices(learn(docs, order, modulo, held, keep=False))


def scored_slices(learned: Learned) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Words are what stands between white space, A-Z lower-cased; every text ends with one more token.
    ``base_score`` sums log10((c + 1) / (N + V + 1)) with the exact training counts: those of frequent
    words are known to every task, those of the others are joined. Null texts are empty, repeated rows
    keep a row each, null doc_ids are not held out, other columns are ignored.
    """
    model, sliced = learned.model, learned.sliced
    shared = sliced.sparkSession.sparkContext.broadcast(model.lean())

    def score(own, answers):
        model = shared.value
        floor = np.log10(model.n + model.v + 1)
        done = []
        for own in opened(own):
            rows, n = own.rows, own.n
            levels = [own.levels(k, model, answers) for k in range(1, model.order + 1)]
            logs = np.concatenate([[0], np.cumsum(model.log_probabilities(own.seq, n, levels))])
            token = own.at != len(own.words) - 2  # all but beginnings
            h, n = own.seq[token], n + 1
            ends = np.cumsum(n)
            c = own.rare(model)[0][own.at[token]]
            exact = c > 0
            base = np.where(exact, np.log10(c + 1) - floor, 0)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (exact, base)]
            known, base = (x[ends] - x[ends - n] for x in sums)
            keys = own.number * MOST_ROWS + np.arange(len(n))
            doc = np.repeat(keys, n)[~exact]
            order = np.lexsort((h[~exact], doc))
            doc, rest = doc[order], h[~exact][order]
            new = np.ones(len(rest), bool)
            new[1:] = (rest[1:] != rest[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(rest)))
            none = len(first)
            zero = np.zeros(none)
            done.append(
                pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([keys, doc[first]])),
                        pa.concat_arrays([*rows.column(0).chunks, pa.nulls(none, pa.int64())]),
                        pa.concat_arrays([*rows.column(1).chunks, pa.nulls(none, pa.bool_())]),
                        pa.array(np.concatenate([n, zero.astype(np.int64)])),
                        pa.array(np.concatenate([known, zero]).astype(np.int64)),
                        pa.array(np.concatenate([base, zero])),
                        pa.array(np.concatenate([logs[ends] - logs[ends - n], zero])),
                        # rows of documents are spread like words, and count no word
                        pa.array(signed(np.concatenate([mix(keys.astype(np.uint64), np.full(1, END)), rest[first]]))),
                        pa.array(np.concatenate([np.zeros(len(n), np.int32), times.astype(np.int32)])),
                    ],
                    [x.split()[0] for x in SCORED.split(", ")],
                )
            )
        return pa.Table.from_batches(done)

    c = F.coalesce(F.col("c"), F.lit(0))
    rare = F.col("m") * (F.log10(c + 1) - F.log10(F.lit(float(model.n + model.v + 1))))
    scored = sliced.groupBy("slice").cogroup(learned.levels.groupBy("slice")).applyInArrow(score, SCORED)
    rows = scored.join(learned.words, "h", "left")
    return (
        rows.groupBy("key")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(c > 0, F.col("m")).otherwise(0)).alias("n_known"),
            F.lit(int(model.n)).cast("long").alias("train_tokens"),
            F.sum(F.col("base") + rare).alias("base_score"),
            F.sum("score").alias("score"),
        )
        .drop("key")
    )
