"""Benchmark text in documents, found with a generalised suffix automaton of the benchmark items.

The automaton holds every run of words of every item. Document words stream through it: each step keeps
the longest run that ends at this word and lies in some item. Where that run reaches the window length
(or a whole shorter item), its words are hit. Only stretches of documents whose neighbouring words also
neighbour in an item are streamed; numpy finds those stretches for a whole batch of documents.

The items go into automata of a bounded number of words; where more than one is needed, the documents
stream through one after another and the finds are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chunkcast.llm.textbytes import ALNUM, hash_spans, LOWER, mix, slices, text_buffers, word_hashes, word_spans
from chunkcast.session import staged

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("bytes", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
)


class ItemAutomaton:
    """All runs of words of the items, with the items that hold each window.

    ``window`` words make a window; an item of fewer words, but not none, is one window. Items are
    ``(item id, word hashes)``.
    """

    def __init__(self, items: list[tuple[int | None, list[int]]], window: int = 13):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int | None]] = []
        short: list[tuple[int | None, list[int]]] = []
        for item, words in items:
            v, path = 0, []
            for w in words:
                v = self._extend(v, w)
                path.append(v)
            if len(words) >= window:
                ends += [(u, item) for u in path[window - 1 :]]
            elif words:
                short.append((item, words))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.deep = [0] * len(self.link)  # the state of the last ``window`` words of a longer run
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                self.deep[v] = self.deep[up] if self.length[up] >= window else v
        owners: dict[int, set] = {}
        for v, item in ends:
            if item is not None:
                owners.setdefault(self.deep[v], set()).add(item)
        self.owners = {v: frozenset(x) for v, x in owners.items()}
        own: dict[int, list[tuple[int, int | None]]] = {}
        for item, words in short:
            v = 0
            for w in words:
                v = self.next[v][w]
            own.setdefault(v, []).append((len(words), item))
        self.shorts: list[tuple] = [()] * len(self.link)  # whole short items that end with a state, by state
        for v in order:
            self.shorts[v] = self.shorts[self.link[v]] + tuple(own.get(v, ()))
        lists = [words for _, words in items if words]
        self.least = min((min(len(w), window) for w in lists), default=0)
        self.words = np.unique(np.array([w for words in lists for w in words], np.uint64))
        pairs = [mix(np.array(w[:-1], np.uint64) + np.uint64(1), np.array(w[1:], np.uint64)) for w in lists if len(w) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.tables = {name: self._table(x) for name, x in (("words", self.words), ("pairs", self.pairs))}

    @staticmethod
    def _table(keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
        """One bit of every key's upper bits, about 64 times as many as keys."""
        bits = min(26, max(10, int(len(keys)).bit_length() + 6))
        table = np.zeros(1 << bits, bool)
        shift = np.uint64(64 - bits)
        table[keys >> shift] = True
        return table, shift

    def _has(self, name: str, h: np.ndarray) -> np.ndarray:
        (table, shift), keys = self.tables[name], getattr(self, name)
        out = table[h >> shift]
        maybe = np.flatnonzero(out)
        if len(maybe) and len(keys):
            at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            out[maybe] = keys[at] == h[maybe]
        return out

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, q, w)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return cur

    def _split(self, p: int, q: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = twin
            p = link[p]
        return twin

    def stretches(self, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one word of every stretch that may hold a window."""
        if not len(h) or not self.least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(counts)
        if self.least == 1:
            inside = self._has("words", h)
            first = np.flatnonzero(inside)
            cut = np.zeros(len(h) + 1, bool)
            cut[ends] = True
            new = np.ones(len(first), bool)
            new[1:] = (first[1:] != first[:-1] + 1) | cut[first[1:]]
            low = first[new]
            return low, np.append(first[np.flatnonzero(new)[1:] - 1], first[-1:]) + 1
        joined = self._has("pairs", mix(h[:-1] + np.uint64(1), h[1:]))
        joined[ends[(ends > 0) & (ends < len(h))] - 1] = False
        edge = np.diff(np.concatenate([[0], joined.view(np.int8), [0]]))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        keep = high - low >= self.least
        return low[keep], high[keep]

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Hit ranges of a stretch, merged, and the items whose windows occur in it."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        spans: list[tuple[int, int]] = []
        items: set = set()
        v = run = 0
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                run = length[v]
            if w not in nxt[v]:
                continue
            v = nxt[v][w]
            run += 1
            reach = 0
            if run >= window:
                owners = self.owners.get(self.deep[v])
                reach = window
                if owners:
                    items |= owners
            for size, item in self.shorts[v]:
                if size <= run:
                    reach = max(reach, size)
                    if item is not None:
                        items.add(item)
            if reach:
                low = i + 1 - reach
                while spans and spans[-1][1] >= low:
                    low = min(low, spans.pop()[0])
                spans.append((low, i + 1))
        return spans, items


#: Words of items that one automaton takes; every Python worker holds one, at about 1,050 bytes a word.
PART_WORDS = 500_000


def item_parts(items: DataFrame, window: int, max_words: int) -> Iterator[list[tuple[int | None, list[int]]]]:
    """The items ``(item id, word hashes)`` in lists of at most ``max_words`` words, read row by row.

    A longer item goes in pieces that share ``window - 1`` words, so that every window lies in one of them. Null texts
    have no words.
    """
    if max_words < window:
        raise ValueError("a part must hold a window")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    part, held = [], 0
    for row in rows.toLocalIterator():
        words = word_hashes(*text_buffers(pa.array([row.text], pa.string())), ALNUM)[0].tolist()
        at = 0
        while at < len(words):
            piece = words[at : at + max_words]
            if held and held + len(piece) > max_words:
                yield part
                part, held = [], 0
            part.append((row.item_id, piece))
            held += len(piece)
            at = len(words) if at + len(piece) == len(words) else at + len(piece) - window + 1
    yield part


def automata(items: DataFrame, window: int = 13, max_words: int = PART_WORDS) -> Iterator[ItemAutomaton]:
    """Automata of an item table ``item_id, text``, each of at most ``max_words`` words; one at least.

    Words of items with a null id are hit but named by no item; repeated ids are one item.
    """
    return (ItemAutomaton(part, window) for part in item_parts(items, window, max_words))


def united(one: pa.Array, other: pa.Array) -> pa.Array:
    """What two automata found in the same texts: hit ranges merged, items of both."""

    def merged(a: list, b: list) -> list:
        out: list = []
        for r in sorted(a + b, key=lambda r: (r["start"], r["end"])):
            if out and r["start"] <= out[-1]["end"]:
                out[-1]["end"] = max(out[-1]["end"], r["end"])
            else:
                out.append(dict(r))
        return out

    rows = []
    for x, y in zip(one.to_pylist(), other.to_pylist()):
        spans = merged(x["spans"], y["spans"])
        # a merged range of words starts and ends with words of the two
        first = {s["start"]: b["start"] for z in (x, y) for s, b in zip(z["spans"], z["bytes"])}
        last = {s["end"]: b["end"] for z in (x, y) for s, b in zip(z["spans"], z["bytes"])}
        places = [{"start": first[s["start"]], "end": last[s["end"]]} for s in spans]
        rows.append({"n_words": x["n_words"], "spans": spans, "bytes": places, "items": sorted({*x["items"], *y["items"]})})
    return pa.array(rows, pa.struct(_ARROW))


def with_contamination(docs: DataFrame, items: DataFrame, name: str, window: int = 13, max_words: int = PART_WORDS) -> DataFrame:
    """All columns of the documents and ``name``, the struct of ``contamination``.

    Items of more than ``max_words`` words go in parts, one after another: the documents are written with what the parts
    so far have found, read again for the next part, and its finds are united with those before. No worker holds
    more than one part.
    """
    spark, parts = docs.sparkSession, automata(items, window, max_words)
    auto = spark.sparkContext.broadcast(next(parts))
    found = docs.withColumn(name, contamination(auto))
    unite = F.arrow_udf(united, FOUND)
    for part in parts:
        found = staged(found, "contamination")
        auto.unpersist()
        auto = spark.sparkContext.broadcast(part)
        found = found.withColumn(name, unite(F.col(name), contamination(auto)))
    return found


def find_in_batch(auto: ItemAutomaton, column: pa.Array) -> tuple[list, list, list, np.ndarray]:
    """Hit word ranges, their byte ranges and items of every text of a batch, and its number of words."""
    data, offsets = text_buffers(column)
    spans: list = [[] for _ in range(len(column))]
    ranges: list = [[] for _ in range(len(column))]
    items: list = [set() for _ in range(len(column))]
    words = np.zeros(len(column), np.int64)
    for a, b in slices(offsets, 1_000_000):
        own = data[offsets[a] : offsets[b]]
        starts, ends, counts = word_spans(own, offsets[a : b + 1] - offsets[a], ALNUM)
        words[a:b] = counts
        h = hash_spans(LOWER[own], starts, ends)
        first = np.cumsum(counts) - counts
        low, high = auto.stretches(h, counts)
        rows = np.searchsorted(np.cumsum(counts), low, "right")
        for i, j, r in zip(low.tolist(), high.tolist(), rows.tolist()):
            hits, found = auto.stream(h[i:j].tolist())
            at, byte = i - int(first[r]), int(offsets[a + r] - offsets[a])
            for x, y in hits:
                begin, end = int(starts[i + x]) - byte, int(ends[i + y - 1]) - byte
                if spans[a + r] and spans[a + r][-1][1] == at + x:  # of a stretch that ends here
                    spans[a + r][-1] = (spans[a + r][-1][0], at + y)
                    ranges[a + r][-1] = (ranges[a + r][-1][0], end)
                else:
                    spans[a + r].append((at + x, at + y))
                    ranges[a + r].append((begin, end))
            items[a + r] |= found
    return spans, ranges, [sorted(x) for x in items], words


def contamination(auto, text: str | Column = "text") -> Column:
    """What the items leave in a text: a struct of ``n_words``, ``spans`` (hit word ranges, end excluded),
    ``bytes`` (the same ranges in UTF-8 bytes) and ``items`` (ids, ascending).

    ``auto`` is a broadcast ``ItemAutomaton``. A null or empty text has no words.
    """

    def found(column: pa.Array) -> pa.Array:
        spans, ranges, items, words = find_in_batch(auto.value, column)
        kinds = [f.type for f in pa.schema(_ARROW)]
        pair = lambda rows: [[{"start": x, "end": y} for x, y in r] for r in rows]
        return pa.StructArray.from_arrays(
            [pa.array(words), pa.array(pair(spans), kinds[1]), pa.array(pair(ranges), kinds[2]), pa.array(items, kinds[3])],
            ["n_words", "spans", "bytes", "items"],
        )

    source = F.col(text) if isinstance(text, str) else text
    return F.arrow_udf(found, FOUND)(source.cast("string"))


_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ARROW = [("n_words", pa.int64()), ("spans", _RANGES), ("bytes", _RANGES), ("items", pa.list_(pa.int64()))]


def hit_words(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(found: Column, percent: float = 5) -> Column:
    """Some words are hit, and they are at least ``percent`` of all words."""
    hit = hit_words(found)
    return (hit > 0) & (100 * hit >= percent * found["n_words"])


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 13, max_words: int = PART_WORDS) -> DataFrame:
    """``doc_id, text`` and ``found``, the struct of ``contamination``, for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_contamination(rows, items, "found", window, max_words)


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 13, percent: float = 5, cut_words: int | None = None, max_words: int = PART_WORDS
) -> DataFrame:
    """All columns of the documents without those whose hit words reach ``percent`` of their words.

    With ``cut_words``, hit ranges of at least so many words are also cut out of the texts that stay.
    """
    name = free_name(docs, "_found")
    found = with_contamination(docs, items, name, window, max_words)
    kept = found.where(~is_contaminated(F.col(name), percent))
    if cut_words is not None:
        long = F.exists(F.col(name)["spans"], lambda s: s["end"] - s["start"] >= cut_words)
        cut = cut_ranges(cut_words)(F.col("text"), F.col(name))
        kept = kept.withColumn("text", F.when(long, cut).otherwise(F.col("text")))
    return kept.drop(name)


def cut_ranges(cut_words: int):
    """A function of ``(text, found)``: the text without hit ranges of at least ``cut_words`` words."""

    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, one in zip(texts.to_pylist(), found.to_pylist()):
            if text is not None and one:
                raw, at, parts = text.encode(), 0, []
                for span, place in zip(one["spans"], one["bytes"]):
                    if span["end"] - span["start"] >= cut_words:
                        parts.append(raw[at : place["start"]])
                        at = place["end"]
                text = (b"".join(parts) + raw[at:]).decode()
            out.append(text)
        return pa.array(out, pa.string())

    return F.arrow_udf(cut, T.StringType())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
