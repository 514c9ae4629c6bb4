"""Exact similarity join on sets of word n-grams by partitioning the universe of n-grams.

Sets fall into size bands. A band's table has more segments than two similar sets of it can differ in
n-grams, and a hash deals the n-grams to segments; so two similar sets agree in some segment (pigeonhole).
A segment may be skipped, compared as a whole, or compared up to one deleted n-gram; as long as these
budgets (0, 1, 2) sum to one more than the greatest difference, no pair is lost. Budgets are moved away
from segments that make many candidates, by costs measured over all documents. Candidates are verified
with the exact sets.

Segments that are empty in both sets agree without saying anything. A table therefore has some more segments
than the budgets need (its slack), and a set does not index its empty segments while their budgets sum to no
more than the slack: the budgets of the others then still exceed the greatest difference, so two similar
sets of which one is such agree elsewhere. Sets with more empty segments index them all.

Equal sets are one class from the start. In a group of classes with equal segments every class is first
compared with the group's pivot only. What is not connected then is compared in tiles of bounded size that
hold the sets of two blocks of classes; classes of one component need no further comparison, so pairs
are never written out and no link between components is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chunkcast.llm.components import connected_components
from chunkcast.llm.textbytes import NOT_SPACE, binary_buffers, binary_column, mix, ngrams, release, signed, slices, text_buffers, word_hashes
from chunkcast.session import freed_shuffles, staged as written

SET_SEED, SEGMENT_SEED = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Segments whose signature falls on one residue are counted for the costs: an even sample of signatures.
COST_SAMPLE = np.uint64(63)
#: The cost of verifying a candidate, in signature rows.
VERIFY_COST = 20
#: At most one of so many segments gives its budget to another one, so that the slack still covers empty subsets.
MOVED = 16
#: Bins of a set's count profile, a byte each.
BINS = 128
#: At most about so many classes are in one block; larger groups are compared tile by tile.
TILE = 1024


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written with small Arrow batches, as rows hold whole sets; shuffle files last as long as the query."""
    conf, option = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(option)
    conf.set(option, "8m")
    try:
        with freed_shuffles(df.sparkSession):
            return written(df, name)
    finally:
        conf.set(option, before)


@dataclass(frozen=True)
class Bands:
    """Size bands of a threshold in percent: ``floor[k]`` is the least size of band k."""

    percent: int
    floor: np.ndarray
    segments: np.ndarray  # of each band's table; 1 where only equal sets can be similar
    slack: np.ndarray  # budgets of empty segments that a set of the table may leave out

    @staticmethod
    def of(percent: int, most: int = 1 << 40) -> Bands:
        floor = [1]
        while floor[-1] <= most:
            floor.append(100 * floor[-1] // percent + 1)
        low = np.array(floor, np.int64)
        need = (100 - percent) * (low[1:] - 1) // percent + 1
        slack = np.zeros(len(need), np.int64)
        for _ in range(20):  # the budgets of empty segments of nearly all sets of the least size
            m = need + slack
            fill = low[:-1] / m
            empty = (m + 2 * fill * np.maximum(m // MOVED, 1)) * np.exp(-fill)
            slack = np.where(need > 1, (empty + 2 * np.sqrt(empty)).astype(np.int64), 0)
        return Bands(percent, low[:-1], need + slack, slack)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.floor, n, "right") - 1


@dataclass
class Sets:
    """N-gram sets of a run of texts: sorted distinct hashes, sizes and class fingerprints."""

    tokens: np.ndarray
    n: np.ndarray
    weight: np.ndarray
    fp: np.ndarray


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Sets:
    """Distinct n-grams of every text; a text of fewer words has its whole sequence as one."""
    words, counts = word_hashes(data, offsets, NOT_SPACE)
    grams, have = ngrams(words, counts, width)
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.full(len(short), np.uint64(0))
        whole[:] = counts[short].astype(np.uint64)
        for k in range(width - 1):
            on = counts[short] > k
            whole[on] = mix(whole[on], words[first[short[on]] + k])
        grams = np.insert(grams, (np.cumsum(have) - have)[short], whole)
        have[short] = 1
    ends = np.cumsum(have)
    for a, b in zip((ends - have).tolist(), ends.tolist()):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[(ends - have)[have > 0]] = True
    n = np.diff(np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], ends])])
    tokens = grams[new]
    weight = mix(tokens, np.full(1, SET_SEED))
    total = np.concatenate([[np.uint64(0)], np.cumsum(weight, dtype=np.uint64)])
    at = np.concatenate([[0], np.cumsum(n)])
    return Sets(tokens, n, weight, mix(total[at[1:]] - total[at[:-1]], n.astype(np.uint64)))


class Signer:
    """Signatures of sets in the table of their band and of the band below.

    ``budgets[k]`` holds the budget of each segment of table k; without it every segment has 1.
    """

    def __init__(self, bands: Bands, budgets: dict[int, np.ndarray] | None = None):
        self.bands, self.budgets = bands, budgets or {}

    def rows(self, sets: Sets, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Signature, set, table and segment of every row of the sets ``keep``."""
        parts = []
        band = self.bands.band(np.maximum(sets.n, 1))
        for down in (0, 1):
            table = band - down
            use = keep & (sets.n > 0) & (table >= 0)
            use &= self.bands.segments[np.maximum(table, 0)] > 1
            which = np.flatnonzero(use)
            if len(which):
                parts.append(self._rows(sets, which, table[which]))
        if not parts:
            return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _rows(self, sets: Sets, which: np.ndarray, table: np.ndarray):
        m = self.bands.segments[table]
        n = sets.n[which]
        at = (np.cumsum(sets.n) - sets.n)[which]
        pick = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
        tokens, weight = sets.tokens[pick], sets.weight[pick]
        base = np.cumsum(m) - m
        owner = np.repeat(np.arange(len(which)), n)
        place = mix(tokens, np.full(1, SEGMENT_SEED)) % m[owner].astype(np.uint64)
        slot = base[owner] + place.astype(np.int64)
        sums = np.zeros(int(m.sum()), np.uint64)
        np.add.at(sums, slot, weight)
        of = np.repeat(np.arange(len(which)), m)
        segment = np.arange(len(sums)) - base[of]
        key = table[of].astype(np.uint64) << np.uint64(40) | segment.astype(np.uint64)
        budget = np.ones(len(sums), np.int8)
        for k in np.unique(table).tolist():
            if k in self.budgets:
                budget[table[of] == k] = np.tile(self.budgets[k], int((table == k).sum()))
        size = np.bincount(slot, minlength=len(sums))
        blank = (size == 0) | (size == 1) & (budget == 2)  # an empty subset is indexed
        spent = np.bincount(of, np.where(blank, budget, 0), minlength=len(which))
        left_out = (spent <= self.bands.slack[table])[of]
        on = (budget > 0) & ~(left_out & (size == 0))
        out = [(mix(sums[on], key[on]), which[of[on]], table[of[on]], segment[on])]
        near = (budget[slot] == 2) & ~(left_out & (size == 1))[slot]  # the segment's subsets without one n-gram
        if near.any():
            s = slot[near]
            out.append((mix(sums[s] - weight[near], key[s]), which[of[s]], table[of[s]], segment[s]))
        return tuple(np.concatenate(x) for x in zip(*out))


def allocate(costs: dict[tuple[int, int], int], sets: dict[int, int], bands: Bands) -> dict[int, np.ndarray]:
    """Budgets of the tables that have segments with many candidates.

    ``costs`` has the candidate pairs of (table, segment), ``sets`` the number of sets of a table. While
    it saves cost, the dearest segment gives its budget to the segment that is cheapest to compare up to
    one deletion, whose cost is a row for each n-gram.
    """
    out: dict[int, np.ndarray] = {}
    for table in sorted({t for t, _ in costs}):
        m = int(bands.segments[table])
        pairs = np.zeros(m)
        for (t, s), c in costs.items():
            if t == table:
                pairs[s] = c
        rows = sets.get(table, 0)
        deletions = rows * (1 + bands.floor[table] / m)
        budget = np.ones(m, np.int8)
        dear = np.argsort(-pairs, kind="stable")
        cheap = dear[::-1]
        for k in range(max(m // MOVED, 1)):
            gain = VERIFY_COST * pairs[dear[k]] + rows
            loss = VERIFY_COST * pairs[cheap[k]] + deletions
            if gain <= loss:
                break
            budget[dear[k]], budget[cheap[k]] = 0, 2
        if (budget != 1).any():
            out[table] = budget
    return out


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _sets_of(batch, column: int, width: int):
    data, offsets = text_buffers(batch.column(column))
    for low, high in slices(offsets):
        yield low, high, shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], width)


def _fresh(seen: set, fp: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first set of each class in this task."""
    out = np.zeros(len(fp), bool)
    for k, f in enumerate(fp.tolist()):
        if n[k] and f not in seen:
            seen.add(f)
            out[k] = True
    return out


def _profiles(sets: Sets) -> pa.Array:
    """How many n-grams of each set fall into each of ``BINS`` hash bins; null for very large sets."""
    owner = np.repeat(np.arange(len(sets.n)), sets.n)
    counts = np.bincount(owner * BINS + (sets.weight % np.uint64(BINS)).astype(np.int64), minlength=len(sets.n) * BINS)
    large = counts.reshape(-1, BINS).max(1, initial=0) > 255
    flat = np.minimum(counts, 255).astype(np.uint8)
    return pa.array([None if big else flat[BINS * k : BINS * (k + 1)].tobytes() for k, big in enumerate(large.tolist())], pa.binary())


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose profiles leave room for the similarity: the sum over bins of the smaller count
    is no less than the intersection."""
    known = classes.where("fp is not null").groupBy("fp").agg(F.max("n").alias("n"), F.max("profile").alias("p"))
    for side in ("a", "b"):
        own = known.select(F.col("fp").alias(side), F.col("n").alias(f"n{side}"), F.col("p").alias(f"p{side}"))
        pairs = pairs.join(own, side)

    def room(rows: pa.Array) -> pa.Array:
        n, m, x, y = rows.flatten()
        n, m = n.to_numpy(), m.to_numpy()
        keep = np.ones(len(rows), bool)
        both = np.flatnonzero((x.is_valid().to_numpy(zero_copy_only=False)) & (y.is_valid().to_numpy(zero_copy_only=False)))
        if len(both):
            u, v = (binary_buffers(c.take(pa.array(both)))[0].reshape(-1, BINS) for c in (x, y))
            most = np.minimum(u, v).sum(1, dtype=np.int64)
            keep[both] = 100 * most >= percent * (n[both] + m[both] - most)
        return pa.array(keep)

    alike = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return pairs.where(alike).where(F.arrow_udf(room, "boolean")(F.struct("na", "nb", "pa", "pb"))).select("a", "b")


def _classes(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, key, n, fp, profile`` of every row; ``key`` is a hash of the text, ``fp`` is null for empty sets."""

    def classes(batches):
        for batch in batches:
            for low, high, sets in _sets_of(batch, 2, width):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        batch.column(1).slice(low, high - low),
                        pa.array(sets.n),
                        pa.array(signed(sets.fp), mask=sets.n == 0),
                        _profiles(sets),
                    ],
                    ["doc_id", "key", "n", "fp", "profile"],
                )

    rows = _texts(docs).select("doc_id", F.xxhash64("text").alias("key"), "text")
    return staged(rows.mapInArrow(classes, "doc_id long, key long, n long, fp long, profile binary"), "classes")


def _signatures(docs: DataFrame, width: int, signer: Signer, sampled: bool) -> DataFrame:
    """``sig, fp, tab, seg`` of the classes of every task; only an even sample of signatures if asked."""

    def sign(batches):
        seen: set = set()
        for batch in batches:
            for _, _, sets in _sets_of(batch, 0, width):
                sig, which, table, segment = signer.rows(sets, _fresh(seen, sets.fp, sets.n))
                if sampled:
                    on = (sig & COST_SAMPLE) == 0
                    sig, which, table, segment = sig[on], which[on], table[on], segment[on]
                columns = [signed(sig), signed(sets.fp)[which]]
                if sampled:
                    columns += [table.astype(np.int32), segment.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["sig", "fp", "tab", "seg"][: len(columns)])

    schema = "sig long, fp long" + ", tab int, seg int" * sampled
    return _texts(docs).select("text").mapInArrow(sign, schema)


def _measured_budgets(docs: DataFrame, width: int, bands: Bands) -> dict[int, np.ndarray]:
    """Budgets from the candidate pairs of an even sample of signatures, over all documents.

    Only tables whose candidates cost more than their rows come to the driver, and only their dearest
    segments; the number of bands grows with the logarithm of the longest text.
    """
    rows = _signatures(docs, width, Signer(bands), True).distinct()
    groups = rows.groupBy("tab", "seg", "sig").agg(F.count("*").alias("c"))
    cost = groups.groupBy("tab", "seg").agg(
        F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"), F.sum("c").alias("sets")
    )
    scale = int(COST_SAMPLE) + 1
    dear = cost.withColumns({"pairs": F.col("pairs") * scale, "sets": F.col("sets") * scale})
    dear = dear.withColumn("sets", F.avg("sets").over(Window.partitionBy("tab")).cast("long"))
    dear = dear.where(F.col("pairs") * VERIFY_COST > 4 * F.col("sets")).collect()
    return allocate({(r.tab, r.seg): r.pairs for r in dear}, {r.tab: r.sets for r in dear}, bands)


def _stars(signatures: DataFrame) -> DataFrame:
    """``sig, pivot, fp``: the classes of every signature with another one, each beside the least.

    Rows stream in order of signature, so a group is never held.
    """

    def stars(batches):
        last_sig, pivot, last_fp = None, None, None
        for batch in batches:
            sig, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            new[0] = sig[0] != last_sig
            head = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
            pivots = np.where(head >= 0, fp[head], pivot if pivot is not None else 0)
            other = ~new
            other[1:] &= fp[1:] != fp[:-1]
            other[0] &= fp[0] != last_fp
            other &= fp != pivots
            yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (sig, pivots, fp)], ["sig", "pivot", "fp"])
            last_sig, pivot, last_fp = sig[-1], pivots[-1], fp[-1]

    return signatures.repartition("sig").sortWithinPartitions("sig", "fp").mapInArrow(stars, "sig long, pivot long, fp long")


def _fine_profiles(sets: Sets, some: np.ndarray) -> pa.Array:
    """Count profiles of the sets ``some`` with at most two n-grams a bin on average, a byte a bin;
    empty where a byte is too small. The number of bins is the greatest power of two within the size."""
    n = sets.n[some]
    bins = 1 << (np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1)
    first = np.cumsum(bins) - bins
    owner = np.repeat(np.arange(len(n)), n)
    places = first[owner] + (sets.weight[np.repeat(some, sets.n)] & (bins[owner] - 1).astype(np.uint64)).astype(np.int64)
    counts = np.bincount(places, minlength=int(bins.sum()))
    fits = np.maximum.reduceat(counts, first) <= 255 if len(n) else np.zeros(0, bool)
    return binary_column(counts[np.repeat(fits, bins)].astype(np.uint8), bins * fits)


def _room(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """At most so large an intersection, and at least so large a union, of sets of these profiles."""
    if not len(x) or not len(y):
        return 1, 1
    least = min(len(x), len(y))  # bins of a larger profile fold onto those of a smaller one
    u, v = (p.reshape(-1, least).sum(0, dtype=np.int64) for p in (x, y))
    most = int(np.minimum(u, v).sum())
    return most, int(u.sum() + v.sum()) - most


def _overlap(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return common, len(x) + len(y) - common


def _grams(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int, coarse: bool = False) -> DataFrame:
    """``fp, grams`` (sorted 64-bit hashes) of the classes ``wanted``, built again from one text of each;
    fine profiles instead of the sets if ``coarse``."""
    keys = classes.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("key").alias("key")).select("key").distinct()
    keys = staged(keys, "keys")
    small = keys.count() <= 1_000_000  # 16 MB at most; beyond it the texts are shuffled
    texts = _texts(docs).select(F.xxhash64("text").alias("key"), "text")
    texts = texts.join(F.broadcast(keys) if small else keys, "key", "left_semi").select("text")

    def sets(batches):
        seen: set = set()
        for batch in batches:
            for _, _, s in _sets_of(batch, 0, width):
                new = _fresh(seen, s.fp, s.n)
                own = _fine_profiles(s, new) if coarse else binary_column(signed(s.tokens)[np.repeat(new, s.n)], s.n[new])
                yield pa.RecordBatch.from_arrays([pa.array(signed(s.fp)[new]), own], ["fp", "grams"])

    return texts.mapInArrow(sets, "fp long, grams binary")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, coarse: bool = False) -> DataFrame:
    """``a, b, common, either`` (sizes of intersection and union) of the pairs of classes ``a, b``.

    A class ``a`` with many partners is dealt to several groups. ``coarse`` compares fine profiles, an
    eighth as large as the sets at most: then ``common`` is no smaller and ``either`` no larger than with sets.
    """
    pairs = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("m")), "a").select(
        "a", "b", F.ceil(F.col("m") / TILE).cast("int").alias("groups")
    )
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int"))
    member = pairs.select(F.col("b").alias("fp"), "a", "salt", F.lit(1).alias("role"))
    centre = pairs.select("a", "groups").distinct().select(
        F.col("a").alias("fp"), "a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(0).alias("role")
    )
    needs = staged(member.unionByName(centre), "needs")
    grams = _grams(docs, classes, needs.select("fp").distinct(), width, coarse)
    kind, sizes = (np.uint8, _room) if coarse else (np.uint64, _overlap)
    rows = needs.join(grams, "fp").repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "fp")

    def compare(batches):
        centre, held, before = None, None, None
        for batch in batches:
            data, offsets = binary_buffers(batch.column("grams"))
            flat, ends = data.view(kind), offsets // np.dtype(kind).itemsize
            out = []
            for k, (a, salt, role, fp) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "role", "fp")))):
                own = flat[ends[k] : ends[k + 1]]
                if role == 0:
                    if centre != (a, salt):
                        centre, held, before = (a, salt), own.copy(), None
                elif fp != before:  # the same class from two tasks
                    before = fp
                    out.append((a, fp, *sizes(own, held)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b", "common", "either"])
        release()

    columns = ["a", "salt", "role", "fp", "grams"]
    return staged(rows.select(columns).mapInArrow(compare, "a long, b long, common long, either long"), "verified")


def _unsettled(stars: DataFrame, components: DataFrame) -> DataFrame:
    """``key, kind, fp, comp``: groups of classes in several components that may still hold links.

    Groups are clusters of classes that signatures connect, or the signatures' own groups where those
    of a cluster have fewer pairs; either way every pair with a common signature meets in a group.
    """
    comp = components.select(F.col("id").alias("fp"), F.col("component_id").alias("comp"))
    pairs = stars.select("pivot", "fp").distinct()
    cluster = connected_components(pairs).select(F.col("id").alias("fp"), F.col("component_id").alias("cluster"))
    cluster = staged(cluster.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "clusters")
    open_ones = cluster.groupBy("cluster").agg(F.count("*").alias("g"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    open_ones = open_ones.where("g > 2 and x <> y").select("cluster", F.col("g").cast("double").alias("g"))
    of_pivot = cluster.select(F.col("fp").alias("pivot"), "cluster")
    groups = stars.groupBy("sig", "pivot").agg((F.count("*") + 1).cast("double").alias("m")).join(of_pivot, "pivot")
    cost = groups.groupBy("cluster").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
    way = staged(open_ones.join(cost, "cluster").select("cluster", (F.col("g") * F.col("g") <= F.col("pairs")).alias("whole")), "ways")
    whole = cluster.join(way.where("whole"), "cluster").select(F.col("cluster").alias("key"), F.lit(0).alias("kind"), "fp", "comp")
    some = stars.join(of_pivot, "pivot").join(way.where("not whole"), "cluster", "left_semi")
    member = some.select("sig", "fp").unionByName(some.select("sig", F.col("pivot").alias("fp")).distinct())
    own = member.join(cluster.select("fp", "comp"), "fp").select(F.col("sig").alias("key"), F.lit(1).alias("kind"), "fp", "comp")
    mixed = own.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    own = own.join(mixed.where("m > 2 and x <> y").select("key"), "key", "left_semi")
    return staged(whole.unionByName(own), "unsettled")


def _regrouped(members: DataFrame, kind: int) -> DataFrame:
    """The members of ``_unsettled`` in fewer groups, as groups that share most of their classes repeat their pairs.

    Clusters of classes that groups connect take the place of their groups where these have as many pairs.
    Such groups are of the kind ``kind``, which no group had before; every pair of a group still meets in one.
    """
    groups = members.groupBy("key", "kind").agg(F.min("fp").alias("pivot"), F.count("*").cast("double").alias("m"))
    pairs = members.join(groups, ["key", "kind"]).select("pivot", "fp").distinct()
    cluster = connected_components(pairs).select(F.col("id").alias("fp"), F.col("component_id").alias("cluster"))
    cost = groups.join(cluster.withColumnRenamed("fp", "pivot"), "pivot").groupBy("cluster").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
    sizes = cluster.groupBy("cluster").agg(F.count("*").cast("double").alias("g"))
    way = sizes.join(cost, "cluster").select("cluster", (F.col("g") * F.col("g") <= F.col("pairs")).alias("whole"))
    rows = members.join(cluster, "fp").join(way, "cluster")
    key = F.when(F.col("whole"), F.col("cluster")).otherwise(F.col("key")).alias("key")
    return staged(rows.select(key, F.when(F.col("whole"), kind).otherwise(F.col("kind")).alias("kind"), "fp", "comp").distinct(), "regrouped")


def _tiles(members: DataFrame) -> DataFrame:
    """``tile, key, kind, fp, comp, block, same``: the members of each group, dealt to tiles.

    Large components are split into blocks of their own, small ones share blocks. A tile holds two
    blocks, or one with itself; tiles inside one component are left out.
    """
    sizes = members.groupBy("key", "kind", "comp").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") <= TILE).groupBy("key", "kind").agg(F.ceil(F.sum("n") / TILE).cast("long").alias("blocks"))
    rows = members.join(sizes, ["key", "kind", "comp"]).join(small, ["key", "kind"], "left")
    large = F.col("n") > TILE
    block = F.struct(
        F.when(large, F.col("comp")).otherwise(F.lit(0)).alias("of"),
        F.when(large, F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / TILE).cast("long")))
        .otherwise(F.pmod(F.xxhash64("comp"), F.col("blocks"))).alias("part"),
        large.alias("large"),
    )
    rows = rows.select("key", "kind", "fp", "comp", block.alias("block"))
    blocks = rows.select("key", "kind", "block").distinct().groupBy("key", "kind").agg(F.collect_list("block").alias("all"))
    rows = rows.join(blocks, ["key", "kind"]).withColumn(
        "other",
        F.explode(F.filter("all", lambda o: ~(o["large"] & F.col("block")["large"] & (o["of"] == F.col("block")["of"])))),
    )
    tile = F.xxhash64("key", "kind", F.least("block", "other"), F.greatest("block", "other"))
    same = F.col("block") == F.col("other")
    return rows.select(tile.alias("tile"), "key", "kind", "fp", "comp", F.xxhash64("block").alias("block"), same.alias("same"))


def _each_tile(rows: DataFrame, work, kind, columns: list[str], schema: str) -> DataFrame:
    """``work(columns, flat, ends)`` on each tile; ``flat[ends[k]:ends[k + 1]]`` is row k of the binary ``grams``."""
    placed = rows.select("tile", "same", *columns, "grams").repartition("tile").sortWithinPartitions("tile", "comp", "fp")

    def run(batches):
        last, held = None, []
        for batch in batches:
            data, offsets = binary_buffers(batch.column("grams"))
            flat, ends = data.view(kind), offsets // np.dtype(kind).itemsize
            for k, (t, *own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "same", *columns)))):
                if t != last:
                    yield from done(held)
                    last, held = t, []
                held.append((*own, flat[ends[k] : ends[k + 1]].copy()))
        yield from done(held)
        held.clear()
        release()

    def done(held):
        if len(held) > 1:
            own = {c: np.array([h[k + 1] for h in held], np.int64) for k, c in enumerate(columns)}
            yield from work(held[0][0], own, [h[-1] for h in held])

    return placed.mapInArrow(run, schema)


def _promising(members: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The members that, as far as count profiles ``fp, grams`` tell, may link to another component of their group.

    An empty profile rules nothing out.
    """

    def find(same, own, profiles):
        comp, block = own["comp"], own["block"]
        bins = np.array([len(p) for p in profiles])
        n = np.array([int(p.sum(dtype=np.int64)) for p in profiles])
        open_ones = bins == 0
        hit = np.full(len(bins), bool(open_ones.any())) | open_ones
        for width in np.unique(bins[~open_ones]).tolist():
            some = np.flatnonzero((bins == width) | (bins == 2 * width))  # similar sets have at most twice the bins
            folded = np.stack([profiles[k].reshape(-1, width).sum(0, dtype=np.uint16) for k in some.tolist()])
            for k in np.flatnonzero(bins[some] == width).tolist():
                on = (comp[some] != comp[some[k]]) & ~(hit[some] & hit[some[k]])
                if not same:
                    on &= block[some] != block[some[k]]
                on &= 100 * np.minimum(n[some], n[some[k]]) >= percent * np.maximum(n[some], n[some[k]])
                others = np.flatnonzero(on)
                if len(others):
                    most = np.minimum(folded[others], folded[k]).sum(1, dtype=np.int64)
                    near = others[100 * most >= percent * (n[some[others]] + n[some[k]] - most)]
                    hit[some[near]] = True
                    hit[some[k]] |= len(near) > 0
        if hit.any():
            yield pa.RecordBatch.from_arrays([pa.array(own[c][hit]) for c in ("key", "kind", "fp", "comp")], ["key", "kind", "fp", "comp"])

    rows = _tiles(members).join(profiles, "fp")
    found = _each_tile(rows, find, np.uint8, ["key", "kind", "fp", "comp", "block"], "key long, kind long, fp long, comp long")
    return staged(found.distinct().withColumn("kind", F.col("kind").cast("int")), "promising")


def _tile_links(docs: DataFrame, classes: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` that connect all components of each group which have similar classes."""

    def compare(same, own, sets):
        fp, comp, block = own["fp"], own["comp"], own["block"]
        _, comp, size = np.unique(comp, return_inverse=True, return_counts=True)
        order = np.argsort(size[comp], kind="stable")  # small components look for partners in large ones
        fp, comp, block = fp[order], comp[order], block[order]
        sets = [sets[k] for k in order.tolist()]
        n = np.array([len(x) for x in sets])
        found = []
        for k in range(len(sets) - 1):
            on = comp != comp[k]
            on[: k + 1] = False
            if not same:
                on &= block != block[k]
            on &= (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
            others = np.flatnonzero(on)
            for low in range(0, len(others), 64):
                some = others[low : low + 64]
                some = some[comp[some] != comp[k]]
                if not len(some):
                    continue
                m = n[some]
                pick = np.concatenate([sets[j] for j in some.tolist()])
                at = np.minimum(np.searchsorted(sets[k], pick), n[k] - 1)
                common = np.add.reduceat((sets[k][at] == pick).astype(np.int64), np.cumsum(m) - m)
                for j in some[100 * common >= percent * (m + n[k] - common)].tolist():
                    if comp[j] != comp[k]:
                        found.append((int(fp[k]), int(fp[j])))
                        comp[comp == comp[j]] = comp[k]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    grams = _grams(docs, classes, members.select("fp").distinct(), width).dropDuplicates(["fp"])
    found = _each_tile(_tiles(members).join(grams, "fp"), compare, np.uint64, ["fp", "comp", "block"], "a long, b long")
    return staged(found, "tile-links")


def jaccard_groups(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, key, n_shingles, group, component_id`` of every row of ``docs``.

    ``key`` is xxhash64 of the text (null: empty); ``group`` names the rows that links connect, whatever
    their ids, and is null for rows without a set. The rest is as in ``jaccard_components``.
    """
    bands = Bands.of(percent)
    classes = _classes(docs, width)
    budgets = _measured_budgets(docs, width, bands)
    stars = staged(_stars(_signatures(docs, width, Signer(bands, budgets), False)), "stars")
    pairs = stars.select(F.col("pivot").alias("a"), F.col("fp").alias("b")).distinct()
    sizes = classes.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"))
    similar = F.col("common") * 100 >= F.col("either") * percent
    pairs = staged(_possible(pairs, classes, percent), "pairs")
    pairs = _verified(docs, classes, pairs, width, coarse=True).where(similar).select("a", "b")
    links = _verified(docs, classes, pairs, width).where(similar).select("a", "b")
    components = connected_components(links)
    members = _unsettled(stars, components)
    if not members.isEmpty():
        known = classes.where("fp is not null").groupBy("fp").agg(F.coalesce(F.max("profile"), F.lit(b"")).alias("grams"))
        members = _regrouped(_promising(members, known, percent), 2)
        fine = _grams(docs, classes, members.select("fp").distinct(), width, coarse=True).dropDuplicates(["fp"])
        members = _regrouped(_promising(members, fine, percent), 3)
        components = connected_components(links.unionByName(_tile_links(docs, classes, members, width, percent)))
    comp = components.select(F.col("id").alias("fp"), F.col("component_id").alias("comp"))
    named = sizes.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_class = staged(named.join(least, "comp").select("fp", F.col("comp").alias("group"), "component_id"), "class-components")
    return classes.join(of_class, "fp", "left").select(
        "doc_id",
        "key",
        F.col("n").alias("n_shingles"),
        "group",
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Words are what stands between white space, with A-Z lower-cased; a set holds the distinct runs of
    ``width`` words, or the whole sequence if it is shorter. Rows link when 100 * intersection >=
    ``percent`` * union; ``component_id`` is the least doc_id reachable by links. Null and empty texts
    have no set, link with nothing and are their own component. Repeated rows and rows with equal sets
    are one class and keep a row each; null doc_ids link but name no component unless all are null.
    Other columns are ignored, an empty table gives an empty result.
    """
    return jaccard_groups(docs, width, percent).select("doc_id", "n_shingles", "component_id")
