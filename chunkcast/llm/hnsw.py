"""Near-duplicate embeddings with hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class. Classes are dealt to shards by hash; each shard's graph is built in one
task and written to the shared folder. Every class then queries every shard: a descent through the sparse
layers, a beam search in the full one, and, where a whole beam is similar enough, a walk over all
neighbours that are. The beam of a shard was widened until a sample of its vectors found its links again
(the recall audit). Hits are verified in double precision.

Insertions and searches run for many vectors at once in numpy, step by step over their beams.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chunkcast.llm.bitpack import as_uri
from chunkcast.llm.components import connected_components, forest
from chunkcast.session import shared_dir, staged

BATCH = 256
EXPAND = 4
#: A float32 similarity may be off by this much; hits are verified in double precision.
ROUNDING = 1e-4


def top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of every row, the largest first."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        part = np.tile(np.arange(sims.shape[1]), (len(sims), 1))
    order = np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


class Layer:
    """One layer: unit vectors in order of insertion and up to ``degree`` neighbours of each, -1 for none."""

    def __init__(self, x: np.ndarray, degree: int):
        self.x, self.degree = x, degree
        self.near = np.full((len(x), degree), -1, np.int32)
        self.n = 0  # inserted so far

    def search(self, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best vectors found for every query from its entry points: places, similarities."""
        rows = len(q)
        seen = np.zeros((rows, self.n + 1), bool)  # the last column is for absent neighbours
        seen[:, -1] = True
        places = np.full((rows, width), -1, np.int32)
        sims = np.full((rows, width), -np.inf, np.float32)
        done = np.ones((rows, width), bool)
        alive = np.arange(rows)
        new = entry
        while len(alive):
            new = np.sort(np.where((new < 0) | (new >= self.n), self.n, new), axis=1)
            known = np.take_along_axis(seen[alive], new, 1)
            known[:, 1:] |= new[:, 1:] == new[:, :-1]
            s = np.einsum("qd,qkd->qk", q[alive], self.x[np.minimum(new, self.n - 1)], optimize=False)
            s[known] = -np.inf
            seen[alive[:, None], new] = True
            all_s = np.concatenate([sims[alive], s], axis=1)
            all_p = np.concatenate([places[alive], np.where(known, -1, new).astype(np.int32)], axis=1)
            all_d = np.concatenate([done[alive], known], axis=1)
            best = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            sims[alive], places[alive] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_p, best, 1)
            done[alive] = np.take_along_axis(all_d, best, 1)
            open_s = np.where(done[alive], -np.inf, sims[alive])
            step = np.argpartition(-open_s, min(EXPAND, width) - 1, axis=1)[:, : min(EXPAND, width)]
            can = np.take_along_axis(open_s, step, 1) > -np.inf
            on = can.any(1)
            alive, step, can = alive[on], step[on], can[on]
            if len(alive):
                at = np.where(can, places[alive[:, None], step], -1)
                done[alive[:, None], step] = True
                new = np.where((at >= 0)[:, :, None], self.near[np.maximum(at, 0)], -1).reshape(len(alive), -1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(places, order, 1), np.take_along_axis(sims, order, 1)

    def diverse(self, centre: np.ndarray, places: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Neighbours for every centre among candidates (best first): those nearer to the centre than to
        any chosen one, then the best of the others."""
        x = self.x[np.maximum(places, 0)]
        between = x @ x.transpose(0, 2, 1)
        valid = (places >= 0) & (places != centre[:, None])
        chosen = np.zeros(places.shape, bool)
        worst = np.full(places.shape, -np.inf, np.float32)  # similarity to the nearest chosen one
        for k in range(places.shape[1]):
            take = valid[:, k] & (sims[:, k] > worst[:, k]) & (chosen.sum(1) < most)
            chosen[:, k] = take
            worst = np.where(take[:, None], np.maximum(worst, between[:, k]), worst)
        rank = np.where(chosen, 2.0, np.where(valid, 0.0, -10.0)) + np.where(valid, sims, 0) / 4
        pick = top(rank.astype(np.float32), most)
        got = np.take_along_axis(np.where(valid, places, -1), pick, 1)
        out = np.full((len(places), most), -1, np.int32)
        out[:, : got.shape[1]] = got
        return out

    def insert(self, stop: int, entry: np.ndarray, width: int) -> None:
        """Insert the vectors up to ``stop``; ``entry`` has the entry points of each."""
        new = np.arange(self.n, stop)
        half = max(2, self.degree // 2)
        if self.n == 0:
            s = self.x[new] @ self.x[new].T
            np.fill_diagonal(s, -np.inf)
            order = top(s, min(width, len(new)))
            places, sims = order.astype(np.int32), np.take_along_axis(s, order, 1)
            self.n = stop
        else:
            places, sims = self.search(self.x[new], entry, width)
            self.n = stop
        links = self.diverse(new, places, sims, half)
        self.near[new, :half] = links
        row, col = np.nonzero(links >= 0)
        back, source = links[row, col], new[row].astype(np.int32)
        order = np.argsort(back, kind="stable")
        back, source = back[order], source[order]
        target, first, count = np.unique(back, return_index=True, return_counts=True)
        most = 2 * self.degree
        extra = np.full((len(target), min(most, int(count.max()))) if len(target) else (0, 1), -1, np.int32)
        for k in range(extra.shape[1]):
            on = count > k
            extra[on, k] = source[first[on] + k]
        for low in range(0, len(target), BATCH):
            t = target[low : low + BATCH]
            places = np.concatenate([self.near[t], extra[low : low + BATCH]], axis=1)
            places = np.sort(places, axis=1)
            places[:, 1:][places[:, 1:] == places[:, :-1]] = -1
            sims = np.einsum("qd,qkd->qk", self.x[t], self.x[np.maximum(places, 0)], optimize=False)
            sims[places < 0] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")
            self.near[t] = self.diverse(t, np.take_along_axis(places, order, 1), np.take_along_axis(sims, order, 1), self.degree)


class Graph:
    """The layers of one shard, the sparsest last; ``raw`` are the vectors as given."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray, degree: int = 12, width: int = 64):
        rng = np.random.default_rng(len(ids))
        level = np.floor(-np.log(1 - rng.random(len(ids))) / np.log(degree)).astype(np.int64)
        order = np.argsort(-level, kind="stable")  # so that every layer is a beginning of the one below
        self.ids, self.weights, self.raw = ids[order], weights[order], raw[order]
        self.norm = np.sqrt((self.raw.astype(np.float64) ** 2).sum(1))
        self.width = width
        x = (self.raw / self.norm[:, None]).astype(np.float32)
        level = level[order]
        self.layers: list[Layer] = []
        for k in range(int(level.max()), -1, -1):
            layer = Layer(x[: int((level >= k).sum())], degree * (2 if k == 0 else 1))
            while layer.n < len(layer.x):
                stop = min(len(layer.x), max(layer.n + 1, min(2 * layer.n, layer.n + BATCH), BATCH if layer.n == 0 else 0))
                layer.insert(stop, self._entries(x[layer.n : stop], self.layers), width)
            self.layers.append(layer)
        self.layers.reverse()

    @staticmethod
    def _entries(q: np.ndarray, above: list[Layer]) -> np.ndarray:
        """Entry points of every query, by descent through the layers given from the sparsest on."""
        entry = np.zeros((len(q), 1), np.int32)
        for layer in above:
            places, _ = layer.search(q, entry, 8)
            entry = np.concatenate([places, np.zeros((len(q), 1), np.int32)], axis=1)
        return entry

    def hits(self, q: np.ndarray, least: float, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place) of vectors found with a cosine of at least ``least``, ``q`` not scaled."""
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        unit = (q / norm[:, None]).astype(np.float32)
        rows, places = [], []
        base = self.layers[0]
        for low in range(0, len(q), BATCH):
            part = unit[low : low + BATCH]
            entry = self._entries(part, self.layers[:0:-1])
            found, sims = base.search(part, entry, min(width or self.width, base.n))
            good = sims >= least - ROUNDING
            full = good.all(1) & (found.shape[1] < base.n)
            good[full] = False
            r, c = np.nonzero(good)
            rows.append(r + low)
            places.append(found[r, c])
            for k in np.flatnonzero(full).tolist():
                more = self._walk(part[k], found[k], least)
                rows.append(np.full(len(more), low + k))
                places.append(more)
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        place = np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)
        keep = np.zeros(len(row), bool)
        for low in range(0, len(row), 1 << 17):
            r, p = row[low : low + (1 << 17)], place[low : low + (1 << 17)]
            cosine = np.einsum("kd,kd->k", q[r].astype(np.float64), self.raw[p].astype(np.float64)) / (norm[r] * self.norm[p])
            keep[low : low + (1 << 17)] = cosine >= least
        return row[keep], place[keep]

    def _walk(self, unit: np.ndarray, start: np.ndarray, least: float) -> np.ndarray:
        """All vectors that chains of similar enough neighbours lead to from ``start``."""
        base = self.layers[0]
        seen = np.zeros(base.n, bool)
        seen[start] = True
        out, edge = [start], start
        while len(edge):
            new = base.near[edge].ravel()
            new = np.unique(new[new >= 0])
            new = new[~seen[new]]
            seen[new] = True
            edge = new[base.x[new] @ unit >= least - ROUNDING]
            out.append(edge)
        return np.concatenate(out)

    def audit(self, least: float, recall: float, sample: int) -> None:
        """Widen the beam until the links of ``sample`` of the shard's vectors are found at ``recall``."""
        some = np.random.default_rng(6).permutation(len(self.ids))[:sample]
        true = 0
        for low in range(0, len(self.ids), 1 << 14):
            dots = self.raw[some].astype(np.float64) @ self.raw[low : low + (1 << 14)].astype(np.float64).T
            true += int((dots / np.outer(self.norm[some], self.norm[low : low + (1 << 14)]) >= least).sum())
        while True:
            self.recall = len(self.hits(self.raw[some], least)[0]) / max(true, 1)
            if self.recall >= recall or self.width >= len(self.ids):
                return
            self.width *= 2

    def save(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"near{k}": layer.near for k, layer in enumerate(self.layers)}
        np.savez(out, ids=self.ids, weights=self.weights, raw=self.raw, norm=self.norm, width=self.width, **arrays)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Graph:
        stored = np.load(io.BytesIO(raw))
        out = Graph.__new__(Graph)
        out.ids, out.weights, out.raw, out.norm = (stored[k] for k in ("ids", "weights", "raw", "norm"))
        out.width, out.layers = int(stored["width"]), []
        x = (out.raw / out.norm[:, None]).astype(np.float32)
        for k in range(sum(name.startswith("near") for name in stored.files)):
            near = stored[f"near{k}"]
            layer = Layer(x[: len(near)], near.shape[1])
            layer.near, layer.n = near, len(near)
            out.layers.append(layer)
        return out


def _classes(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, class`` of every row; the class is null for vectors that link with nothing."""
    v = F.col("embedding").cast("array<float>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(~bad & some, F.lit(False))
    return rows.withColumn("class", F.when(usable, F.xxhash64(F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")))))


def _matrix(batch) -> np.ndarray:
    column = batch.column("embedding")
    return column.flatten().to_numpy().reshape(len(column), -1)


def build_graphs(classes: DataFrame, shards: int, least: float, recall: float, sample: int) -> DataFrame:
    """Write the graph of every shard ``(dim, shard)``; one row per graph with its file and audit."""
    folder = as_uri(f"{shared_dir(classes.sparkSession)}/chunkcast/hnsw-{uuid.uuid4().hex}")

    def build(key, table):
        dim, shard = (k.as_py() for k in key)
        graph = Graph(table.column("class").to_numpy(), table.column("weight").to_numpy(), _matrix(table.combine_chunks().to_batches()[0]))
        graph.audit(least, recall, sample)
        system, path = pafs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        draft, name = f"{path}/_draft-{dim}-{shard}-{TaskContext.get().taskAttemptId()}", f"graph-{dim}-{shard}.npz"
        with system.open_output_stream(draft) as stream:
            stream.write(graph.save())
        system.move(draft, f"{path}/{name}")
        return pa.Table.from_pylist(
            [{"dim": dim, "shard": shard, "file": f"{folder}/{name}", "n": len(graph.ids), "width": graph.width, "recall": graph.recall}],
            pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("file", pa.string()), ("n", pa.int64()), ("width", pa.int64()), ("recall", pa.float64())]),
        )

    rows = classes.withColumns({"dim": F.size("embedding"), "shard": F.pmod("class", F.lit(shards))})
    schema = "dim int, shard long, file string, n long, width long, recall double"
    return staged(rows.groupBy("dim", "shard").applyInArrow(build, schema), "graphs")


def query_graphs(classes: DataFrame, graphs: DataFrame, least: float, rows_per_task: int = 1024) -> DataFrame:
    """Every class against every graph of its dimension: rows ``class, links`` with a null ``b``, and a
    spanning forest ``class, b`` of each task's links."""
    files: dict[int, list[str]] = {}
    for r in graphs.select("dim", "file").orderBy("dim", "shard").collect():  # one short row per shard
        files.setdefault(r.dim, []).append(r.file)

    def ask(batches):
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                own = batch.filter(pa.array(batch.column("dim").to_numpy() == dim))
                q, ids, weight = _matrix(own), own.column("class").to_numpy(), own.column("weight").to_numpy()
                links = weight - 1
                edges = [np.zeros((0, 2), np.int64)]
                for file in files.get(dim, []):
                    system, path = pafs.FileSystem.from_uri(file)
                    with system.open_input_file(path) as stream:
                        graph = Graph.load(stream.read())
                    row, place = graph.hits(q, least)
                    other = graph.ids[place] != ids[row]
                    row, place = row[other], place[other]
                    links = links + np.bincount(row, graph.weights[place], len(q)).astype(np.int64)
                    a, b = forest(ids[row], graph.ids[place])
                    edges.append(np.stack([a, b], axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.nulls(len(ids), pa.int64())], ["class", "links", "b"])
                e = np.concatenate(edges)
                a, b = forest(e[:, 0], e[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(b)], ["class", "links", "b"])

    rows = classes.withColumn("dim", F.size("embedding"))
    tasks = max(1, -(-classes.count() // rows_per_task))
    return staged(rows.repartition(tasks).mapInArrow(ask, "class long, links long, b long"), "links")


def near_duplicates(
    vectors: DataFrame, least: float = 0.9, shard_rows: int = 32_768, least_shards: int = 8, recall: float = 0.99, sample: int = 256
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id, embedding``).

    Vectors link when a search finds them with a cosine of at least ``least`` in double precision.
    Vectors that are null, empty or zero, or hold null or non-finite numbers, link with nothing, and so do
    vectors of different lengths. Equal vectors link; repeated rows keep a row each. ``component_id`` is
    the least vec_id reachable by links; null vec_ids name no component unless they are alone in it, and
    are not kept. A shard holds about ``shard_rows`` classes, and there are ``least_shards`` at least.
    The audit takes ``sample`` vectors of each shard. Other columns are ignored.
    """
    rows = staged(_classes(vectors), "vectors")
    classes = staged(
        rows.where("class is not null").groupBy("class").agg(F.min_by("embedding", "vec_id").alias("e"), F.first("embedding").alias("f"), F.count("*").alias("weight"))
        .select("class", F.coalesce("e", "f").alias("embedding"), "weight"),
        "vector-classes",
    )
    shards = max(least_shards, -(-classes.count() // shard_rows))
    graphs = build_graphs(classes, shards, least, recall, sample)
    found = query_graphs(classes, graphs, least)
    links = found.where("b is null").groupBy("class").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("b is not null").select("class", "b"))
    comp = components.select(F.col("id").alias("class"), F.col("component_id").alias("comp"))
    own = rows.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("own"))
    named = own.join(comp, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    least_id = named.groupBy("comp").agg(F.min("own").alias("component_id"))
    of_class = staged(named.join(least_id, "comp").join(links, "class", "left").select("class", "component_id", "links"), "class-links")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.join(of_class, "class", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
