"""Removal of passages that occur more than once: windows of words, counted by a count-min sketch and then exactly.

Documents are cut into slices of about 8 MB of text. Every slice makes a count-min sketch of its windows, with
counters that stop at two and without the empty ones. The sketches are merged by segment of their rows, and each
slice is told which of its counters are two or more. A window may be repeated only if all its counters are: the
sketch never underestimates, so none is lost. These windows alone are grouped exactly, by 64 and 31 further
bits of hash, and each slice is told which are repeated.

All tables between are packed by slice and segment; a window that is in every slice adds a few bytes for each
slice, however often it occurs there. The sketch has ``COUNTERS`` counters a window and row at any size, in
segments of at most 2^23.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chunkcast.session import freed_shuffles
from chunkcast.llm.textbytes import (
    NOT_SPACE, binary_buffers, binary_column, hash_spans, joined_words, longer_runs, marked, mix, slices, text_buffers, word_spans,
)
from chunkcast.session import staged as written

ROWS = 2
COUNTERS = 4
SEGMENT_BITS = 23
#: The tables are cut into this many segments at least, so that small ones are spread as well.
LEAST_SEGMENTS = 64
SLICE_BYTES = 8_000_000


def staged(df: DataFrame, name: str) -> DataFrame:
    with freed_shuffles(df.sparkSession):
        return written(df, name)


@dataclass(frozen=True)
class Plan:
    """Size of the sketch: ``segments`` of 2^``bits`` counters in each of ``ROWS`` rows."""

    width: int
    bits: int
    segments: int

    @classmethod
    def of(cls, width: int, windows: int) -> "Plan":
        counters = max(COUNTERS * windows, 1)
        bits = min(SEGMENT_BITS, max(8, (counters // LEAST_SEGMENTS).bit_length()))
        return cls(width, bits, -(-counters // (1 << bits)))

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        """The counter of each window in a row of the sketch, over all segments."""
        x = mix(h, np.full(1, np.uint64(row + 1)))
        segment = (x >> np.uint64(32)) * np.uint64(self.segments) >> np.uint64(32)
        return (segment << np.uint64(self.bits) | x & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def group(self, h: np.ndarray) -> np.ndarray:
        """The exact group of each window."""
        x = mix(h, np.full(1, np.uint64(ROWS + 1)))
        return ((x >> np.uint64(32)) * np.uint64(self.segments) >> np.uint64(32)).astype(np.int64)


def window_hashes(h: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a row, put together from halves, and their first words."""
    if len(h) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, power, at, k = None, h, 0, 1
    while True:
        if width & k:
            out = power if out is None else longer_runs(out, power[at:])
            at += k
        if 2 * k > width:
            break
        power, k = longer_runs(power, power[k:]), 2 * k
    first = np.cumsum(counts) - counts
    have = np.maximum(counts - width + 1, 0)
    starts = np.arange(have.sum()) + np.repeat(first - np.cumsum(have) + have, have)
    return out[starts], starts


@dataclass
class Slice:
    """The rows of a slice, their words and, for its windows, first word and hash."""

    rows: pa.Table
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    windows: np.ndarray
    at: np.ndarray

    @classmethod
    def open(cls, raw: pa.Scalar, width: int) -> "Slice":
        rows = pa.ipc.open_stream(raw.as_buffer()).read_all()
        data, offsets = text_buffers(rows.column("text"))
        starts, ends, counts = word_spans(data, offsets, NOT_SPACE)
        return cls(rows, data, starts, ends, counts, *window_hashes(hash_spans(data, starts, ends), counts, width))

    def second(self, width: int) -> np.ndarray:
        """31 more bits for each window, from other hashes of its words, times two."""
        h = hash_spans(self.data ^ np.uint8(0xA5), self.starts, self.ends)
        return (window_hashes(h, self.counts, width)[0] >> np.uint64(33) << np.uint64(1)).astype("<u4")

    def suspects(self, plan: Plan, answers: dict) -> np.ndarray:
        """Which windows the merged sketch counts at least twice; ``answers`` holds bits by row and segment."""
        out = np.ones(len(self.windows), bool)
        for row in range(ROWS):
            cells, place = np.unique(plan.cells(self.windows, row), return_inverse=True)
            out &= unpacked(cells >> plan.bits, {s: b for (r, s), b in answers.items() if r == row})[place]
        return out

    def candidates(self, plan: Plan, answers: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the suspected windows and, by exact group and hashes, the distinct ones:
        group, number of the distinct one of each place, and a first place for each."""
        at = np.flatnonzero(self.suspects(plan, answers))
        h, more, group = self.windows[at], self.second(plan.width)[at], plan.group(self.windows[at])
        by = np.lexsort((more, h, group))
        new = np.ones(len(by), bool)
        new[1:] = (h[by][1:] != h[by][:-1]) | (more[by][1:] != more[by][:-1])
        number = np.empty(len(by), np.int64)
        number[by] = np.cumsum(new) - 1
        return at, group[by][new], number, by[new]


def unpacked(segment: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """The bits for sorted segments, one answer (packed bits) for each segment that occurs."""
    at = np.flatnonzero(np.diff(segment, prepend=-1))
    sizes = np.diff(np.append(at, len(segment)))
    parts = [np.unpackbits(np.frombuffer(answers[s], np.uint8))[:n] for s, n in zip(segment[at].tolist(), sizes.tolist())]
    return np.concatenate([*parts, np.zeros(0, np.uint8)]).astype(bool)


def packed(bits: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Packed bits of runs of ``sizes``."""
    ends = np.cumsum(sizes)
    return pa.array([np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary())


def cut(docs: DataFrame, width: int) -> DataFrame:
    """``slice, windows, rows``: id and text of all documents, a slice at a time in Arrow's stream format."""

    def slice_up(batches):
        part, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            _, _, counts = word_spans(data, offsets, NOT_SPACE)
            for low, high in slices(offsets, SLICE_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(batch.slice(low, high - low))
                windows = int(np.maximum(counts[low:high] - width + 1, 0).sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part + number]), pa.array([windows]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                    ["slice", "windows", "rows"],
                )
                number += 1

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    return rows.mapInArrow(slice_up, "slice long, windows long, rows binary")


def three_bytes(x: np.ndarray) -> np.ndarray:
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]


def partition_sketches(sliced: DataFrame, plan: Plan) -> DataFrame:
    """``row, segment, slice, cells``: each slice's counters that are not zero, and whether they are two or more."""

    def sketch(batches):
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = Slice.open(raw, plan.width)
                for row in range(ROWS if len(own.windows) else 0):
                    cells, n = np.unique(plan.cells(own.windows, row), return_counts=True)
                    first = np.flatnonzero(np.diff(cells >> plan.bits, prepend=-1))
                    sizes = np.diff(np.append(first, len(cells)))
                    values = three_bytes((cells & (1 << plan.bits) - 1) << 1 | (n > 1))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(first), row, np.int32)),
                            pa.array(cells[first] >> plan.bits),
                            pa.array(np.full(len(first), at)),
                            binary_column(values.ravel(), 3 * sizes),
                        ],
                        ["row", "segment", "slice", "cells"],
                    )

    return sliced.select("slice", "rows").mapInArrow(sketch, "row int, segment long, slice long, cells binary")


ANSWERS = "row int, segment long, slice long, bits binary"


def merged_sketch(sketches: DataFrame, plan: Plan) -> DataFrame:
    """For each slice's counters of a segment, whether the merged counter is two or more."""

    def merge(key, table):
        raw, ends = binary_buffers(table.column("cells").combine_chunks())
        four = np.zeros((len(raw) // 3, 4), np.uint8)
        four[:, :3] = raw.reshape(-1, 3)
        values = four.view("<u4").ravel()
        cells = values >> 1
        total = np.bincount(cells, minlength=1 << plan.bits)
        total += np.bincount(cells[values & 1 > 0], minlength=1 << plan.bits)
        return table.drop_columns(["cells"]).append_column("bits", packed(total[cells] > 1, np.diff(ends) // 3))

    return sketches.groupBy("row", "segment").applyInArrow(merge, ANSWERS)


def by_place(table: pa.Table) -> dict:
    rows, segments, bits = (table.column(c).to_pylist() for c in ("row", "segment", "bits"))
    return {(r, s): b for r, s, b in zip(rows, segments, bits)}


def suspected_windows(sliced: DataFrame, answers: DataFrame, plan: Plan) -> DataFrame:
    """``segment, slice, h, more``: the distinct windows of each slice that may be repeated; the lowest bit
    of ``more`` tells that the slice has it more than once."""

    def suspect(own, found):
        out = []
        for at, raw in zip(own.column("slice").to_pylist(), own.column("rows")):
            one = Slice.open(raw, plan.width)
            places, group, number, chosen = one.candidates(plan, by_place(found))
            first = np.flatnonzero(np.diff(group, prepend=-1))
            sizes = np.diff(np.append(first, len(group)))
            more = one.second(plan.width)[places][chosen] | (np.bincount(number, minlength=len(group)) > 1).astype("<u4")
            columns = [binary_column(one.windows[places][chosen], sizes), binary_column(more.astype("<u4"), sizes)]
            out.append(pa.RecordBatch.from_arrays([pa.array(group[first]), pa.array(np.full(len(first), at)), *columns], ["segment", "slice", "h", "more"]))
        return pa.Table.from_batches(out) if out else pa.table({"segment": pa.array([], pa.int64()), "slice": pa.array([], pa.int64()), "h": pa.array([], pa.binary()), "more": pa.array([], pa.binary())})

    return sliced.select("slice", "rows").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(suspect, "segment long, slice long, h binary, more binary")


def exact_groups(suspects: DataFrame) -> DataFrame:
    """For each slice's suspected windows of a segment, whether they occur more than once; as row ``ROWS``."""

    def group(key, table):
        h = binary_buffers(table.column("h").combine_chunks())[0].view(np.uint64)
        raw, ends = binary_buffers(table.column("more").combine_chunks())
        more = raw.view("<u4")
        by = np.lexsort((more, h))
        x, y = h[by], more[by]
        same = (x[1:] == x[:-1]) & (y[1:] >> 1 == y[:-1] >> 1)
        repeated = (y & 1) > 0
        repeated[1:] |= same
        repeated[:-1] |= same
        out = np.empty(len(by), bool)
        out[by] = repeated
        table = table.drop_columns(["h", "more"]).append_column("bits", packed(out, np.diff(ends) // 4))
        return table.append_column("row", pa.array(np.full(len(table), ROWS, np.int32))).select(["row", "segment", "slice", "bits"])

    return suspects.groupBy("segment").applyInArrow(group, ANSWERS)


KEPT = "doc_id long, n_words long, removed array<struct<start bigint, length bigint>>, kept string"


def remove_repeats(docs: DataFrame, width: int = 35) -> DataFrame:
    """``doc_id, n_words, removed, kept`` of every row of ``doc_id, text``.

    Words are what stands between white space, unchanged. Every word in a window of ``width`` words that
    also starts anywhere else, in the same document too, is removed; all windows are judged on the
    input. ``removed`` has the stretches of removed words, ``kept`` the others joined by one space. Null texts
    are empty, repeated rows are documents of their own (so each repeats the other), a null id stays null,
    other columns are ignored.
    """
    sliced = staged(cut(docs, width), "slices")
    plan = Plan.of(width, sliced.agg(F.sum("windows")).first()[0] or 0)
    answers = staged(merged_sketch(partition_sketches(sliced, plan), plan), "sketch")
    exact = staged(exact_groups(suspected_windows(sliced, answers, plan)), "repeated")

    def remove(own, found):
        out, told = [], by_place(found)
        exact = {s: b for (r, s), b in told.items() if r == ROWS}
        for raw in own.column("rows"):
            one = Slice.open(raw, width)
            places, group, number, _ = one.candidates(plan, told)
            at = one.at[places[unpacked(group, exact)[number]]]
            gone = marked(len(one.starts), at, at + width)
            keep = np.concatenate([[0], np.cumsum(~gone)])
            ends = np.concatenate([[0], np.cumsum(one.counts)])
            text = joined_words(one.data, one.starts[~gone], one.ends[~gone], np.diff(keep[ends]))
            edge = np.zeros(len(gone) + 1, bool)
            edge[ends] = True  # a stretch ends with its document
            start = np.flatnonzero(gone & (np.concatenate([[True], ~gone[:-1]]) | edge[:-1]))
            end = np.flatnonzero(gone & (np.concatenate([~gone[1:], [True]]) | edge[1:])) + 1
            row = np.searchsorted(ends, start, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(start - ends[row]), pa.array(end - start)], ["start", "length"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, ends), pa.int32()), spans)
            ids = one.rows.column("doc_id").combine_chunks()
            out.append(pa.RecordBatch.from_arrays([ids, pa.array(one.counts), lists, text], ["doc_id", "n_words", "removed", "kept"]))
        return pa.Table.from_batches(out)

    told = answers.unionByName(exact)
    return sliced.select("slice", "rows").groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(remove, KEPT)
