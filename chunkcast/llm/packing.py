"""Concatenate and cut: documents into sequences of a fixed length with prefix sums.

Pass 1 encodes every document and writes its ids with the position inside its partition. The totals of
the partitions, one number each, give the partitions' global offsets. Pass 2 cuts every document at the
global multiples of the sequence length. Nothing is shuffled, and all sequences but the last are full.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chunkcast.llm.textbytes import binary_buffers, binary_column, slices
from chunkcast.llm.token_ids import encoder
from chunkcast.session import staged

ENCODED = "part int, doc_id long, start long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """Whole documents as ids, written once: ``part, doc_id, start`` (inside the part), ``n_tokens, ids``.

    ``tokenizer`` is the path of a tokenizer file that every worker has. ``end_id`` is appended to every
    document. Null and empty texts hold the end id alone, null doc_ids stay null, repeated rows are
    documents of their own, other columns are ignored. ``ids`` are little-endian, two bytes each for
    vocabularies of up to 65,536 ids and four above.
    """

    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low, ids, n in encoder(tokenizer).encode(batch.column(1), end_id):
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), part, np.int32)),
                        batch.column(0).slice(low, len(n)),
                        pa.array(starts),
                        pa.array(n),
                        binary_column(ids, n),
                    ],
                    ["part", "doc_id", "start", "n_tokens", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    conf, option = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(option)
    conf.set(option, "8m")  # whole texts go in and their ids come out
    try:
        return staged(rows.mapInArrow(encode, ENCODED), "encoded")
    finally:
        conf.set(option, before)


def pack(encoded: DataFrame, length: int = 1024, width: int = 2) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids: the boundary records of the packing.

    Per piece: ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids`` (little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` in the sequence. ``encoded`` is what
    ``encode_documents`` wrote, ``width`` the bytes of one of its ids. A document without ids has no
    piece; an empty table has none.
    """
    totals = dict(encoded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one number a partition
    order = sorted(totals)
    base = dict(zip(order, accumulate((totals[p] for p in order), initial=0)))

    def cut(batches):
        for batch in batches:
            data, offsets = binary_buffers(batch.column("ids"))
            for low, high in slices(offsets):
                some = batch.slice(low, high - low)
                n = some.column("n_tokens").to_numpy()
                parts = some.column("part").to_numpy()
                begin = some.column("start").to_numpy() + np.array([base[p] for p in parts.tolist()], np.int64)
                first, last = begin // length, (begin + n - 1) // length
                times = np.where(n > 0, last - first + 1, 0)
                row = np.repeat(np.arange(len(n)), times)
                sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                start = np.maximum(sequence * length - begin[row], 0)
                stop = np.minimum((sequence + 1) * length - begin[row], n[row])
                ids = data[offsets[low] : offsets[high]].view(f"<u{width}").astype("<u4")  # pieces follow each other
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id").take(pa.array(row)),
                        pa.array(start),
                        pa.array(stop - start),
                        binary_column(ids, stop - start),
                        pa.array(n[row]),
                        pa.array(sequence),
                        pa.array(begin[row] + start - sequence * length),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return encoded.mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024) -> DataFrame:
    """Encode, append the end id and pack; columns as in ``pack``."""
    return pack(encode_documents(docs, tokenizer, end_id), length, encoder(tokenizer).width)
