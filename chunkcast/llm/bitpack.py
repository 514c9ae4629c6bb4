"""Token ids as files of fixed-width bits, and their random-access reader.

File, little-endian: a 32-byte header (magic, bits per id, ids per block, vocabulary), then blocks of
``block`` ids of ``bits`` bits each, every block starting on a byte, then a footer with the byte offset
of every block and the id, null flag and length of every document, and a trailer that locates it. A
block can be unpacked alone, so any document is read with two small range reads and one for its ids.

Documents are dealt by ranges of ``doc_id`` and sorted in each task, so files in order hold documents
in ascending order. Files are written under another name and renamed, so a repeated task is harmless.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkcast.llm.textbytes import slices
from chunkcast.llm.token_ids import encoder
from chunkcast.session import shared_dir, staged

MAGIC = b"IDBITS01"
HEADER = struct.Struct("<8sIIQ8x")
TRAILER = struct.Struct("<QQQQ8s")
MANIFEST = "part int, file string, n_docs long, n_ids long"
TOKENS = "doc_id long, start long, n_tokens long, ids binary"


def bits_for(vocabulary: int) -> int:
    """The least bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, the lowest bits first; eight ids fill ``bits`` whole bytes."""
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(groups), bits), np.uint64)
    for byte in range(bits):
        for k in range(8 * byte // bits, min(7, (8 * byte + 7) // bits) + 1):
            shift = 8 * byte - k * bits
            out[:, byte] |= groups[:, k] >> np.uint64(shift) if shift >= 0 else groups[:, k] << np.uint64(-shift)
    return out.astype(np.uint8).tobytes()[: -(-len(ids) * bits // 8)]


def unpack_bits(raw: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from the ``first`` one of a packed block; bits up to 56."""
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    words = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    at = (first + np.arange(count, dtype=np.int64)) * bits
    return (words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)


class BitWriter:
    """Writes one file; ids and documents are given in order."""

    def __init__(self, stream, bits: int, vocabulary: int, block: int):
        self.stream, self.bits, self.block = stream, bits, block
        self.at, self.n, self.rest = HEADER.size, 0, np.zeros(0, np.uint32)
        self.blocks: list[int] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        stream.write(HEADER.pack(MAGIC, bits, block, vocabulary))

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids.astype("<i8"), nulls.astype(np.uint8), lengths.astype("<i8")))
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // self.block * self.block
        for low in range(0, whole, self.block):
            self._write(self.rest[low : low + self.block])
        self.rest = self.rest[whole:]

    def _write(self, ids: np.ndarray) -> None:
        raw = pack_bits(ids, self.bits)
        self.blocks.append(self.at)
        self.stream.write(raw)
        self.at += len(raw)
        self.n += len(ids)

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._write(self.rest)
        self.blocks.append(self.at)
        parts = [np.concatenate([d[k] for d in self.docs] or [np.zeros(0)]) for k in range(3)]
        kinds = ("<i8", np.uint8, "<i8")
        for x, kind in zip([np.array(self.blocks), *parts], ("<i8", *kinds)):
            self.stream.write(x.astype(kind).tobytes())
        self.stream.write(TRAILER.pack(self.at, len(self.blocks), len(parts[0]), self.n, MAGIC))
        return len(parts[0]), self.n


class BitFile:
    """One file, opened through ``open_input_file``; reads only what is asked for."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        magic, self.bits, self.block, self.vocabulary = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        footer, n_blocks, n_docs, self.n_ids, end = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{uri} is not a file of packed ids")
        raw = self.file.read_at(size - TRAILER.size - footer, footer)
        self.blocks = np.frombuffer(raw, "<i8", n_blocks)
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, 8 * n_blocks)
        self.nulls = np.frombuffer(raw, np.uint8, n_docs, 8 * (n_blocks + n_docs)).astype(bool)
        self.lengths = np.frombuffer(raw, "<i8", n_docs, 8 * (n_blocks + n_docs) + n_docs)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def ids(self, first: int, count: int) -> np.ndarray:
        """Ids ``first`` to ``first + count`` of the file, whichever blocks they lie in."""
        if count <= 0:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (first + count - 1) // self.block
        raw, out = self.file.read_at(int(self.blocks[b + 1] - self.blocks[a]), int(self.blocks[a])), []
        for k in range(a, b + 1):
            low, high = max(first, k * self.block), min(first + count, (k + 1) * self.block)
            part = raw[self.blocks[k] - self.blocks[a] : self.blocks[k + 1] - self.blocks[a]]
            out.append(unpack_bits(part, self.bits, low - k * self.block, high - low).astype("<u4"))
        return np.concatenate(out)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.lengths[k]))

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = None, block: int = 1 << 16) -> DataFrame:
    """Encode whole documents and write them in ascending doc_id order; one manifest row per file.

    Files go to a new folder under the session's shared folder. Null texts are empty, null doc_ids come
    first, repeated doc_ids are ordered by text, other columns are ignored. An empty table has no file
    with documents.
    """
    spark = docs.sparkSession
    folder = as_uri(f"{shared_dir(spark)}/chunkcast/ids-{uuid.uuid4().hex}")

    def write(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        tool = encoder(tokenizer)
        system, path = pafs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name, draft = f"{path}/part-{part:06d}.ids", f"{path}/_draft-{part:06d}-{attempt}"
        with system.open_output_stream(draft) as stream:
            out = BitWriter(stream, bits_for(tool.vocabulary), tool.vocabulary, block)
            for batch in batches:
                for low, ids, n in tool.encode(batch.column(1), end_id):
                    own = batch.column(0).slice(low, len(n))
                    nulls = own.is_null().to_numpy(zero_copy_only=False)
                    out.add(own.fill_null(0).to_numpy(), nulls, n, ids.astype(np.uint32))
            n_docs, n_ids = out.close()
        system.move(draft, name)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "file": [f"{folder}/part-{part:06d}.ids"], "n_docs": [n_docs], "n_ids": [n_ids]}
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    return staged(ordered.mapInArrow(write, MANIFEST), "ids-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the files in order: ``doc_id, start`` (ids of all documents before), ``n_tokens, ids``.

    ``ids`` are little-endian unsigned 32-bit integers. Only the files' sizes pass through the driver.
    """
    spark: SparkSession = manifest.sparkSession
    files = manifest.where("n_docs > 0").select("part", "file", "n_ids").orderBy("part").collect()
    bases = accumulate((f.n_ids for f in files), initial=0)
    tasks = spark.createDataFrame([(f.file, b) for f, b in zip(files, bases)] or [], "file string, base long")

    def read(batches):
        from chunkcast.llm.textbytes import binary_column

        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = BitFile(uri)
                for low, high in slices(file.starts, 1_000_000):
                    ids = file.ids(int(file.starts[low]), int(file.starts[high] - file.starts[low]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(file.doc_ids[low:high], mask=file.nulls[low:high]),
                            pa.array(base + file.starts[low:high]),
                            pa.array(file.lengths[low:high]),
                            binary_column(ids, file.lengths[low:high]),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                file.close()

    return tasks.repartition(max(1, len(files))).mapInArrow(read, TOKENS)


def as_uri(path: str) -> str:
    """A folder of Spark as a URI for Arrow's file systems."""
    if path.startswith("/"):
        return f"file://{path}"
    return path if "://" in path else path.replace("file:/", "file:///", 1)


def crc32_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
