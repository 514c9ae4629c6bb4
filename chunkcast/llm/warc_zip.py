"""WARC archives packed as ZIP files, and a reader that range-reads records without extraction.

A package holds stored (uncompressed) members: ``archive/data.warc.gz``, whose records are gzip members
of their own, and ``indexes/index.cdxj`` with the offset and length of every record. The reader parses
the end records and the central directory, ZIP64 ones included, finds the stored members and reads only
the byte ranges of records, neighbouring ones together.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chunkcast.llm.bitpack import as_uri
from chunkcast.session import shared_dir, staged

MANIFEST = "part int, file string, n_records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
READ_TOGETHER = 4_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records --------------------------------------------------------------------------------------


def record_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of_urn(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return int(name) if name else None


def warc_record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One record; a revisit carries the HTTP header alone, which names the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes) -> bytes:
    tool = zlib.compressobj(1, zlib.DEFLATED, 31)
    return tool.compress(raw) + tool.flush()


def parse_record(raw: bytes) -> dict:
    """Fields of a record; the digest of a response's payload is computed and held against the header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    if not revisit and (base32_sha1(payload) != digest or len(payload) != size):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": page_of_urn(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": page_of_urn(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


# ---- the ZIP reader -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


class ZipReader:
    """The directory of a ZIP file behind ``read_at(size, offset)``; members are read by range."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        tail_at = max(0, size - 65_557)  # the end record with the longest comment
        tail = read_at(size - tail_at, tail_at)
        at = tail.rfind(b"PK\5\6")
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        _, _, _, count, length, offset, _ = struct.unpack("<HHHHIIH", tail[at + 4 : at + 22])
        if 0xFFFF in (count,) or 0xFFFFFFFF in (length, offset):
            locator = tail[at - 20 : at] if at >= 20 else b""
            if locator[:4] != b"PK\6\7":
                raise ValueError("the ZIP64 locator is missing")
            end = read_at(56, struct.unpack("<Q", locator[8:16])[0])
            if end[:4] != b"PK\6\6":
                raise ValueError("the ZIP64 end record is missing")
            count, length, offset = struct.unpack("<QQQ", end[32:56])
        self.members = {m.name: m for m in self._directory(read_at(length, offset), count)}

    @staticmethod
    def _directory(raw: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\1\2":
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, size, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, at + 20)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while k + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, k)
                if kind == 1:  # 64-bit values, only of the fields that are full
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                k += 4 + n
            yield Member(name, method, size, header)
            at += 46 + n_name + n_extra + n_note

    def start(self, name: str) -> int:
        """The first byte of a stored member."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed and cannot be read by range")
        head = self.read_at(30, member.header)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"the local header of {name} is damaged")
        return member.header + 30 + sum(struct.unpack("<HH", head[26:30]))

    def read(self, name: str) -> bytes:
        return self.read_at(self.members[name].size, self.start(name))


class PackageReader:
    """Records of one package."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.zip = ZipReader(self.file.read_at, self.file.size())
        lines = self.zip.read(INDEX).decode().splitlines()
        self.index = [json.loads(line.split(" ", 2)[2]) for line in lines]
        self.base = self.zip.start(ARCHIVE)

    def record(self, k: int) -> dict:
        """One record by its place in the index, with one range read."""
        at = self.index[k]
        return parse_record(zlib.decompress(self.file.read_at(at["length"], self.base + at["offset"]), 31))

    def records(self) -> Iterator[dict]:
        """All records in order of offset; neighbours share a read of about ``READ_TOGETHER`` bytes."""
        order = sorted(self.index, key=lambda x: x["offset"])
        k = 0
        while k < len(order):
            first, to = order[k]["offset"], k
            while to < len(order) and (to == k or order[to]["offset"] + order[to]["length"] - first <= READ_TOGETHER):
                to += 1
            raw = self.file.read_at(order[to - 1]["offset"] + order[to - 1]["length"] - first, self.base + first)
            for x in order[k:to]:
                yield parse_record(zlib.decompress(raw[x["offset"] - first : x["offset"] - first + x["length"]], 31))
            k = to


# ---- Spark ----------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` of every page; ``refers_to`` is null for responses.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is
    the response; smaller payloads are all responses. Rows that repeat the largest page_id are responses
    too, and so are rows without a page_id where no equal payload has one. Only digests go through the
    aggregation; the join leaves out digests that occur once.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= least_bytes
    repeated = rows.where(long).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    joined = rows.join(repeated.where("n > 1").select("digest", "owner"), "digest", "left")
    response = F.col("owner").isNull() | F.col("page_id").eqNullSafe(F.col("owner")) | ~long
    return joined.select("page_id", "url", "payload", "digest", F.when(~response, F.col("owner")).alias("refers_to"))


def write_packages(pages: DataFrame, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every page as a record of a package in a new shared folder; one manifest row per package.

    Null URLs have no target, null html is an empty payload. Each task writes its package under another
    name and renames it, so a repeated task is harmless. An empty table has packages without records.
    """
    folder = as_uri(f"{shared_dir(pages.sparkSession)}/chunkcast/warc-{uuid.uuid4().hex}")

    def write(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, path = pafs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        draft, name = f"{path}/_draft-{part:06d}-{attempt}", f"part-{part:06d}.wacz"
        index, at = [], 0
        with system.open_output_stream(draft) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
            with package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as archive:
                for batch in batches:
                    for k in range(batch.num_rows):
                        page_id, url, payload, hexed, refers_to = (c[k].as_py() for c in batch.columns)
                        digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                        revisit = refers_to is not None
                        raw = gzip_member(warc_record(page_id, url, payload, len(payload), digest, refers_to, revisit, date))
                        archive.write(raw)
                        entry = {"digest": f"sha1:{digest}", "recordId": record_urn(page_id), "offset": at, "length": len(raw)}
                        index.append(f"- {date} {json.dumps(entry)}\n")
                        at += len(raw)
            package.writestr(zipfile.ZipInfo(INDEX), "".join(index))
        system.move(draft, f"{path}/{name}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"], "n_records": [len(index)]})

    return staged(with_revisits(pages, least_bytes).mapInArrow(write, MANIFEST), "warc-manifest")


def read_packages(manifest: DataFrame) -> DataFrame:
    """All records of the packages: ``page_id, url, payload_bytes, payload_digest`` (base32 SHA-1 of the
    full payload), ``record_type, refers_to`` (a page_id) and ``payload`` (null for revisits)."""
    files = manifest.where("n_records > 0").select("file")
    tasks = files.repartition(max(1, manifest.count()))

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, size = [], 0
                for row in PackageReader(uri).records():
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= 1000 or size > READ_TOGETHER:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return tasks.mapInArrow(read, RECORDS)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORDS.split(", "))])
    return pa.RecordBatch.from_pylist(rows, schema)
