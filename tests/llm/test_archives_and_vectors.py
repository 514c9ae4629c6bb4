"""WARC packages, the ZIP reader, embedding graphs and connected components."""

import base64
import hashlib
import io
import struct
import zipfile

import brute
import cases
import numpy as np
import pytest

from chunkcast.llm import hnsw, warc_zip
from chunkcast.llm.components import connected_components

PAGES = [
    (1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (7, None, "<p>é</p>"), (3, "http://b/\r\nx", None), (4, "http://b", ""), (5, "u", "\r\n\r\n"),
    (6, "u", "z" * 300_000), (8, "u", "once"), (8, "u", "once"), (None, "u", "nobody"), (None, "u", "<p>é</p>"), (None, "u", "twice"), (None, "v", "twice"),
]


def records(pages, least=0):
    top, count = {}, {}
    for k, _, h in pages:
        top[h or ""] = max([x for x in (top.get(h or ""), k) if x is not None], default=None)
        count[h or ""] = count.get(h or "", 0) + 1
    out = []
    for k, _, h in pages:
        raw, own = (h or "").encode(), top[h or ""]
        response = count[h or ""] == 1 or len(raw) < least or own is None or k == own
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((k, len(raw), digest, "response" if response else "revisit", None if response else own))
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_packages(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    pages = pages.selectExpr("*", "1 AS digest", "2 AS owner", "3 AS n", "'x' AS payload").repartition(3)
    back = warc_zip.read_packages(warc_zip.write_packages(pages, least)).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back]
    assert cases.order(got) == cases.order(records(PAGES, least))
    assert {bytes(r.payload) for r in back if r.payload is not None} == {(h or "").encode() for _, _, h in PAGES}
    assert warc_zip.read_packages(warc_zip.write_packages(pages.limit(0))).count() == 0


def reader(raw):
    return warc_zip.ZipReader(lambda n, at: raw[at : at + n], len(raw))


def test_zip_directory_with_comment_and_many_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for k in range(70_000):  # more than the plain end record can count
            z.writestr(zipfile.ZipInfo(f"m{k}"), str(k))
        z.comment = b"PK note"
    own = reader(out.getvalue())
    assert len(own.members) == 70_000 and own.read("m69999") == b"69999"


def zip64(body, name=b"data"):
    """One stored member whose sizes and offsets stand in ZIP64 fields only."""
    pad = b"junk" * 5
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name
    local += struct.pack("<HHQQ", 1, 16, len(body), len(body))
    extra = struct.pack("<HH", 9, 2) + b"xx" + struct.pack("<HHQQQ", 1, 24, len(body), len(body), len(pad))
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x800, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
    central += name + extra
    at = len(pad) + len(local) + len(body)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, at + len(central), 1)
    return pad + local + body + central + end64 + locator + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def test_zip64_fields():
    own = reader(zip64(b"payload"))
    assert own.read("data") == b"payload" and own.read_at(3, own.start("data") + 2) == b"ylo"


@pytest.mark.parametrize("damage", [lambda r: b"no zip at all", lambda r: r.replace(b"PK\6\7", b"XX\6\7"), lambda r: r.replace(b"PK\6\6", b"XX\6\6"), lambda r: r.replace(b"PK\1\2", b"XX\1\2")])
def test_damaged_directories_are_refused(damage):
    with pytest.raises(ValueError):
        reader(damage(zip64(b"payload")))


def test_compressed_members_are_not_range_read():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", "text" * 100)
    with pytest.raises(ValueError, match="compressed"):
        reader(out.getvalue()).start("m")


def test_single_records_and_damage():
    raw = warc_zip.warc_record(5, "u", b"body", 4, warc_zip.base32_sha1(b"body"), None, False, "2020-01-01T00:00:00Z")
    assert warc_zip.parse_record(raw)["payload"] == b"body"
    with pytest.raises(ValueError, match="damaged"):
        warc_zip.parse_record(raw.replace(b"body", b"bodY"))


def clusters(n_clusters=12, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n_clusters):
        centre = rng.normal(size=16)
        for _ in range(40 if k == 0 else 5):
            rows.append((centre + 0.1 * rng.normal(size=16)).astype(np.float32))
    rows += [rng.normal(size=16).astype(np.float32) for _ in range(150)]
    return rows


def brute_links(vectors, least):
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v in vectors]
    links = []
    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if ok[i] and ok[j] and len(a) == len(b):
                x, y = np.array(a, np.float64), np.array(b, np.float64)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                    links.append((i, j))
    return links


def test_near_duplicate_vectors(spark):
    vectors = [v.tolist() for v in clusters()]
    vectors += [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0], [1.0, 2.0], [2.0, 4.1], [-0.0, 1.0], [0.0, 1.0]]
    ids = [3 * k for k in range(len(vectors) - 1)] + [0]
    rows = list(zip(ids, vectors, [1] * len(ids)))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS class", "2 AS weight", "3 AS dim").repartition(3)
    got = {}
    for r in hnsw.near_duplicates(frame, 0.9, least_shards=3).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    links = brute_links(vectors, 0.9)
    comp = brute.least_reachable(ids, links)
    count = np.bincount(np.array(links).ravel(), minlength=len(ids))
    want = {}
    for k, i in enumerate(ids):
        want.setdefault(i, []).append((count[k], comp[k], comp[k] == i))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert hnsw.near_duplicates(frame.limit(0)).count() == 0


def test_graph_recall_and_saved_form():
    raw = np.array(clusters(60, 8))
    graph = hnsw.Graph(np.arange(len(raw)), np.ones(len(raw), np.int64), raw, width=16)
    graph.audit(0.9, 0.99, 128)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    true = int((unit.astype(np.float64) @ unit.astype(np.float64).T >= 0.9).sum())
    row, place = graph.hits(raw, 0.9)
    assert len(row) >= 0.98 * true
    again = hnsw.Graph.load(graph.save())
    assert [x.tolist() for x in again.hits(raw[:20], 0.9)] == [x.tolist() for x in graph.hits(raw[:20], 0.9)]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)]
    frame = spark.createDataFrame(edges, "x long, y long").repartition(7)
    got = {r.id: r.component_id for r in connected_components(frame).collect()}
    names = sorted({x for e in edges for x in e if e[0] != e[1]})
    at = {x: k for k, x in enumerate(names)}
    want = brute.least_reachable(names, [(at[a], at[b]) for a, b in edges if a != b])
    assert got == {x: want[at[x]] for x in names}
    assert connected_components(frame.limit(0)).count() == 0
