"""Periodic runs, repeated passages and whitening against slow versions and the awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from cases import documents, empty, frame
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chunkcast.llm import periodic_runs, queries, repeated_passages, whitening
from chunkcast.llm.whitening import Spectrum, rank_one


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow_runs(w):
    """(start, length, period) of all runs, lag by lag."""
    found, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= 4 * q:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items() if e - s >= 6), key=lambda r: (r[0], r[2]))


def slow_collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def fast_runs(docs):
    names = {x: k for k, x in enumerate(sorted({x for d in docs for x in d}))}
    h = np.array([names[x] + 1 for d in docs for x in d], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    row, *rest = periodic_runs.find_runs(h, np.array([len(d) for d in docs]))
    out = [[] for _ in docs]
    for r, *one in zip(row.tolist(), *(x.tolist() for x in rest)):
        out[r].append(tuple(one))
    return out


pieces = st.one_of(
    st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=20), st.integers(1, 9)),
    st.tuples(st.lists(st.integers(0, 40), min_size=1, max_size=70), st.integers(1, 6)),
    st.tuples(st.integers(1, 40).map(lambda k: [0] * k + [1]), st.integers(1, 6)),
)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(pieces, max_size=5), min_size=1, max_size=4), st.integers(0, 30))
def test_runs_equal_a_lag_by_lag_search(rows, cut):
    docs = [[str(x) for word, n in row for x in (word * n)][cut:] for row in rows]
    assert fast_runs(docs) == [slow_runs(d) for d in docs]


def test_runs_inside_runs_of_many_scales():
    inner = (["a"] * 30 + ["b"] * 5) * 5 + ["c"]
    docs = [inner * 6, ["a"] * 700, (["a", "b"] * 40 + ["a"]) * 6, [], ["a"], ["a"] * 5, ["a"] * 6]
    docs.append(["x"] + [str(k) for k in range(333)] * 5 + ["0", "y"])
    assert fast_runs(docs) == [slow_runs(d) for d in docs]


def test_periodic_runs_of_awkward_rows(spark):
    rows = documents() + [(600, "w " * 9), (601, ("a b c " * 300).strip()), (602, " ".join(str(k % 1000) for k in range(9_000)))]
    got = frame(spark, rows).select("doc_id", "text", periodic_runs.periodic_runs(F.col("text")).alias("f")).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words_of(r.text)
        runs = slow_runs(w) if len(w) < 5_000 else [(0, 9_000, 1_000)] * (r.doc_id == 602)
        assert [tuple(x) for x in r.f.runs] == runs and r.f.n_words == len(w)
        assert r.f.collapsed == slow_collapsed(w, runs)
    assert empty(spark).select(periodic_runs.periodic_runs(F.col("text"))).count() == 0


def test_query_of_runs_equals_the_contract(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(table)
    planted = 0
    for row in table:
        w, h = words_of(row["text"]), zlib.crc32(str(row["doc_id"]).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = slow_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        r = got[row["doc_id"]]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(slow_collapsed(w, runs).encode()).hexdigest()
    assert planted > 5


def slow_removal(texts, width):
    docs = [words_of(t) for t in texts]
    seen = Counter(tuple(w[k : k + width]) for w in docs for k in range(len(w) - width + 1))
    out = []
    for w in docs:
        gone = {i for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for i in range(k, k + width)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def removal(df, width):
    rows = repeated_passages.remove_repeats(df, width).collect()
    for r in rows:
        spans = [(s.start, s.start + s.length) for s in r.removed]
        assert all(a < b < c for (a, b), (c, _) in zip(spans, spans[1:])) and all(b <= r.n_words for _, b in spans)
    return Counter((r.doc_id, r.n_words, sum(s.length for s in r.removed), r.kept) for r in rows)


@pytest.mark.parametrize("width", [1, 2, 5, 35])
@pytest.mark.parametrize("slice_bytes", [400, 8_000_000])
def test_removal_equals_a_plain_count(spark, width, slice_bytes, monkeypatch):
    monkeypatch.setattr(repeated_passages, "SLICE_BYTES", slice_bytes)
    rows = documents()
    shared = " ".join(f"p{k}" for k in range(50))
    rows += [(700 + k, f"A{k} {shared} b{k}") for k in range(30)] + [(760, f"{shared} x {shared}"), (761, "z " * 80)]
    expected = Counter((i, *x) for (i, _), x in zip(rows, slow_removal([t for _, t in rows], width)))
    assert removal(frame(spark, rows), width) == expected


def test_removal_of_an_empty_table(spark):
    assert repeated_passages.remove_repeats(empty(spark), 35).count() == 0


def test_a_full_sketch_loses_no_repeat(spark, monkeypatch):
    monkeypatch.setattr(repeated_passages.Plan, "of", classmethod(lambda cls, width, windows: cls(width, 3, 2)))
    rows = documents()
    expected = Counter((i, *x) for (i, _), x in zip(rows, slow_removal([t for _, t in rows], 5)))
    assert removal(frame(spark, rows), 5) == expected


def test_sketch_rules_most_single_windows_out(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(10**9)}" for _ in range(40_000))
    sliced = repeated_passages.staged(repeated_passages.cut(frame(spark, [(1, text)]), 35), "slices")
    plan = repeated_passages.Plan.of(35, 40_000 - 34)
    answers = repeated_passages.merged_sketch(repeated_passages.partition_sketches(sliced, plan), plan)
    left = repeated_passages.suspected_windows(sliced, answers, plan).selectExpr("sum(length(h)) / 8").first()[0]
    assert (left or 0) < 0.1 * 40_000


def vectors(seed=4, n=300, d=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 3
    x[20:120] = x[20]
    return x


def embedding_frame(spark, x, parts=4):
    rows = [(k, [float(c) for c in row]) for k, row in enumerate(x)]
    rows += [(9_001, None), (9_002, [float("nan")] * len(x[0])), (9_003, [None] + [1.0] * (len(x[0]) - 1)), (9_004, [float("inf")] * len(x[0]))]
    rows += [(9_005, []), (9_006, [1.0]), (9_007, [1e300] * len(x[0]))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts).selectExpr("*", "1 AS n", "'y' AS component", "2 AS x")


def slow_whitening(x, k=8):
    v = np.floor(1024 * x) + 100_000
    c = v - v.mean(0)
    e, q = np.linalg.eigh(c.T @ c / len(v))
    e, q = e[::-1], q[:, ::-1]
    n, s = len(v), [int(t) for t in v.sum(0)]
    deviation = [sum((n * int(t) - u) ** 2 for t, u in zip(row, s)) for row in v]
    return deviation, (c @ q)[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_rank_one_updates_keep_an_exact_spectrum():
    x = np.floor(vectors(n=400) * 1000)
    a, b = Spectrum.empty(12), Spectrum.empty(12)
    for row in x[:90]:
        a.add(row)
    for row in x[90:]:
        b.add(row)
    both = a.merge(b)
    c = (x - x.mean(0)).T @ (x - x.mean(0))
    top = np.linalg.norm(c)
    assert np.abs(both.vectors.T @ both.vectors - np.eye(12)).max() < 1e-12
    assert np.abs(both.vectors * both.values @ both.vectors.T - c).max() < 1e-12 * top
    assert both.n == 400 and np.allclose(both.mean, x.mean(0))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0, 1.0 + 1e-15, 2.0, 1e6, 1e-9]), min_size=1, max_size=9), st.integers(0, 99), st.sampled_from([1e-12, 1.0, 1e9]))
def test_deflation_of_ties_zeros_and_tiny_parts(values, seed, weight):
    rng = np.random.default_rng(seed)
    d = np.sort(np.array(values))
    q, _ = np.linalg.qr(rng.normal(size=(len(d), len(d))))
    x = q @ (rng.normal(size=len(d)) * rng.choice([0, 1e-20, 1], size=len(d)))
    new, vectors_ = rank_one(d, q, x, weight)
    whole = q * d @ q.T + weight * np.outer(x, x)
    size = max(np.abs(whole).max(), 1e-300)
    assert np.abs(vectors_ * new @ vectors_.T - whole).max() <= 1e-12 * size
    assert np.abs(vectors_.T @ vectors_ - np.eye(len(d))).max() < 1e-11


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_equals_a_dense_decomposition(spark, parts):
    x = vectors()
    got = whitening.whiten(embedding_frame(spark, x, parts)).orderBy("component", "vec_id").collect()
    deviation, white, share = slow_whitening(x)
    assert len(got) == 8 * len(x) and {r.n for r in got} == {len(x)}
    assert [r.deviation for r in got[: len(x)]] == deviation
    out = np.array([r.whitened for r in got]).reshape(8, -1).T
    sign = np.sign((out * white).sum(0))
    assert np.abs(out * sign - white).max() < 1e-9
    assert np.allclose([got[k * len(x)].explained for k in range(8)], share, rtol=1e-10)
    error = {r.identity_error for r in got}
    assert len(error) == 1 and 0 <= error.pop() < 1e-10


def test_whitening_without_enough_variance(spark):
    flat = np.ones((5, 3))
    rows = whitening.whiten(embedding_frame(spark, flat)).collect()
    assert len(rows) == 15 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in rows)
    line = flat * np.arange(5)[:, None]
    rows = whitening.whiten(embedding_frame(spark, line)).collect()
    assert {(r.component, r.whitened is None) for r in rows} == {(1, False), (2, True), (3, True)}
    assert all(r.identity_error < 1e-12 for r in rows) and {round(r.explained, 9) for r in rows} == {1.0, 0.0}
    nothing = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whitening.whiten(nothing).count() == 0


def test_deviation_beyond_a_long_is_null(spark):
    x = np.array([[1e9, 0.0], [-1e9, 0.0], [0.5, 0.0]])
    rows = whitening.whiten(embedding_frame(spark, x)).where("component = 1").orderBy("vec_id").collect()
    assert [r.deviation is None for r in rows] == [True, True, False]
    v = np.floor(1024 * x) + 100_000
    assert rows[2].deviation == sum((3 * int(a) - int(s)) ** 2 for a, s in zip(v[2], v.sum(0)))


def test_query_of_whitening_on_the_table(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/embeddings.parquet")
    x = np.array(table.column("embedding").to_pylist(), np.float64)
    rows = queries.op11_whitening(spark, sf_dir).orderBy("component", "vec_id").collect()
    deviation, white, _ = slow_whitening(x[np.argsort(table.column("vec_id").to_numpy())])
    assert [r.deviation for r in rows[: len(x)]] == deviation
    out = np.array([r.whitened for r in rows]).reshape(8, -1).T
    assert np.abs(out * np.sign((out * white).sum(0)) - white).max() < 1e-8
