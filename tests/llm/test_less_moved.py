"""What keeps shuffles, the driver and sorts small: joined groups, fits in a task, first bits of hashes."""

import os
import tracemalloc

import cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chunkcast.llm import decontaminate, jaccard_join, lm_score, quality, textbytes, toxicity


def test_groups_of_the_same_classes_are_joined(spark):
    """Thirty groups repeat four classes: one group is left; a chain of pairs keeps its groups."""
    rows = [(key, 1, fp, fp % 2) for key in range(30) for fp in (1, 2, 3, 4)]
    rows += [(100 + k, 1, fp, fp) for k in range(8) for fp in (50 + k, 51 + k)]
    members = spark.createDataFrame(rows, "key long, kind int, fp long, comp long")
    got = jaccard_join._regrouped(members, 2).collect()
    assert sorted((r.fp, r.comp) for r in got if r.kind == 2) == [(1, 1), (2, 0), (3, 1), (4, 0)]
    assert len({r.key for r in got if r.kind == 2}) == 1
    assert sorted((r.key, r.kind, r.fp, r.comp) for r in got if r.kind != 2) == sorted(rows[120:])


def test_sets_are_sent_once_for_repeated_groups(spark, monkeypatch):
    """Two components that share signatures of many segments without a link: their sets reach few tiles."""
    tiles, real = [], jaccard_join._tiles

    def counted(members):
        out = real(members)
        tiles.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_tiles", counted)
    base = [f"w{k}" for k in range(200)]

    def text(changed):
        return " ".join(f"{w}x{changed[j]}" if j in changed else w for j, w in enumerate(base))

    rows = [(0, text({}))]
    rows += [(k, text({j: 0 for j in range(0, 2 * (k % 8) + 16)} | {180 + k: 1})) for k in range(1, 17)]
    frame = cases.frame(spark, rows)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame, 1, 90).collect()}
    import brute

    assert sorted(got.items()) == sorted((r[0], r[2]) for r in brute.jaccard_components(rows, 1, 90))
    assert all(n <= 4 * len(rows) for n in tiles[1:])


def test_models_are_fitted_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda texts: (os.getpid(), texts.num_rows, texts.column_names))
    rows = [(k, f"text {k}") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    pid, n, columns = toxicity.train(cases.frame(spark, rows), labels, held_out=9)
    assert pid != os.getpid() and n == 40 and columns == ["text", "label"]


@pytest.mark.parametrize("known", [0, 30])
def test_models_are_those_of_the_driver(spark, known):
    rows = [(k, cases.sentence(cases.random.Random(k), 30)) for k in range(30)]
    frame = cases.frame(spark, rows).withColumn("n_chars", F.length("text"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(known)], "doc_id long, quality int")
    from chunkcast.llm.labelled import training_texts

    own = quality.fit(training_texts(frame, labels, "quality", ("n_chars",)), ("n_chars",))
    got = quality.train(frame, labels, meta=("n_chars",))
    assert np.array_equal(own.w, got.w) and np.array_equal(own.v, got.v) and own.bias == got.bias


def test_distinct_places():
    rng = np.random.default_rng(4)
    top = rng.integers(0, 2**63, 50, dtype=np.uint64) << np.uint64(1)
    for h in (
        np.zeros(0, np.uint64), np.zeros(5, np.uint64), np.full(1, np.uint64(2**64 - 1)), top[rng.integers(0, 50, 3000)],
        np.uint64(1 << 40) + rng.integers(0, 4, 999).astype(np.uint64),  # equal first bits
    ):
        words, place = lm_score.distinct_places(h)
        want, at = np.unique(h, return_inverse=True)
        assert np.array_equal(words, want) and np.array_equal(place, at)


@pytest.mark.parametrize("kind", ["<u8", "<u4", "u1"])
def test_planes_come_back(kind):
    sizes = np.array([3, 0, 1, 400, 0])
    flat = np.random.default_rng(2).integers(0, 200, 404).astype(kind)
    got, n = lm_score.from_planes(pa.chunked_array([lm_score.planes(flat, sizes)]), kind)
    assert np.array_equal(got, flat) and np.array_equal(n, sizes)


def peak_mb(work):
    """What ``work`` returns, and the most memory it held at once."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def labelled_texts(rows, words, seed=5):
    """Texts of random words, every third with some of eight words that only label 1 has."""
    rng = np.random.default_rng(seed)
    drawn = rng.integers(0, 30_000, (rows, words))
    texts = [" ".join(f"w{x}" for x in row) + (f" vile{k % 8}" * 3 if k % 3 == 0 else "") for k, row in enumerate(drawn.tolist())]
    return pa.table({"text": pa.array(texts), "label": pa.array([int(k % 3 == 0) for k in range(rows)], pa.int32())})


def test_texts_are_scored_in_small_slices(monkeypatch):
    """Memory follows the slice, not the batch; scores and finds do not depend on slices."""
    texts = labelled_texts(2_000, 600).column("text").combine_chunks()
    machine = quality.fit(labelled_texts(200, 60))
    item = decontaminate.ItemAutomaton([(1, [textbytes.hash_word("vile1")] * 3)], 3)
    scores, most = peak_mb(lambda: machine.scores(texts, []))
    found, own = peak_mb(lambda: decontaminate.find_in_batch(item, texts))
    assert texts.nbytes > 7e6 and most < 45 and own < 45
    for module in (quality, decontaminate):
        monkeypatch.setattr(module, "slices", lambda offsets, most=0: iter([(0, len(offsets) - 1)]))
    assert np.array_equal(machine.scores(texts, []), scores)
    whole = decontaminate.find_in_batch(item, texts)
    assert whole[:3] == found[:3] and np.array_equal(whole[3], found[3])


def test_the_field_is_fitted_in_parts(monkeypatch):
    """The fit holds little beside its words, and parts of chains give the model of all chains at once."""
    texts = labelled_texts(1_800, 700)
    field, most = peak_mb(lambda: toxicity.fit(texts, steps=3))
    assert most < 110
    chains = toxicity._chains_in_parts
    assert len(chains(np.full(1_800, 700))) > 3
    monkeypatch.setattr(toxicity, "_chains_in_parts", lambda counts: chains(counts, 1 << 40))
    whole = toxicity.fit(texts, steps=3)
    for a, b in ((field.weights, whole.weights), (field.transitions, whole.transitions), (field.doc, whole.doc)):
        assert np.abs(a - b).max() < 1e-9 and np.abs(a).max() > 0


def test_texts_are_tagged_in_small_slices(spark, monkeypatch):
    def strict(offsets, most=4_000_000):
        assert most <= 1_000_000
        yield 0, len(offsets) - 1

    monkeypatch.setattr(toxicity, "slices", strict)
    frame = cases.frame(spark, [(k, f"text {k}") for k in range(9)] + [(9, None)])
    assert corpus_pipeline.not_toxic(spark, frame, "/root/testdata/sf0.001").count() > 0


def test_sample_ids_start_no_python_workers(spark, monkeypatch):
    frame = cases.frame(spark, [(k, f"text {k}") for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int").localCheckpoint()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    rows = toxicity.training_rows(frame, labels, "toxic", held_out=9).collect()
    assert sorted((r.text, r.label) for r in rows) == sorted((f"text {k}", k % 2) for k in range(40))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_small_batches(spark, name, stage):
    option = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(option)
    try:
        spark.conf.set(option, "64m")
        stage(spark, cases.frame(spark, [(k, f"text {k}") for k in range(9)]), "/root/testdata/sf0.001")
        assert spark.conf.get(option) == "8m"
    finally:
        spark.conf.set(option, before)
