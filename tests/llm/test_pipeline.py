"""The stages keep the columns of documents, act on what is left, and survive awkward tables."""

import random

import brute
import cases
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_order_of_the_stages(stages):
    assert [n for n, _, _ in stages] == ["quality", "toxicity", "near_duplicates", "benchmark_text", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
        assert 0 < after.count() < before.count()
        assert after.exceptAll(before).isEmpty()


def test_rejected_documents_are_the_labelled_ones(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, column, bad in ((0, "quality", 0), (1, "toxic", 1)):
        _, before, after = stages[k]
        known = before.join(labels, "doc_id").select("doc_id", column)
        gone = known.join(after, "doc_id", "left_anti")
        right = gone.where(F.col(column) == bad).count() + known.join(after, "doc_id", "left_semi").where(F.col(column) != bad).count()
        assert right > 0.95 * known.count()


def test_one_of_each_group_of_near_copies_stays(stages):
    _, before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {d for d, _, c in brute.jaccard_components(rows, 5, 80) if d == c}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)


def test_contaminated_documents_go(spark, stages):
    _, before, after = stages[3]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    marked = brute.contamination([(r.doc_id, r.text) for r in before.collect()], items)
    assert {r.doc_id for r in after.collect()} == {m[0] for m in marked if not m[-1]}


def test_every_kept_document_is_packed_whole(stages):
    _, before, after = stages[4]
    whole = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in whole} == {r.doc_id for r in before.collect()} and all(r.n == r.m for r in whole)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_awkward_tables(spark, name, stage):
    rows = cases.documents()
    docs = cases.frame(spark, rows)
    out = stage(spark, docs, SF)
    assert out.count() > 0
    if name != "packing":
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_duplicates_choose_rows_not_ids(spark):
    rng = random.Random(8)
    a, b, c, d = (cases.sentence(rng, 40) for _ in range(4))
    rows = [(1, a), (1, b), (2, c), (3, b + " x"), (None, c), (None, d), (None, d), (4, None), (4, ""), (5, c), (6, "y " + a), (6, "y " + a)]
    out = corpus_pipeline.near_duplicates(spark, cases.frame(spark, rows), SF)
    assert out.columns == cases.frame(spark, rows).columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (1, b), (2, c), (None, d), (4, None), (4, "")], key=str)


def test_run_is_registered(spark):
    assert entry_module.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
