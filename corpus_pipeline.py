"""The corpus pipeline: filters, near duplicates, benchmark text and packing, stage by stage.

Every stage takes ``(spark, docs, sf_dir)``, works on all documents that the stage before it kept, and
is written as Parquet before the next one reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkcast.llm import decontaminate, jaccard_join, packing, quality, toxicity
from chunkcast.llm.decontaminate import free_name
from chunkcast.session import staged


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most from now on, as a batch of whole texts takes several times its bytes in an executor.

    Set for the session, as Spark reads the limit when a stage's result is written, not when it is built.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, trained on the labelled ones, scores at 0.5 or more."""
    small_batches(spark)
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", meta=("n_chars",))
    score = free_name(docs, "_score")
    return docs.withColumn(score, quality.quality_score(docs, machine, ("n_chars",))).where(F.col(score) >= 0.5).drop(score)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7."""
    small_batches(spark)
    field = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic")
    found = free_name(docs, "_found")
    return docs.withColumn(found, toxicity.toxicity(docs, field, slice_bytes=1_000_000)).where(F.col(found)["score"] < 0.7).drop(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least doc_id, of equal ones the least text hash.

    Groups are connected by a Jaccard similarity of at least 0.8 on runs of five words. Rows without an id
    are the last choice of their group; of repeated rows one stays. Rows without words have no group and
    all stay.
    """
    small_batches(spark)
    groups = jaccard_join.jaccard_groups(docs, width=5, percent=80).where("group is not null")
    rows = groups.groupBy("group", "doc_id", "key").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("doc_id", "key", "n"), F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    kept = staged(rows.groupBy("group").agg(best.alias("row")).select("row.*"), "kept")
    small = kept.count() <= 2_000_000  # 48 MB at most; beyond it the documents are shuffled

    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    key, own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), free_name(docs, "_key")

    def chosen(some: DataFrame) -> DataFrame:
        some = some.select(F.col("doc_id").alias("_kept_id"), F.col("key").alias("_kept_key"))
        same = F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")) & (F.col(own) == F.col("_kept_key"))
        return docs.withColumn(own, key).join(F.broadcast(some) if small else some, same, "left_semi")

    once, repeated = chosen(kept.where("n = 1")), chosen(kept.where("n > 1")).dropDuplicates(["doc_id", own])
    return once.unionByName(repeated).drop(own).unionByName(docs.where(~words))


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows of 13 words."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items, window=13, percent=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 ids, with the checksum of each piece's ids."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack_documents(docs, path, end_id=0, length=1024)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", near_duplicates),
    ("benchmark_text", benchmark_text),
    ("packing", pack),
]

#: The stages learn models, and run on token ids that SQL has no tokenizer for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
