"""The contract's queries over the given tables, each through its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkcast.llm import bitpack, decontaminate, hnsw, jaccard_join, lm_score, packing, periodic_runs, quality, repeated_passages, toxicity, url_filter, warc_zip, whitening
from chunkcast.llm.labelled import remainder


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: The contract's rules.
URL_RULES = [
    url_filter.Rule("allow", "org/"),
    url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"),
    url_filter.Rule("block", "com/de/"),
]


def op1_url_filter(spark: SparkSession, d: str) -> DataFrame:
    """The labelled URLs are those that a rule judges."""
    pages = table(spark, d, "pages").select("page_id", "url")
    host, path = url_filter.host_and_path(F.col("url"))
    _, verdict = url_filter.rule_of(host, path, URL_RULES)
    labelled = pages.select("url", (verdict == "block").alias("blocked"))
    judged = url_filter.judge_urls(pages, URL_RULES, url_filter.train(labelled, most_rows=20_000))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op2_lm_score(spark: SparkSession, d: str) -> DataFrame:
    return lm_score.learn_and_score(table(spark, d, "documents"))


def op3_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, d, "documents"), width=3, percent=90)


def op4_bitpack(spark: SparkSession, d: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = bitpack.write_token_files(table(spark, d, "documents"), path, end_id=2)
    return bitpack.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_warc(spark: SparkSession, d: str) -> DataFrame:
    manifest = warc_zip.write_packages(table(spark, d, "pages"), least_bytes=0)
    return warc_zip.read_packages(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, d, "embeddings"), least=0.9)


def op7_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, d, "documents"), table(spark, d, "benchmark"), window=13)
    one = F.col("found")
    names = F.array_join(F.array_sort(F.transform(one["items"], lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        one["n_words"].alias("n_words"),
        decontaminate.hit_words(one).alias("n_hit"),
        F.size(one["items"]).cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated(one, 5).alias("contaminated"),
    )


def op8_packing(spark: SparkSession, d: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack_documents(table(spark, d, "documents"), path, end_id=0, length=1024)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def held_out(modulo: int, value: int):
    return F.coalesce(remainder("doc_id", modulo) == value, F.lit(False))


def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    field = toxicity.train(docs, table(spark, d, "labels"), "toxic")
    found = docs.select("doc_id", toxicity.toxicity(docs, field).alias("found"))
    score = F.col("found")["score"]
    return found.select(
        "doc_id",
        held_out(3, 1).alias("held_out"),
        score.alias("score"),
        (score >= 0.7).cast("int").alias("predicted"),
        F.col("found")["spans"].alias("spans"),
    )


def op10_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    machine = quality.train(docs, table(spark, d, "labels"), "quality", meta=("n_chars",))
    scored = docs.select("doc_id", quality.quality_score(docs, machine, ("n_chars",)).alias("score"))
    return scored.select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op11_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings"), components=8)


def planted_runs(text, doc_id):
    """The contract's texts: of every tenth crc32(doc_id), the words from a on become a run of period p."""
    w = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    h = F.crc32(doc_id.cast("string"))
    n, g = F.size(w).cast("long"), F.floor(h / 10).cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    period = F.slice(w, (a + 1).cast("int"), p.cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    run = F.slice(F.flatten(F.array_repeat(period, times)), 1, (n - a).cast("int"))
    turned = F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), run), " ")
    return F.when((h % 10 == 0) & (n > 0), turned).otherwise(text)


def op12_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    """``best`` is the run of the greatest exact length / period, of several the first with the smallest period."""
    docs = table(spark, d, "documents").select("doc_id", planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    found = docs.select("doc_id", periodic_runs.periodic_runs(F.col("text")).alias("found"))
    found = found.select("doc_id", "found.runs", "found.collapsed")
    nothing = F.lit(None).cast("struct<start bigint, length bigint, period bigint>")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", nothing, lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    kept = repeated_passages.remove_repeats(table(spark, d, "documents"), width=35)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["length"])
    return kept.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_url_filter, op2_lm_score, op3_jaccard_join, op4_bitpack, op5_warc, op6_embedding_dedup, op7_decontamination, op8_packing, op9_toxicity, op10_quality, op11_whitening, op12_periodic_runs, op13_substring_dedup)
}
