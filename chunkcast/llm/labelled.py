"""Bounded training samples of labelled documents, and models fitted to them."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chunkcast.llm.textbytes import release
from chunkcast.session import staged


def remainder(column: str, modulo: int) -> Column:
    """crc32 of an id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulo))


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    extra: tuple[str, ...] = (),
    modulo: int = 3,
    held_out: int = 1,
    most_rows: int = 4_000,
    most_bytes: int = 12_000_000,
    least_rows: int = 50,
) -> DataFrame:
    """``text, label`` (0 or 1) and ``extra`` columns of a bounded sample of labelled documents.

    Rows of ``labels`` with a null id or label, or whose crc32(doc_id as text) modulo ``modulo`` is
    ``held_out``, are never used; a document with several labels takes the largest, one with several rows
    the text of the least hash. The sample is taken from the documents of ``docs`` in the order of a hash of
    doc_id: the first ``most_rows``, of which ``least_rows`` of either label as far as there are so many. A text
    of more than a sixteenth of ``most_bytes``, or that oversteps ``most_bytes`` with those before it, is passed
    over. Null texts count as empty, equal texts once for each label. A label that documents have,
    but only with texts too large, is an error; without labelled documents the table is empty.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", modulo) != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("label"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *extra)
    sizes = rows.select("doc_id", F.struct(F.xxhash64("text").alias("key"), F.octet_length("text").alias("size")).alias("one"))
    found = sizes.join(known, "doc_id").groupBy("doc_id", "label").agg(F.min("one").alias("one")).select("doc_id", "label", "one.*")
    found = staged(found, "labelled")
    order, fits = (F.xxhash64("doc_id"), "doc_id"), F.col("size") <= most_bytes // 16
    exist = {r.label: r.n for r in found.groupBy("label").agg(F.count_if(fits).alias("n")).collect()}
    if any(n == 0 for n in exist.values()):
        raise ValueError(f"every training text of a label of {label} has more than {most_bytes // 16} bytes")
    first = found.where(fits).orderBy(*order).limit(most_rows).collect()
    few = [v for v in exist if sum(r.label == v for r in first) < min(least_rows, exist[v])]
    if few:  # the other label makes room at its end
        own = found.where(fits & (F.col("label") == few[0])).orderBy(*order).limit(least_rows).collect()
        first = own + [r for r in first if r.label != few[0]][: most_rows - len(own)]
    total, chosen = 0, []
    for r in first:
        if total + r.size <= most_bytes:
            total += r.size
            chosen.append((r.doc_id, r.key, r.label))
    if not chosen:
        return docs.sparkSession.createDataFrame([], ", ".join(["text string", "label int", *(f"`{c}` string" for c in extra)]))
    kinds = [("doc_id", pa.int64()), ("key", pa.int64()), ("label", pa.int32())]
    ids = pa.table([pa.array(x, t) for x, (_, t) in zip(zip(*chosen), kinds)], pa.schema(kinds))
    ids = docs.sparkSession.createDataFrame(ids)  # of a list it would start Python workers of another kind, which stay
    picked = rows.withColumn("key", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "key"])
    picked = picked.dropDuplicates(["doc_id"]).dropDuplicates(["text", "label"])
    return picked.orderBy(*order).select("text", "label", *(F.col(c).cast("string") for c in extra))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, extra: tuple[str, ...] = (), **sample) -> pa.Table:
    """The sample of ``training_rows`` on the driver."""
    return training_rows(docs, labels, label, extra, **sample).toArrow()


def fitted(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """``fit`` of the table of ``training_rows``, in one task: the sample is bounded, and only the model comes to the driver."""
    schema = pa.schema([(c, pa.int32() if c == "label" else pa.string()) for c in rows.columns])

    def work(batches):
        table = pa.Table.from_batches([pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(b.columns, schema.types)], schema=schema) for b in batches], schema)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(table))], pa.binary())], ["model"])
        del table
        release()

    model = rows.coalesce(1).mapInArrow(work, "model binary").toArrow().column("model")
    return pickle.loads(model[0].as_buffer()) if len(model) else fit(schema.empty_table())
