"""URL verdicts: host and path rules first, then logistic regression on hashed character n-grams.

Host and path are parsed and matched with expressions of the engine. The model sees byte n-grams of the
host and of the path, hashed apart, and is trained from a small table of labelled URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chunkcast.llm.textbytes import hash_spans, mix, slices, text_buffers

BUCKETS = 1 << 18
LENGTHS = (2, 3, 4, 5)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and a beginning of the path, written ``host/path``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, the first listed of equal ones; null without one."""
    text = verdict = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        text = F.when(fits, rule.text) if text is None else text.when(fits, rule.text)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def gram_rows(column: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of every string, with a mark at both ends, and their number."""
    data, offsets = text_buffers(column)
    size = np.diff(offsets)
    marked = np.zeros(len(data) + 2 * len(size), np.uint8)
    at = np.arange(len(data)) + 2 * np.repeat(np.arange(len(size)), size) + 1
    marked[at] = data
    bounds = offsets + 2 * np.arange(len(offsets))
    out, row = [], []
    for n in LENGTHS:
        have = np.maximum(size + 3 - n, 0)
        start = np.repeat(bounds[:-1] - (np.cumsum(have) - have), have) + np.arange(have.sum())
        h = mix(hash_spans(marked, start, start + n), np.full(1, np.uint64(64 * seed + n)))
        out.append((h % np.uint64(BUCKETS)).astype(np.int64))
        row.append(np.repeat(np.arange(len(size)), have))
    rows = np.concatenate(row)
    order = np.argsort(rows, kind="stable")
    return np.concatenate(out)[order], np.bincount(rows, minlength=len(size))


@dataclass
class UrlModel:
    """Logistic regression weights; a URL's grams have equal values whose squares sum to one."""

    weights: np.ndarray
    bias: float

    @staticmethod
    def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        a, n = gram_rows(host, 1)
        b, m = gram_rows(path, 2)
        row = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
        return np.concatenate([a, b])[np.argsort(row, kind="stable")], n + m

    def block(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """Probability that a URL is to be blocked."""
        index, n = self.features(host, path)
        total = np.concatenate([[0], np.cumsum(self.weights[index])])
        ends = np.cumsum(n)
        z = self.bias + (total[ends] - total[ends - n]) / np.sqrt(np.maximum(n, 1))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(hosts: pa.Array, paths: pa.Array, blocked: np.ndarray, epochs: int = 20, rate: float = 0.5) -> UrlModel:
    """Adaptive gradient steps on the logistic loss; without examples nothing is blocked."""
    model = UrlModel(np.zeros(BUCKETS), 0.0)
    if not len(blocked):
        return model
    index, n = UrlModel.features(hosts, paths)
    ends = np.cumsum(n)
    value = 1 / np.sqrt(np.maximum(n, 1))
    past, past_b = np.full(BUCKETS, 1e-6), 1e-6
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        order = rng.permutation(len(n))
        for low in range(0, len(order), 256):
            some = order[low : low + 256]
            k = n[some]
            pick = index[np.repeat(ends[some] - k - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            row = np.repeat(np.arange(len(some)), k)
            z = model.bias + np.bincount(row, model.weights[pick], len(some)) * value[some]
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - blocked[some]) / len(some)
            used, place = np.unique(pick, return_inverse=True)
            dw = np.bincount(place, (g * value[some])[row], len(used)) + 1e-5 * model.weights[used]
            past[used] += dw * dw
            model.weights[used] -= rate * dw / np.sqrt(past[used])
            past_b += g.sum() ** 2
            model.bias -= rate * g.sum() / np.sqrt(past_b)
    return model


def train(labelled: DataFrame, most_rows: int = 20_000) -> UrlModel:
    """Fit on a labelled table ``url, blocked`` (boolean).

    Rows with a null are left out, equal URLs count once (blocked if any is). The sample is bounded by
    ``most_rows``: the first URLs in the order of their hash.
    """
    rows = labelled.where("url is not null and blocked is not null").groupBy("url").agg(F.max("blocked").alias("blocked"))
    host, path = host_and_path(F.col("url"))
    few = rows.orderBy(F.xxhash64("url"), "url").limit(most_rows)
    table = few.select(host.alias("host"), path.alias("path"), F.col("blocked").cast("int").alias("blocked")).toArrow().combine_chunks()
    one = lambda c: pa.concat_arrays(table.column(c).chunks) if table.num_rows else pa.array([], pa.string())
    return fit(one("host"), one("path"), table.column("blocked").to_numpy().astype(float))


def judge_urls(pages: DataFrame, rules: list[Rule], model: UrlModel) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, score`` of every page.

    ``rule`` is the text of the longest fitting rule or null; ``verdict`` is that rule's, else ``block``
    where ``score``, the model's probability of a block, is over 0.5. Null URLs have an empty host and
    path and are judged by the model. Repeated rows keep a row each; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def score(parts: pa.Array) -> pa.Array:
        host, path = parts.flatten()
        out = []
        for low, high in slices(text_buffers(path)[1], 1_000_000):
            out.append(shared.value.block(host.slice(low, high - low), path.slice(low, high - low)))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host, "path": path})
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("score", F.arrow_udf(score, T.DoubleType())(F.struct("host", "path")))
    learned = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return rows.select("page_id", "url", "host", "path", text.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "score")
