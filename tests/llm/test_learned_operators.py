"""URL filter, language model, toxicity and quality: held-out accuracy, exact parts and awkward rows."""

import random
import zlib

import brute
import cases
import numpy as np
import pyarrow as pa
import pytest

from chunkcast.llm import lm_score, quality, queries, toxicity, url_filter
from chunkcast.llm.labelled import training_texts

SF = "/root/testdata/sf0.1"


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: s[: min([s.index(c) for c in stops if c in s] + [len(s)])]
    host = cut(rest, "/?#")
    return brute.lower(host), cut(rest[len(host) :], "?#")


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG", "http://a.example.org/", "https://example.org/es/x", "http://b.example.org/en/1?q#f",
    "http://b.example.org/en/2", "http://xexample.org/es/", "ftp://q.com/de/", "http://q.com/fr/a://b", "http://q.com/de", "http://É.com?x", "http://com/de/#",
    "http://y.net/" + "p" * 50_000, "http://y.net/1", "http://y.net/1",
]


def test_url_rules(spark):
    rows = list(enumerate(URLS)) + [(None, "http://a.org/x")]
    pages = cases.frame(spark, [(*r, None) for r in rows], "page_id long, url string, text string")
    model = url_filter.fit(pa.array([], pa.string()), pa.array([], pa.string()), np.zeros(0))
    got = url_filter.judge_urls(pages, queries.URL_RULES, model).collect()

    def judged(page, url):
        host, path = host_and_path(url)
        best = None
        for rule in queries.URL_RULES:
            fits = (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)
            if fits and (best is None or len(rule.text) > len(best.text)):
                best = rule
        return page, host, path, best.text if best else None, best.verdict if best else "allow"

    assert cases.order((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == cases.order(judged(*r) for r in rows)
    assert url_filter.judge_urls(pages.limit(0), [], model).count() == 0


def test_url_model_learns_hosts_and_paths(spark):
    rng = random.Random(5)
    label = [(f"http://{rng.choice(['casino', 'news'])}{k}.example/{rng.choice(['win', 'doc'])}/{k}", None) for k in range(600)]
    rows = [(u, "casino" in u or "/win/" in u) for u, _ in label] + [(None, True), ("http://z/", None)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    model = url_filter.train(labelled, most_rows=400)
    hosts, paths = zip(*(host_and_path(u) for u, _ in label))
    p = model.block(pa.array(hosts), pa.array(paths)) > 0.5
    assert (p == np.array([b for _, b in rows[:600]])).mean() > 0.97
    assert url_filter.train(labelled.limit(0)).block(pa.array([""]), pa.array([""])) == [0.5]


def test_lm_base_scores_and_awkward_rows(spark):
    rows = cases.documents()
    docs = cases.frame(spark, rows)
    model, words = lm_score.train(docs)
    got = lm_score.score_documents(docs, model, words).collect()
    want = cases.order((d, h, t, k, n, round(b, 6)) for d, h, t, k, n, b in brute.base_scores(rows))
    assert cases.order((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_lm_scores_equal_the_slow_version(spark, monkeypatch):
    """All orders, with all words frequent and with most of them asked of the filter."""
    rows = [(k, cases.sentence(random.Random(k % 70), k % 50)) for k in range(400)] + cases.documents() + [(1, "one x")] * 3
    want = cases.order((d, float(x)) for (d, _), x in zip(rows, brute.lm_scores(rows)))
    docs = cases.frame(spark, rows).repartition(3)
    for most in (lm_score.EXACT_WORDS, 5):
        monkeypatch.setattr(lm_score, "EXACT_WORDS", most)
        got = lm_score.learn_and_score(docs).collect()
        got = cases.order((r.doc_id, r.score) for r in got)
        assert [d for d, _ in got] == [d for d, _ in want]
        assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-9)
    model, words = lm_score.train(docs)
    again = lm_score.score_documents(docs, model, words).collect()
    assert np.allclose(sorted(r.score for r in again), sorted(x for _, x in got))


def test_lm_without_training_documents(spark):
    docs = cases.frame(spark, [(None, "a b")]).where("doc_id is not null")
    model, words = lm_score.train(docs)
    assert lm_score.score_documents(docs, model, words).count() == 0
    (row,) = lm_score.score_documents(cases.frame(spark, [(1, "a b")]), model, words).collect()
    assert row.n_known == 0 and row.train_tokens == 0 and row.score == 0.0


def test_lm_words_sum_to_one(spark):
    """The probabilities of all words and one unknown after a context; the filter's errors are small."""
    rows = [(k, cases.sentence(random.Random(k % 30), 40)) for k in range(300)]
    model, _ = lm_score.train(cases.frame(spark, rows), order=1)
    words = sorted({w for _, t in rows for w in brute.space_words(t)} | {"unseen"})
    from chunkcast.llm.textbytes import NOT_SPACE, text_buffers, word_hashes

    h, n = word_hashes(*text_buffers(pa.array(words)), NOT_SPACE)
    logs = model.log_probabilities(h, n).reshape(-1, 2)
    assert 0.97 < (10 ** logs[:, 0]).sum() + 10 ** logs[0, 1] < 1.03


def test_lm_filter_levels(spark):
    counts = [(k * 7919, c) for k, c in enumerate([1, 2, 3, 4, 9, 100, 5000] * 50)]
    own = lm_score.build_filter(spark.createDataFrame(counts, "h long, c long"), least=2)
    level = own.levels(np.array([h for h, _ in counts], np.int64).view(np.uint64))
    want = np.array([0 if c < 2 else int(np.log2(c / 2)) + 1 for _, c in counts])
    assert (level >= want).all() and (level == want).mean() > 0.95  # never too low


def test_lm_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, words = lm_score.train(docs)
    rows = lm_score.score_documents(docs, model, words).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def held_out_table(spark, label):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r[label] for r in labels.select("doc_id", label).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    return docs, labels, truth


def test_toxicity_on_held_out_labels(spark):
    docs, labels, truth = held_out_table(spark, "toxic")
    field = toxicity.train(docs, labels)
    rows = docs.select("doc_id", "text", toxicity.toxicity(docs, field).alias("f")).collect()
    hit = [(r.f.score >= 0.7) == bool(truth[r.doc_id]) for r in rows if r.doc_id in truth]
    assert np.mean(hit) > 0.97
    spans = [r.text.encode()[s.start : s.end].decode() for r in rows for s in r.f.spans]
    assert len(spans) > 100 and all(spans)


def test_quality_on_held_out_labels(spark):
    docs, labels, truth = held_out_table(spark, "quality")
    machine = quality.train(docs, labels, meta=("n_chars",))
    rows = docs.select("doc_id", quality.quality_score(docs, machine, ("n_chars",)).alias("s")).collect()
    assert np.mean([(r.s >= 0.5) == bool(truth[r.doc_id]) for r in rows if r.doc_id in truth]) > 0.97


def labels_for(spark, rows):
    pairs = [(k, int(k % 2), int(k % 3 == 0)) for k, _ in rows if k is not None] + [(None, 1, 1), (1, None, None), (10**6, 1, 1)]
    return spark.createDataFrame(pairs, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_scores_of_awkward_rows(spark, kind):
    rows = cases.documents()
    docs, labels = cases.frame(spark, rows), labels_for(spark, rows)
    for known in (labels, labels.limit(0), labels.where("doc_id = 1")):
        if kind == "toxic":
            own = docs.select("text", toxicity.toxicity(docs, toxicity.train(docs, known))["score"].alias("s"))
        else:
            own = docs.select("text", quality.quality_score(docs, quality.train(docs, known, meta=("n_chars",)), ("n_chars",)).alias("s"))
        got = own.collect()
        assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got)
        if kind == "toxic":
            assert len({r.s for r in got if not r.text}) == 1
    assert own.limit(0).count() == 0


def test_scores_do_not_depend_on_other_columns(spark):
    rows = cases.documents()
    docs = cases.frame(spark, rows)
    field, machine = toxicity.train(docs, labels_for(spark, rows)), quality.train(docs, labels_for(spark, rows))
    other = docs.selectExpr("doc_id + 1 AS doc_id", "text", "'fr' AS lang")
    for f in (lambda d: toxicity.toxicity(d, field)["score"], lambda d: quality.quality_score(d, machine)):
        assert sorted(r[0] for r in docs.select(f(docs)).collect()) == sorted(r[0] for r in other.select(f(other)).collect())


def test_training_sample_is_bounded_and_leaves_out_held_out_rows(spark):
    rows = [(k, f"text {k} " * 10) for k in range(200)] + [(None, "x")]
    labels = spark.createDataFrame([(k, 1 if k % 2 else 0, 0) for k in range(200)] + [(5, 0, 0)], "doc_id long, quality int, toxic int")
    out = training_texts(cases.frame(spark, rows), labels, "quality", most_rows=50, most_bytes=3000)
    ids = [int(t.split()[1]) for t in out.column("text").to_pylist()]
    assert 0 < len(ids) <= 50 and sum(map(len, out.column("text").to_pylist())) <= 3000
    assert all(zlib.crc32(str(k).encode()) % 3 != 1 for k in ids)
    assert out.column("label").to_pylist() == [k % 2 for k in ids]


def test_chains_equal_the_plain_recursion():
    def plain(u, t):
        e, a, out = np.exp(t), [np.array([1.0, 0.0])], np.zeros(len(u))
        for x in u:
            a.append((a[-1] @ e) * [1, np.exp(x)])
            a[-1] /= a[-1].sum()
        b = np.ones(2)
        for k in range(len(u) - 1, -1, -1):
            z = a[k + 1] * b
            out[k] = z[1] / z.sum()
            b = e @ (np.array([1, np.exp(u[k])]) * b)
            b /= b.sum()
        return out

    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 64, 65, 1000, 3, 0])
    u, t = 3 * rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    got, seen = toxicity.Chains(counts).marginals(u, t, pairs=True)
    ends = np.cumsum(counts)
    for e, n in zip(ends, counts):
        assert np.allclose(got[e - n : e], plain(u[e - n : e], t))
    assert np.isclose(seen.sum(), counts.sum()) and np.isclose(seen[:, 1].sum(), got.sum())


def test_factor_machine_identity():
    rng = np.random.default_rng(1)
    m = quality.FactorMachine([], 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    i, x = np.array([0, 3, 5, 8]), rng.normal(size=4)
    slow = 0.3 + m.w[i] @ x + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert np.isclose(m.margin(i, x, np.array([4]))[0], slow)


def test_lm_keeps_every_training_ngram(spark):
    """Words, pairs and triples seen once stay in the filters among 20 million training words."""
    from chunkcast.llm.textbytes import NOT_SPACE, text_buffers, word_hashes

    rare = [(None, f"a{k} b{k} c{k} of the day") for k in range(60)]
    docs = spark.range(480).selectExpr("id AS doc_id", "repeat('x ', 50000) AS text").unionByName(cases.frame(spark, rare).select("doc_id", "text"))
    model, words = lm_score.train(docs)
    assert model.n > 2**24 and all(own.bits is None for own in model.filters)
    got = lm_score.score_documents(docs, model, words).where("doc_id is null").collect()
    h, n = word_hashes(*text_buffers(pa.array([t for _, t in rare])), NOT_SPACE)
    logs = model.log_probabilities(h, n).reshape(60, -1).sum(axis=1)
    grams = lm_score.runs(*lm_score.with_marks(h, n), 3)
    assert all((own.levels(g) > 0).all() for own, g in zip(model.filters, grams))
    # seen once: 3 words, 4 pairs and 4 triples a text
    assert [int(own.number[1]) for own in model.filters] == [180, 240, 240]
    assert np.allclose(sorted(r.score for r in got), sorted(logs)) and (logs > -40).all()


def test_a_huge_text_costs_only_itself(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    huge = [("w " * 6_500_000) if k < 3 else f"text {k}" for k in range(200)]
    out = training_texts(cases.frame(spark, list(enumerate(huge))), labels, "quality", held_out=9)
    assert out.num_rows == 197
    rows = [(k, f"text {k}" if k % 2 else "v " * 500) for k in range(200)]
    with pytest.raises(ValueError):
        training_texts(cases.frame(spark, rows), labels, "quality", most_bytes=8_000)


def test_the_sample_has_both_labels_and_one_row_an_id(spark):
    labels = spark.createDataFrame([(k, int(k < 20)) for k in range(1, 2_000)] + [(5_000 + k, 1) for k in range(50)], "doc_id long, toxic int")
    rows = [(k, f"text {k}") for k in range(2_000)] + [(7, f"again {j}") for j in range(400)]
    out = training_texts(cases.frame(spark, rows), labels, "toxic", held_out=9, most_rows=100, least_rows=15)
    assert out.num_rows == 100 and sum(out.column("label").to_pylist()) == 15
