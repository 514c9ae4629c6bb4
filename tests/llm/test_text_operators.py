"""N-gram join, decontamination, packing and packed ids against slow versions."""

import brute
import cases
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chunkcast.llm import bitpack, decontaminate, jaccard_join, packing
from chunkcast.llm.textbytes import hash_word
from chunkcast.llm.token_ids import TextEncoder, encoder

WORD_FILE, BYTE_FILE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ENCODERS = {f: TextEncoder(f, most=50) for f in (WORD_FILE, BYTE_FILE)}


def library(path):
    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    return lambda text: tool.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_components(spark, width, percent):
    rows = cases.documents()
    got = jaccard_join.jaccard_components(cases.frame(spark, rows), width, percent).collect()
    assert cases.order(map(tuple, got)) == cases.order(brute.jaccard_components(rows, width, percent))


def test_jaccard_chains_and_hot_groups(spark, monkeypatch):
    """Groups far above a block's size, with chains whose ends are not similar, tile by tile."""
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(60):  # each differs from the next by one word more: a chain
        rows.append((k, " ".join([f"c{j}" if j < k // 2 else w for j, w in enumerate(base)])))
    for k in range(40):  # texts with one common half, none similar
        rows.append((100 + k, " ".join(base[:40] + [f"u{k}_{j}" for j in range(40)])))
    got = jaccard_join.jaccard_components(cases.frame(spark, rows), 3, 90).collect()
    assert cases.order(map(tuple, got)) == cases.order(brute.jaccard_components(rows, 3, 90))


def test_jaccard_empty_table(spark):
    out = jaccard_join.jaccard_components(cases.empty(spark))
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


def test_budgets_still_cover_the_greatest_difference():
    bands = jaccard_join.Bands.of(90)
    costs = {(40, 3): 1e9, (40, 7): 1e8}
    budget = jaccard_join.allocate(costs, {40: 100}, bands)[40]
    assert budget.sum() == bands.segments[40] and budget[3] == 0 and (budget == 2).any()


@given(st.integers(1, 100_000), st.integers(0, 100_000), st.sampled_from([60, 80, 90, 95]))
def test_bands_hold_every_similar_pair(n, more, percent):
    m = n * 100 // percent - more % (n * 100 // percent - n + 1)
    bands = jaccard_join.Bands.of(percent)
    a, b = bands.band(np.array([min(n, m), max(n, m)]))
    assert b - a in (0, 1)
    assert (100 - percent) * (n + m) // (100 + percent) < bands.segments[a]


def items():
    rng = __import__("random").Random(7)
    rows = [(k, cases.sentence(rng, 30)) for k in range(6)]
    rows += [(10, "Short, item!"), (11, "kax"), (2, cases.sentence(rng, 20)), (12, None), (13, ""), (None, cases.sentence(rng, 15))]
    rows.append((14, rows[0][1]))
    return rows


def contaminated_documents(bench):
    docs = cases.documents()[:60]
    long = bench[0][1].split()
    docs += [(900, f"before {bench[1][1]} after"), (901, " ".join(long[:13])), (902, " ".join(long[:12])), (903, " ".join(long[3:25] + ["z"] + long[5:20]))]
    docs += [(904, "a short ITEM; and more"), (905, f"{bench[2][1]}. {bench[2][1]}"), (906, bench[-2][1]), (None, bench[3][1]), (907, None)]
    docs += [(908, "pad " * 1000 + bench[4][1])]
    return docs


@pytest.mark.parametrize("drop_single", [True, False])
def test_contamination(spark, drop_single):
    bench = [r for r in items() if not (drop_single and r[0] in (10, 11))]
    docs = contaminated_documents(bench)
    found = decontaminate.find_contamination(cases.frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string"))
    one = F.col("found")
    names = F.array_join(F.array_sort(F.transform(one["items"], lambda i: i.cast("string"))), ",")
    got = found.select(
        "doc_id", one["n_words"], decontaminate.hit_words(one), F.size(one["items"]), F.sha2(names.cast("binary"), 256), decontaminate.is_contaminated(one)
    ).collect()
    assert cases.order(map(tuple, got)) == cases.order(brute.contamination(docs, bench))


def test_decontaminate_removes_and_cuts(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string")
    hit = " ".join(f"w{k}" for k in range(14))
    docs = cases.frame(spark, [(1, f"é {hit}, end"), (2, "x " * 400 + hit + " y"), (3, "clean"), (4, None)])
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, cut_words=13).collect()}
    assert cut == {2: "x " * 400 + " y", 3: "clean", 4: None}


def test_items_in_parts_give_the_same_finds(spark, most=35):
    bench = [*items(), (20, " ".join(f"w{k}" for k in range(13))), (21, " ".join(f"v{k}" for k in range(13)))]
    docs = contaminated_documents(bench)
    docs += [(910, f"{bench[-2][1]} {bench[-1][1]}"), (911, f"é, {bench[-2][1]}; {bench[1][1]} ü"), (912, f"{bench[0][1]} {bench[0][1]}")]
    some = [*bench[:2], (1, " ".join(f"u{k}" for k in range(40))), bench[6], *bench[-2:]]  # 40 words go in two pieces
    docs, bench = cases.frame(spark, [*docs, (913, f"x {some[2][1]} x")]), spark.createDataFrame(some, "item_id long, text string").coalesce(1)
    assert 3 <= len(list(decontaminate.automata(bench, 13, most))) <= 6
    one, parts = (decontaminate.find_contamination(docs, bench, max_words=n).collect() for n in (10_000, most))
    assert cases.order(map(tuple, parts)) == cases.order(map(tuple, one))
    cut = [decontaminate.decontaminate(docs, bench, percent=90, cut_words=14, max_words=n).collect() for n in (10_000, most)]
    assert cases.order(map(tuple, cut[0])) == cases.order(map(tuple, cut[1]))


def test_pieces_of_a_long_item_hold_every_window_once(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(50))), (2, "a b")], "item_id long, text string")
    parts = list(decontaminate.item_parts(bench, 13, 20))
    runs = [tuple(words[k : k + 13]) for part in parts for item, words in part if item == 1 for k in range(len(words) - 12)]
    assert len(runs) == len(set(runs)) == 38
    assert all(sum(len(words) for _, words in part) <= 20 for part in parts)


def test_decontaminate_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(cases.empty(spark), none).count() == 0
    rows = decontaminate.find_contamination(cases.frame(spark, [(1, "a b")]), none).collect()
    assert rows[0].found.n_words == 2 and rows[0].found.spans == []
    with pytest.raises(ValueError, match="a window"):
        decontaminate.find_contamination(cases.empty(spark), none, max_words=3)


ODD = ["", " ", "  a", "a  b", "a \n b", "a\n b ", "it's I'll don't", "É́ é Å", "x\x1cy z", "日本語 テキスト 😀 a", "a b\u3000c", "ΟΔΟΣ", "١٢ ½ ²x", "<|endoftext|> a"]
LETTERS = "ab c  \n\t'sé½²٣.!1Aß\u0301\u200b\u3000\u2003“É\x85\xa0"


@pytest.mark.parametrize("path", [WORD_FILE, BYTE_FILE])
@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(st.sampled_from(ODD), st.text(LETTERS, max_size=30), st.text(max_size=12)), max_size=6))
def test_encoder_equals_the_library(path, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    own, direct = [], library(path)
    for _, ids, n in ENCODERS[path].encode(pa.array(texts, pa.string()), end_id=7, most_bytes=20):
        ends = np.cumsum(n)
        own += [ids[e - k : e].tolist() for e, k in zip(ends, n)]
    assert own == [[*direct(t), 7] for t in texts]


def test_packing(spark):
    rows, ids = cases.documents(), library(BYTE_FILE)
    pieces = packing.pack_documents(cases.frame(spark, rows), BYTE_FILE, end_id=0, length=64).collect()
    wanted = sorted(([*ids(t), 0] for _, t in rows), key=lambda x: (len(x), x))
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    stream = []
    for k in sorted(by_sequence):
        at = 0
        for p in sorted(by_sequence[k], key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
            stream += [(p.start, p.length, p.doc_tokens, x) for x in np.frombuffer(p.ids, "<u4").tolist()]
        assert at == 64 or k == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    docs, now = [], []
    for _, _, total, x in stream:
        now.append(x)
        if len(now) == total:
            docs.append(now)
            now = []
    assert not now and sorted(docs, key=lambda x: (len(x), x)) == wanted
    assert packing.pack_documents(cases.empty(spark), BYTE_FILE).count() == 0


def test_packing_starts_are_the_documents(spark):
    rows, ids = [(k, t) for k, t in cases.documents() if k is not None and k < 500], library(BYTE_FILE)
    own = {k: [*ids(t), 0] for k, t in rows}
    for p in packing.pack_documents(cases.frame(spark, rows), BYTE_FILE, length=32).collect():
        assert np.frombuffer(p.ids, "<u4").tolist() == own[p.doc_id][p.start : p.start + p.length]


@given(st.integers(1, 40), st.lists(st.integers(0, 2**40), max_size=70), st.integers(0, 69))
def test_bits_round_trip(bits, values, first):
    ids = np.array([v % (1 << bits) for v in values], np.uint64)
    raw = bitpack.pack_bits(ids, bits)
    assert len(raw) == -(-len(ids) * bits // 8)
    first = min(first, len(ids))
    assert bitpack.unpack_bits(raw, bits, first, len(ids) - first).tolist() == ids[first:].tolist()


def test_least_bits():
    assert [bitpack.bits_for(v) for v in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_token_files(spark):
    rows, ids = cases.documents(), library(WORD_FILE)
    manifest = bitpack.write_token_files(cases.frame(spark, rows), WORD_FILE, end_id=2, block=100)
    got = bitpack.read_token_files(manifest).collect()
    got = sorted(((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=lambda r: r[0])
    keys = [(k is not None, k or 0) for _, k, _ in got]
    assert keys == sorted(keys) and [g[0] for g in got] == np.cumsum([0, *(len(g[2]) for g in got[:-1])]).tolist()
    assert sorted((str(k), x) for _, k, x in got) == sorted((str(k), [*ids(t), 2]) for k, t in rows)
    file = bitpack.BitFile(next(r.file for r in manifest.collect() if r.n_docs))
    k = int(np.argmax(file.lengths))
    assert file.document(k).tolist() == file.ids(0, file.n_ids)[file.starts[k] : file.starts[k + 1]].tolist()
    assert bitpack.read_token_files(bitpack.write_token_files(cases.empty(spark), WORD_FILE)).count() == 0


def test_word_hashes_are_those_of_single_words():
    assert hash_word("ABC") == hash_word("abc") != hash_word("abd")


@pytest.mark.parametrize("path", [WORD_FILE, BYTE_FILE])
def test_added_tokens_in_texts_are_split_as_by_the_library(spark, path):
    tool = Tokenizer.from_file(path)
    texts = ["hello <|endoftext|> a", "plain text", "", "<|endoftext|>", "a<|endoftext|><|startoftext|>b é", "<|endof", "text|> x", "<|ENDOFTEXT|> it's", None, "x"]
    want = [[*tool.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    own = []
    for _, ids, n in encoder(path).encode(pa.array(texts, pa.string()), end_id=7):
        own += [ids[e - k : e].tolist() for e, k in zip(np.cumsum(n), n)]
    assert own == want
    pieces = packing.pack_documents(cases.frame(spark, list(enumerate(texts))), path, end_id=7, length=1024).collect()
    assert {p.doc_id: np.frombuffer(p.ids, "<u4" if len(p.ids) == 4 * p.length else "<u2").tolist() for p in pieces} == dict(enumerate(want))
    manifest = bitpack.write_token_files(cases.frame(spark, list(enumerate(texts))), path, end_id=7)
    assert {r.doc_id: r.n_tokens for r in bitpack.read_token_files(manifest).collect()} == {k: len(w) for k, w in enumerate(want)}
