"""Language, quality and toxicity: held-out accuracy and odd inputs; BPE against the library."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.llm import bpe, langid, quality, toxicity
from aerolens.llm.queries import QUERIES, vocabulary_path

SF01 = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"


def test_language_held_out_accuracy(spark):
    d = QUERIES["op2_langid"](spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = d.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert r.a > 0.98


def test_language_of_odd_rows(spark, odd_dir, odd_rows):
    got = QUERIES["op2_langid"](spark, odd_dir).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].spans == "" for i in (112, 113, 114))
    assert all(0 <= r.score <= 1 for r in got)


def py_viterbi(scores, penalty):
    best, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(best)), key=lambda j: best[j])
        back.append([top if best[top] - penalty > b else j for j, b in enumerate(best)])
        best = [max(b, best[top] - penalty) + s for b, s in zip(best, row)]
    path = [max(range(len(best)), key=lambda j: best[j])]
    for row in reversed(back):
        path.append(row[path[-1]])
    return path[::-1]


def test_viterbi_against_plain_version():
    rng = np.random.default_rng(3)
    for few in (1, 4, 50):
        sizes = rng.integers(0, 40, 30)
        scores = rng.normal(0, 3, (int(sizes.sum()), 4)).astype(np.float32)
        old, langid.FEW = langid.FEW, few
        try:
            got = langid.viterbi(scores, np.cumsum(sizes), 4.0)
        finally:
            langid.FEW = old
        at = 0
        for n in sizes:
            if n:
                assert got[at:at + n].tolist() == py_viterbi(scores[at:at + n].astype(float).tolist(), 4.0)
            at += n


def test_mixed_text_is_cut_into_spans(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = langid.train(docs)
    pick = {r.lang: r.text for r in docs.where("lang IN ('de', 'fr') AND n_chars BETWEEN 400 AND 800").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    pick = {k: " ".join(v.split()[:40]) for k, v in pick.items()}  # licence lines in English stand at the end of some
    text = pick["de"] + " " + pick["fr"]
    row = langid.label(spark.createDataFrame([(text,)], "text string"), model).first()
    assert [s.lang for s in row.lang_spans] == ["de", "fr"]
    assert abs(row.lang_spans[1].start - len(pick["de"])) < 30


def test_no_training_rows(spark, empty_dir, odd_dir):
    model = langid.train(spark.read.parquet(f"{empty_dir}/documents.parquet"))
    got = langid.label(spark.read.parquet(f"{odd_dir}/documents.parquet"), model).collect()
    assert {r.lang_pred for r in got} == {"und"}
    assert quality.fit([], np.zeros(0)).combine(np.zeros((1, quality.FILTERS))).tolist() == [0.5]
    assert toxicity.fit([], np.zeros(0)).probability(np.zeros((1, len(toxicity.FEATURES)))).tolist() == [0.5]


@pytest.mark.parametrize("name,label,least", [("op3_quality", "quality", 0.97), ("op6_toxicity", "toxic", 0.95)])
def test_classifiers_held_out(spark, name, label, least):
    d = QUERIES[name](spark, SF1).join(spark.read.parquet(f"{SF1}/labels.parquet"), "doc_id").where("held_out")
    r = d.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a > least and 0 <= r.lo <= r.hi <= 1


@pytest.mark.parametrize("name", ["op3_quality", "op6_toxicity"])
def test_classifiers_of_odd_rows(spark, odd_dir, odd_rows, name):
    got = QUERIES[name](spark, odd_dir).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id in (100, 101)]
    assert same[0] == same[1]


def test_pooling_covers_the_whole_text():
    net = quality.fit([], np.zeros(0))
    rng = np.random.default_rng(1)
    raw = bytes(rng.integers(0, 256, 5000, dtype=np.uint8))
    s = quality.symbols(raw)
    want = np.max([sum(net.tables[j][s[i + j]] for j in range(quality.WIDTH)) for i in range(0, len(s) - quality.WIDTH + 1, quality.STRIDE)], axis=0)
    old, quality.BLOCK = quality.BLOCK, 512
    try:
        got = quality.pool(net, [s])[0]
    finally:
        quality.BLOCK = old
    assert np.allclose(got, want, atol=1e-5)
    assert len(s) >= 5000


def test_isotonic_is_increasing():
    rng = np.random.default_rng(2)
    m = rng.normal(0, 1, 500)
    x, y = toxicity.isotonic(m, (rng.random(500) < 1 / (1 + np.exp(-3 * m))).astype(float))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and 0 <= y.min() and y.max() <= 1


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(vocabulary_path())


def odd_texts():
    rng = random.Random(4)
    every = "".join(chr(c) for c in range(0x3100))
    return ["", "   ", " a  b\n\n c\t", "I'll don't 're", "x<|endoftext|> y<|endoftext|><|endoftext|>", "a" * 5000, "=-" * 3000, every, " ".join(every),
            "日本語😀👩‍👩‍👧 مرحبا", "\x1c\x1d a\x85b​ c", "".join(chr(rng.randrange(0x20, 0xD7FF)) for _ in range(3000))]


def test_bpe_equals_the_library(library, monkeypatch):
    e = bpe.Encoder(bpe.load_vocabulary(vocabulary_path()))
    for size in (bpe.LONG, 10):  # whole texts at once, and word by word
        monkeypatch.setattr(bpe, "LONG", size)
        for t in odd_texts():
            ids = library.encode(t, add_special_tokens=False).ids
            assert e.encode(t) == ids
            assert e.decode(ids) == library.decode(ids, skip_special_tokens=False) == t


def test_bpe_memo_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    e = bpe.Encoder(bpe.load_vocabulary(vocabulary_path()))
    t = "many different words that do not fit into so small a memory"
    assert e.encode(t) == library.encode(t, add_special_tokens=False).ids and len(e) <= 5


def test_bpe_merges_agree():
    v = bpe.load_vocabulary(vocabulary_path())
    rng = random.Random(1)
    for _ in range(200):
        raw = [v.byte_ids[ord(c)] for c in rng.choices("abcdetnio rs", k=rng.randint(1, 60))]
        assert bpe.merge_short(list(raw), v.merges, v.results) == bpe.merge_long(raw, v.merges, v.results)


def test_bpe_query(spark, odd_dir, odd_rows, library):
    import hashlib

    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in QUERIES["op7_bpe"](spark, odd_dir).collect()}
    want = set()
    for i, t, *_ in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), len(ids)))
    assert got == want


@pytest.mark.parametrize("name", ["op2_langid", "op3_quality", "op6_toxicity", "op7_bpe"])
def test_empty_table(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


def test_viterbi_with_more_languages_than_a_byte_holds():
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(60, 300))
    scores[10:25, 277] += 30
    state = langid.viterbi(scores, np.array([40, 60]))
    assert state[10:25].tolist() == [277] * 15 and state.min() >= 0
    for a, b in ((0, 40), (40, 60)):
        assert state[a:b].tolist() == py_viterbi(scores[a:b].tolist(), langid.SWITCH_PENALTY)


def test_sampled_labels_take_one_text_an_id(spark):
    from aerolens.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1)], "doc_id bigint, y int")
    assert labelled_sample(docs, labels, "doc_id", "text", "y", 10, 100) == [("text 0", 1), ("b", 0), ("", 1)]
