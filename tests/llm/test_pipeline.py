"""Every stage of the corpus pipeline against a plain version, and on odd and empty tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from aerolens.llm import langid, mixing, pii

from .test_models import py_viterbi
from .test_search import py_near

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


def py_language(model, text):
    words = [w.lower() for w in langid.word_pattern().findall(text or "")]
    if not words:
        return langid.UNKNOWN, 0.0
    s = langid.Scorer(model)
    path = py_viterbi(s.score(words).astype(np.float32).astype(float).tolist(), langid.SWITCH_PENALTY)
    share = Counter()
    for w, k in zip(words, path):
        share[k] += len(w)
    top = max(range(len(model.languages)), key=lambda k: share[k])
    return model.languages[top], share[top] / sum(share.values())


def py_luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def py_spans(text):
    """All spans (start, end, kind number) that are base or whose window of the whole text gives them enough."""
    def holds(k, v):
        d = re.sub("[^0-9]", "", v)
        if k.check == "octets":
            return all(int(x) <= 255 for x in v.split("."))
        if k.check == "mod97":
            s = v.replace(" ", "")
            return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
        return k.check == "none" or k.digits[0] <= len(d) <= k.digits[1] and (k.check == "digits" or py_luhn(d))
    out = []
    for n, k in enumerate(pii.KINDS):
        for m in re.finditer(k.plain, text):
            near = f"{text[max(0, m.start() - pii.BEFORE):m.start()]} {text[m.end():m.end() + pii.AFTER]}".lower()
            score = k.score + (pii.CONTEXT_BONUS if re.search(k.context, near) else 0)
            if holds(k, m[0]) and (k.base or score >= pii.THRESHOLD):
                out.append((m.start(), m.end(), n))
    return sorted(out)


def py_mask(text):
    groups = []
    for a, b, n in py_spans(text):
        if groups and a < groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], b)
            groups[-1][2].append((a - b, n))
        else:
            groups.append([a, b, [(a - b, n)]])
    for a, b, each in reversed(groups):
        text = f"{text[:a]}<{pii.KINDS[min(each)[1]].name.upper()}>{text[b:]}"
    return text


def test_stage_by_stage(spark, odd_dir, tmp_path):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    columns = docs.columns
    model = langid.train(docs)
    for at, (name, stage) in enumerate(cp.STAGES):
        before = docs.collect()
        path = str(tmp_path / name)
        stage(spark, docs, odd_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if at < len(cp.STAGES) - 1:
            assert docs.columns == columns
        rows = lambda rs: Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rs)
        if name == "language":
            want = []
            for r in before:
                lang, share = py_language(model, r.text)
                if lang != langid.UNKNOWN and share >= cp.LEAST_SHARE:
                    want.append(r)
            assert rows(after) == rows(want) and len(after) < len(before)
        elif name == "near_duplicates":
            comp = py_near([(i, r.text) for i, r in enumerate(before)], 5, 80)  # by row: ids tie nothing
            groups = {}
            for i, r in enumerate(before):
                groups.setdefault(comp[i], []).append(r)
            ident = lambda r: -(1 << 63) if r.doc_id is None else r.doc_id
            got, least = Counter(), Counter()
            for r in after:
                got[ident(r), r.text] += 1
            for g in groups.values():
                low = min(map(ident, g))
                least[low] += 1
                assert any(got[ident(r), r.text] for r in g if ident(r) == low)
            assert Counter(i for i, _ in got.elements()) == least and len(after) < len(before)
            assert sum(r.doc_id == 131 for r in after) == 2 and sum(r.doc_id == 130 for r in after) == 1
        elif name == "personal_data":
            assert Counter((r.doc_id, r.text, r.n_chars) for r in after) == Counter((r.doc_id, py_mask(r.text), len(py_mask(r.text))) for r in before)
            assert any("<CARD>" in r.text for r in after)
        elif name == "mixing":
            assert rows(after) == rows(py_mix(before))
        else:
            tokenizers = pytest.importorskip("tokenizers")
            library = tokenizers.Tokenizer.from_file(cp.vocabulary_path())
            assert len(after) == len(before)
            assert all(list(r.token_ids) == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.token_ids) for r in after)


def py_mix(rows):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(r) for r in rows if r.source == s) for s in names]
    targets = mixing.water_fill([2 * n for n in sizes], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes))
    out = []
    for s, n, t in zip(names, sizes, targets):
        first = min(n, int(t))
        quota, own = [first, int(t) - first], [r for r in rows if r.source == s and size(r)]
        ident = lambda r: -(1 << 63) if r.doc_id is None else r.doc_id
        own.sort(key=lambda r: (hashlib.md5(f"{mixing.SEED}:{ident(r)}".encode()).hexdigest(), ident(r), size(r)))
        at = 0
        for r in own:
            taken = sum(max(0, min(size(r), q - at)) for q in quota)
            out += [r] * int(taken / size(r) + 0.5)
            at += size(r)
    return out


def test_run_on_tables(spark, odd_dir, empty_dir):
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "tokens"]
    done = cp.run(spark, odd_dir)
    assert set(DOCS) < set(done.columns) and done.count() > 0
    assert cp.run(spark, empty_dir).count() == 0


def test_clean_documents_pass_the_filters(spark):
    """Language keeps whatever has one main language; near duplicates keep one of each group."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = cp.language(spark, docs, sf)
    assert kept.count() >= docs.where(F.length("text") > 0).count() * 0.99


def test_rows_without_ids_are_documents_of_their_own(spark):
    """Ninety unrelated texts, a third without an id and a third with one id, all stay; copies among them do not."""
    rng = np.random.default_rng(1)
    words = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 60))
    rows = [((None, 7, i)[i % 3], words(), "en", "s", 1) for i in range(90)]
    again = [(None, rows[0][1], "en", "s", 1), (7, rows[1][1], "en", "s", 1), (500, rows[2][1] + " end", "en", "s", 1)]
    docs = spark.createDataFrame(rows + again, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    kept = cp.near_duplicates(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((r[0], r[1]) for r in rows)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    names = ["doc", "id", "r1", "r2", "rows", "row", "first", "copy", "taken", "_kept_id", "_rows", "_first", "_pattern", "_mark0", "_mark1", "_mix",
             "_taken", "_copy", "_lang_pred", "lang_pred", "lang_score", "lang_spans", "_lang_score", "pattern", "rep", "spans"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in names})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in cp.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        for r in at.collect():
            assert all(r[c] == f"{c}:{r.doc_id}" for c in names), name
    assert at.count() > 0
