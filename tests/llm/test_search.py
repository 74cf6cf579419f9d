"""Near duplicates, repeated passages and exact top-k against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from aerolens.llm import minhash, suffix_dedup
from aerolens.llm.queries import QUERIES


def py_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def py_near(rows, width, percent):
    """{id: component} over rows (id, text); rows with one id are one document."""
    sets = [(i, py_set(t, width)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in up}


def test_near_duplicates_of_odd_rows(spark, odd_dir, odd_rows):
    got = QUERIES["op5_near_duplicates"](spark, odd_dir).collect()
    assert len(got) == len(odd_rows)
    null = -(1 << 63)
    want = py_near([(null if r[0] is None else r[0], r[1]) for r in odd_rows], 2, 80)
    for r in got:
        assert (null if r.component_id is None else r.component_id) == want[null if r.doc_id is None else r.doc_id]
    sizes = sorted((str(r.doc_id), r.n_shingles) for r in got)
    assert sizes == sorted((str(r[0]), len(py_set(r[1], 2))) for r in odd_rows)


def near_corpus():
    """A group of copies with few to many edits each, so that many pairs lie near the threshold."""
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(300)]
    base = [rng.choice(vocab) for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8, 10])):
            words[rng.randrange(len(words))] = rng.choice(vocab[:20])
        rows.append((i, " ".join(words)))
    return rows + [(200 + i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(30)]


@pytest.mark.parametrize("width", [2, 5])
def test_all_links_within_a_large_group(spark, width):
    rows = near_corpus()
    got = {r.id: r.component for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=width, percent=80).collect()}
    assert got == py_near(rows, width, 80)


def test_open_pairs_find_what_stars_miss(spark):
    """Only a star of candidates per bucket is confirmed; the rest must find every other link."""
    rows = near_corpus()[:150]
    docs = spark.createDataFrame([(i, 0, t) for i, t in rows], "r1 bigint, r2 bigint, text string")
    classes = spark.createDataFrame([(i, i, 0) for i, _ in rows], "rep bigint, r1 bigint, r2 bigint")
    stars = spark.createDataFrame([(i, 0) for i in range(1, 150)], "rep bigint, lead bigint")
    alone = spark.createDataFrame([(i, i) for i in range(150)], "id bigint, component bigint")
    got = {(r.a, r.b) for r in minhash.confirm(docs, classes, minhash.open_pairs(docs, classes, stars, alone, 2, 80), 2, 80).collect()}
    sets = [py_set(t, 2) for _, t in rows]
    want = {(i, j) for j in range(150) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {tuple(sorted(p)) for p in got} == want


def test_open_pairs_of_a_large_group_follow_its_links(spark, monkeypatch):
    """Copies of one text, many of them near the threshold: few links are left open, and few pairs are looked at."""
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(3000)]
    base, rows = [rng.choice(vocab) for _ in range(150)], []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([2, 8, 12, 13, 14, 15])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    find, looked = minhash.open_pairs, []

    def pairs(*args):
        found = minhash._written(find(*args), "counted")
        looked.append(found.count())
        return found
    monkeypatch.setattr(minhash, "open_pairs", pairs)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2, percent=80).collect()
    assert {r.id: r.component for r in got} == py_near(rows, 2, 80)
    assert looked[0] < 5 * len(rows)


def test_links_found_late_join_components_with_few_shuffles(spark, monkeypatch):
    """What open pairs add is gone through as links of components, not with all links again; a whole run has few shuffles."""
    rows = near_corpus()
    find, write, edges, shuffles = minhash.components, minhash._written, [], []

    def components(links):
        edges.append(links.where("a <> b").count())
        return find(links)

    def written(df, name):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return write(df, name)
    monkeypatch.setattr(minhash, "components", components)
    monkeypatch.setattr(minhash, "_written", written)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2, percent=80).collect()
    assert {r.id: r.component for r in got} == py_near(rows, 2, 80)
    assert len(edges) == 2 and 0 < edges[1] < edges[0]
    assert sum(shuffles) < 40, sum(shuffles)


def test_texts_of_one_id_are_never_gathered(spark, monkeypatch):
    """However many texts share an id (here: none), each is read and compared by itself."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in near_corpus()]
    read, sizes = minhash._texts, []

    def texts(docs, ids, classes):
        found = read(docs, ids, classes)
        sizes.extend(len(r.texts) for r in found.collect())
        return found
    monkeypatch.setattr(minhash, "_texts", texts)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2, percent=80).collect()
    null = -(1 << 63)
    want = py_near([(null if i is None else i, t) for i, t in rows], 2, 80)
    assert len(got) == len(rows) and set(sizes) == {1}
    assert all((null if r.component is None else r.component) == want[null if r.id is None else r.id] for r in got)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000)]
    random.Random(1).shuffle(edges)
    got = {r.id: r.component for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in (1000, 1001, 1002)}


# ------------------------------------------------------------------ repeated passages


@pytest.mark.parametrize("induce", ["_induce", "_induce_plain"])
def test_suffix_array(monkeypatch, induce):
    other = {"_induce": "_induce_plain", "_induce_plain": "_induce"}[induce]
    monkeypatch.setattr(suffix_dedup, other, getattr(suffix_dedup, induce))
    rng = random.Random(2)
    for _ in range(150):
        k = rng.choice([1, 2, 3, 5, 100])
        s = [rng.randint(1, k) for _ in range(rng.randint(0, 70))] + [0]
        want = sorted(range(len(s)), key=lambda i: s[i:])
        sa = suffix_dedup.suffix_array(np.array(s), k + 1)
        assert sa.tolist() == want
        plcp = suffix_dedup.common_prefixes(np.array(s), sa)
        for a, b in zip(want, want[1:]):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert plcp[b] == n


def py_repeats(rows, length):
    """{row index: kept bytes}, rows (order key, text)."""
    first = {}
    raws = [(k, (t or "").encode()) for k, t in rows]
    for k, raw in raws:
        for p in range(len(raw) - length + 1):
            w = raw[p:p + length]
            if w not in first or (k, p) < first[w]:
                first[w] = (k, p)
    out = []
    for k, raw in raws:
        drop = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p:p + length]] < (k, p):
                drop[p:p + length] = b"\1" * length
        out.append(bytes(b for b, d in zip(raw, drop) if not d))
    return out


def passages():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, line = text(60), text(18)
    rows = []
    for i in range(80):
        t = text(rng.randint(5, 60))
        if i % 3 == 0:
            cut = rng.randint(0, 40)
            t += " " + shared[cut:cut + rng.randint(90, 250)]
        if i % 2 == 0:
            t = line + t
        if i % 7 == 0:
            t += " ab" * 80
        rows.append((i, t + text(rng.randint(0, 20))))
    return rows + [(90, rows[0][1]), (91, rows[0][1] + rows[3][1]), (92, "z" * 99), (93, "z" * 100), (94, "z" * 400), (95, ""), (96, None)]


@pytest.mark.parametrize("hot,block", [(1000, 4 << 20), (1, 4 << 20), (1000, 700)])
def test_repeats_against_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)      # all anchors through shards, or all by single windows
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)  # long texts in one piece, or in several
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {i: k for (i, _), k in zip(rows, py_repeats(rows, 100))}


def test_repeats_of_odd_rows(spark, odd_dir, odd_rows):
    got = QUERIES["op8_suffix_dedup"](spark, odd_dir).collect()
    keys = [((-1 if r[0] is None else r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()), r[1]) for r in odd_rows]
    kept = py_repeats(keys, 100)
    want = sorted((str(r[0]), len((r[1] or "").encode()), hashlib.sha256(k).hexdigest()) for r, k in zip(odd_rows, kept))
    assert sorted((str(g.doc_id), g.n_bytes, g.kept_sha256) for g in got) == want


def test_spans_are_merged():
    a, b = suffix_dedup.merged(np.array([5, 0, 20, 10]), np.array([10, 3, 30, 12]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 3), (5, 12), (20, 30)]


# ------------------------------------------------------------------ exact top-k


def test_topk_of_odd_vectors(spark, odd_dir):
    """Vectors of another width are compared with each other; nulls and what is not finite take no part."""
    vectors = {}
    for r in spark.read.parquet(f"{odd_dir}/embeddings.parquet").collect():
        v = r.embedding
        if r.vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v):
            vectors[r.vec_id] = [math.floor(1024 * x) for x in v]
    want = []
    for q in vectors:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, QUERIES["op10_topk"](spark, odd_dir).collect())) == sorted(want)
    assert any(q == 1200 for q, *_ in want)


def test_topk_in_many_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from aerolens.llm import vafile

    monkeypatch.setattr(vafile, "SLOT_ROWS", 40)
    monkeypatch.setattr(vafile, "QUERY_ROWS", 3)
    monkeypatch.setattr(vafile, "CELLS", 4)       # coarse cells: many candidates
    monkeypatch.setattr(vafile, "FIRST_READ", 1)  # and several rounds of exact reads
    rng = np.random.default_rng(8)
    v = rng.integers(-50, 50, (300, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i bigint, v array<bigint>")
    got = vafile.top_k(df, "i", F.col("v"), F.col("id") % 20 == 0, k=4).collect()
    want = []
    for q in range(0, 300, 20):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(300) if i != q)[:4]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_with_fewer_than_k(spark):
    from pyspark.sql import functions as F

    from aerolens.llm import vafile

    df = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [3, 4])], "i bigint, v array<bigint>")
    got = vafile.top_k(df, "i", F.col("v"), F.col("id") == 0, k=10).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 11), (0, 2, 2, 11)]


@pytest.mark.parametrize("name", ["op5_near_duplicates", "op8_suffix_dedup", "op10_topk"])
def test_empty_table(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []
