"""The index of vector groups and the sweep's rounds, against brute force."""

import numpy as np
import pytest

from aerolens.operators import similarity, vector_index as vi
from aerolens.settings import DEFAULT


def clustered(n, width, n_clusters, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clusters, width))
    return (centres[rng.integers(0, n_clusters, n)] + spread * rng.normal(size=(n, width))).astype(np.float32)


def brute(vectors, questions, k):
    """Per question [(id, score at 12 digits)], ties by id as text."""
    v, q = np.asarray(vectors, np.float64), np.asarray(questions, np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = np.round((v @ (q / np.linalg.norm(q, axis=1)[:, None]).T) / np.linalg.norm(v, axis=1)[:, None], 12)
    out = []
    for j in range(len(q)):
        rows = [(-s[i, j], str(i)) for i in range(len(v)) if np.isfinite(s[i, j])]
        out.append([(i, -x) for x, i in sorted(rows)[:k]])
    return out


def tables(spark, vectors, questions):
    inc = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(vectors)], "id string, embedding array<float>").repartition(4)
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(questions)], "question_id string, v array<float>").repartition(3)
    return inc, q


def found(rows):
    out = {}
    for r in rows:
        out.setdefault(r.question_id, []).append((r.rank, r.id, r.raw))
    return {q: [(i, x) for _, i, x in sorted(v)] for q, v in out.items()}


def test_five_thousand_questions_equal_brute_force(spark):
    vectors = clustered(1200, 8, 20, 1)
    vectors[100:140] = vectors[7]  # ties across blocks
    questions = np.concatenate([clustered(4990, 8, 20, 1, 0.3), vectors[:10]])
    inc, q = tables(spark, vectors, questions)
    got = found(vi.top_k(vi.build_index(inc, groups=24), q, 5).collect())
    want = brute(vectors, questions, 5)
    assert len(got) == 5000
    for i, rows in enumerate(want):
        assert got[f"q{i}"] == rows, i


def test_groups_whose_bound_is_too_low_are_not_read(spark):
    vectors = clustered(3000, 16, 30, 2, 0.01)
    inc, q = tables(spark, vectors, vectors[:2])
    index = vi.build_index(inc, groups=40)
    n_groups = index.groups.count()
    seen = []
    real = vi.read_groups

    def spy(ix, route):
        blocks = real(ix, route)
        seen.append((route.count(), {r.group for r in route.collect()}, blocks._jdf.queryExecution().toString()))
        return blocks
    vi.read_groups = spy
    try:
        got = found(vi.top_k(index, q, 10).collect())
    finally:
        vi.read_groups = real
    assert got == {f"q{i}": rows for i, rows in enumerate(brute(vectors, vectors[:2], 10))}
    read = set().union(*(s for _, s, _ in seen))
    assert len(read) < n_groups / 3, (len(read), n_groups)
    assert all("PushedFilters" in plan and "In(group" in plan or not s for _, s, plan in seen)


@pytest.mark.parametrize("groups", [1, 7, 500])
def test_small_blocks_packs_and_odd_vectors(spark, monkeypatch, groups):
    for name, value in (("BLOCK", 5), ("PACK", 3), ("SUB_BLOCKS", 2)):
        monkeypatch.setattr(vi, name, value)
    vectors = clustered(300, 4, 6, 3)
    vectors[10:60] = vectors[10]  # a hot group
    rows = [(str(i), v.tolist()) for i, v in enumerate(vectors)]
    rows += [("n", None), ("z", [0.0] * 4), ("w", [1.0] * 3), ("h", [1.0, None, 0.0, 0.0]), ("nan", [float("nan")] * 4), ("inf", [float("inf"), 0.0, 0.0, 1.0])]
    inc = spark.createDataFrame(rows, "key string, rank array<float>").repartition(3)
    asked = [("a", vectors[10].tolist()), ("b", vectors[3].tolist()), ("c", None), ("d", [0.0] * 4), ("e", [1.0] * 5), ("f", [1.0, None, 1.0, 1.0])]
    q = spark.createDataFrame(asked, "question_id string, v array<float>")
    got = found(vi.top_k(vi.build_index(inc, "key", "rank", groups=groups, width=4), q, 20).collect())
    want = brute(vectors, [vectors[10], vectors[3]], 20)
    assert got == {"a": want[0], "b": want[1]}
    least = found(vi.top_k(vi.build_index(inc, "key", "rank", groups=groups, width=4), q, 20, DEFAULT.with_(score_min=0.999)).collect())
    assert least == {n: [x for x in w if x[1] >= 0.999] for n, w in zip("ab", want)}


def test_packs_and_blocks_reach_python_a_few_at_a_time(spark):
    """A row holds a pack and a block of vectors, so batches are bounded by bytes, not by rows alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        vectors = clustered(40, 4, 2, 5)
        inc, q = tables(spark, vectors, vectors[:3])
        vi.top_k(vi.build_index(inc), q, 4).collect()
        assert int(spark.conf.get(key)) <= 16 << 20
    finally:
        spark.conf.unset(key) if had is None else spark.conf.set(key, had)


def test_an_index_is_read_again_from_its_folder(spark, tmp_path):
    vectors = clustered(200, 4, 5, 4)
    inc, q = tables(spark, vectors, vectors[:3])
    vi.build_index(inc, path=str(tmp_path / "ix"))
    got = found(vi.top_k(vi.load_index(spark, str(tmp_path / "ix")), q, 4).collect())
    assert got == {f"q{i}": w for i, w in enumerate(brute(vectors, vectors[:3], 4))}


def test_empty_corpus_and_no_questions(spark):
    inc, q = tables(spark, clustered(20, 4, 2, 5), clustered(3, 4, 2, 5))
    assert vi.top_k(vi.build_index(inc.limit(0)), q, 3).count() == 0
    assert vi.top_k(vi.build_index(inc), q.limit(0), 3).count() == 0


def test_many_questions_take_the_index_without_being_asked(spark):
    vectors = clustered(150, 4, 5, 6)
    inc, q = tables(spark, vectors, vectors[:40])
    asked = q.withColumnRenamed("v", "embedding")
    few, many = (similarity.similarity_topk(inc, asked, 6, settings=DEFAULT.with_(question_block=b)) for b in (100, 10))
    def key(d):
        return sorted((r.question_id, r["rank"], r.id, r.score) for r in d.collect())
    assert key(few) == key(many) and few.count() == 240


def test_sweep_stops_once_the_sample_is_full(spark, monkeypatch):
    vectors = clustered(400, 4, 12, 7, 0.5)
    inc = spark.createDataFrame([(str(i), f"R{i % 150}", v.tolist()) for i, v in enumerate(vectors)], "id string, report_number string, embedding array<float>")
    probes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(12, 4, 12, 7, 0.5))], "probe int, embedding array<float>")
    asked = []
    real = similarity.similarity_topk

    def spy(incidents, questions, *a, **kw):
        asked.extend(r.probe for r in questions.select("probe").collect())
        return real(incidents, questions, *a, **kw)
    monkeypatch.setattr(similarity, "similarity_topk", spy)
    small = DEFAULT.with_(sweep_probe_k=20, sweep_target_max=50)
    got = [(r.probe, r["rank"], r.id) for r in similarity.sweep(inc, probes, small).orderBy("probe", "rank").collect()]
    assert sorted(asked) == list(range(len(asked))) and 3 <= len(asked) < 12
    # all probes scored, then cut
    ranked = [(p, r + 1, i) for p, rows in enumerate(brute(vectors, [x.embedding for x in probes.orderBy("probe").collect()], 20)) for r, (i, _) in enumerate(rows)]
    first, seen = [], set()
    for p, r, i in ranked:
        if (report := int(i) % 150) not in seen:
            seen.add(report)
            first.append((p, r, i))
    assert got == first[:50]


def test_vectors_are_computed_once_for_an_index(spark):
    vectors = clustered(300, 4, 5, 8)
    inc, q = tables(spark, vectors, vectors[:3])
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    index = vi.build_index(inc.mapInArrow(counted, inc.schema), width=4)
    assert read.value == 300
    assert found(vi.top_k(index, q, 4).collect()) == {f"q{i}": w for i, w in enumerate(brute(vectors, vectors[:3], 4))}


def test_a_vector_is_sent_once_a_bundle_of_packs(spark, monkeypatch):
    monkeypatch.setattr(vi, "PACK", 8)
    vectors = np.random.default_rng(9).normal(size=(2000, 32)).astype(np.float32)  # no bound rules a group out
    inc, q = tables(spark, vectors, vectors[:400])
    sent, real = spark.sparkContext.accumulator(0), vi._scorer

    def spy(*a):
        work = real(*a)

        def counted(asked, held):
            sent.add(held.num_rows)
            return work(asked, held)
        return counted
    monkeypatch.setattr(vi, "_scorer", spy)
    index = vi.build_index(inc)
    got = found(vi.top_k(index, q, 5).collect())
    want = brute(vectors, vectors[:400], 5)
    assert all(got[f"q{i}"] == w for i, w in enumerate(want))
    assert 0 < sent.value <= 2 * index.blocks.count()  # for the first groups and for the rest, not for each of 50 packs


@pytest.mark.parametrize("most_pairs", [1 << 20, 50])
def test_single_precision_only_picks_the_pairs_to_score(monkeypatch, most_pairs):
    for name, value in (("MOST_PAIRS", most_pairs), ("TILE", 64), ("FIRST_TILE", 96)):
        monkeypatch.setattr(vi, name, value)
    rng = np.random.default_rng(10)
    v = rng.normal(size=(700, 16)).astype(np.float32)
    v[50:90] = v[3]  # ties, more than k
    v[100:160] = v[4] * (1 + rng.normal(size=(60, 16)) * 1e-7)  # differ beyond single precision
    units = vi._units(np.concatenate([v[3:9], rng.normal(size=(20, 16))]).astype(np.float64))[0]
    norm = np.linalg.norm(v.astype(np.float64), axis=1)
    near, by_id = (v / norm[:, None]).astype(np.float32), rng.permutation(len(v))
    exact = np.round((v.astype(np.float64) @ units.T) / norm[:, None], 12)
    want = [np.lexsort((by_id, -exact[:, j]))[:10].tolist() for j in range(len(units))]
    kth = np.array([exact[w[-1], j] for j, w in enumerate(want)])
    for least in (np.full(len(units), -2.0), kth, kth - 0.1):
        q, r, s = vi._cell_best(units, least, v, norm, near, by_id, 10, 12)
        assert [r[q == j].tolist() for j in range(len(units))] == want
        assert np.array_equal(s, exact[r, q])
    keep = vi._first_copies(v, by_id, 10)
    copies = np.array([3, *range(50, 90)])
    assert sorted(copies[keep[copies]]) == sorted(copies[by_id[copies].argsort()[:10]]) and keep.sum() == 700 - 41 + 10


def test_parts_are_bounded_and_shared_by_neighbours():
    sizes = [(0, 3), (1, 4), (2, 9), (3, 25), (4, 1), (5, 1)]
    assert vi._parts(sizes, 10) == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (3, 2, 3), (4, 5, 1), (5, 5, 1)]
