"""Itemsets and rules that grow level by level, against brute force."""

import itertools
import random
from collections import Counter

import pytest

from aerolens.operators import rules


def table(spark, k, n=400, seed=1):
    rng = random.Random(seed)
    attrs = [f"a{i}" for i in range(k)]
    rows = []
    for _ in range(n):
        mood = rng.random()
        rows.append((*[None if rng.random() < 0.05 else rng.choice("xy" if rng.random() < mood else "uvw ") for _ in attrs], rng.random() < mood))
    return attrs, rows, spark.createDataFrame(rows, ", ".join(f"{a} string" for a in attrs) + ", hot boolean").repartition(3)


def brute(attrs, rows, least, target=None):
    count = Counter()
    for r in rows:
        items = sorted([f"{a}_{'NA' if v is None else v.strip()}" for a, v in zip(attrs, r)] + ([target] if target and r[-1] else []))
        for size in range(1, len(items) + 1):
            count.update(itertools.combinations(items, size))
    return sorted((s, c) for s, c in count.items() if c / len(rows) >= least)


def key(df):
    return sorted((tuple(r.itemset), r["count"]) for r in df.collect())


@pytest.mark.parametrize("k,least", [(12, 0.2), (9, 0.1), (3, 0.0)])
def test_itemsets_of_many_attributes_equal_brute_force(spark, k, least):
    attrs, rows, df = table(spark, k)
    want = brute(attrs, rows, least, "hot")
    got = rules.frequent_itemsets(df, attrs, least, target="hot")
    assert key(got) == want and (k == 3 or len(want[-1][0]) < k)
    assert {(len(r.itemset), r["size"]) for r in got.collect()} == {(len(s), len(s)) for s, _ in want}


def test_only_frequent_sets_are_extended(spark, monkeypatch):
    """What is counted at a level are extensions of the frequent sets of the level before."""
    attrs, rows, df = table(spark, 10)
    seen, real = [], rules.materialise
    monkeypatch.setattr(rules, "materialise", lambda d, name: seen.append((name, real(d, name))) or seen[-1][1])
    found = {s for s, _ in key(rules.frequent_itemsets(df, attrs, 0.25))}
    label = lambda item: f"a{int(item[:4])}_{item[5:]}"
    for name, d in seen:
        if name == "itemset-records":
            for r in d.select("items").distinct().collect():
                assert tuple(sorted(map(label, r["items"]))) in found


def test_missing_columns_empty_tables_and_odd_names(spark):
    df = spark.createDataFrame([("b", "q", True), ("b", None, None)], "_0 string, w string, tail boolean")
    got = key(rules.frequent_itemsets(df, ["w", "_0", "items"], 0.5, target="tail"))
    want = brute(["w", "_0", "items"], [("q", "b", None, True), (None, "b", None, False)], 0.5, "tail")
    assert got == want
    assert rules.frequent_itemsets(df.limit(0), ["w"], 0.1).count() == 0
    assert rules.association_rules(rules.frequent_itemsets(df.limit(0), ["w"], 0.1)).count() == 0


def splits(itemsets):
    support = dict(itemsets)
    for s, c in itemsets:
        for size in range(1, len(s)):
            for a in itertools.combinations(s, size):
                yield a, tuple(x for x in s if x not in a), c, c / support[a]


@pytest.mark.parametrize("bound", [None, 0.5, 0.8, 1.1])
def test_rules_equal_all_splits(spark, bound):
    attrs, rows, df = table(spark, 6)
    itemsets = brute(attrs, rows, 0.08, "hot")
    fi = rules.frequent_itemsets(df, attrs, 0.08, target="hot")
    got = rules.association_rules(fi, "lift", float("-inf"), min_confidence=bound).collect()
    want = sorted((a, c, n) for a, c, n, conf in splits(itemsets) if bound is None or conf >= bound - 1e-12)
    assert sorted((tuple(r.antecedents), tuple(r.consequents), r["count"]) for r in got) == want


def test_a_bound_cuts_consequents_early(spark, monkeypatch):
    attrs, rows, df = table(spark, 6)
    fi = rules.frequent_itemsets(df, attrs, 0.08)
    grown = {}
    real = rules.materialise
    for bound in (0.0, 0.7):
        sizes = []
        monkeypatch.setattr(rules, "materialise", lambda d, name: (lambda out: sizes.append((name, out.count())) or out)(real(d, name)))
        rules.association_rules(fi, "confidence", bound).collect()
        grown[bound] = sum(n for name, n in sizes if name == "rules")
    assert grown[0.7] < grown[0.0] / 2
