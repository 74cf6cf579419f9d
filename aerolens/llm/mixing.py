"""Operator 4: mix overlapping sources to target weights by min-cost flow.

Documents are grouped by the set of sources they belong to (their membership
pattern). Patterns are few; documents are many, and only the patterns' total
sizes reach the driver. There a min-cost flow routes words from patterns to
source quotas: each pattern offers its words once at cost 0, a second time at
cost 1, and so on (convex in the repetitions), up to ``max_repeats`` times.
Inside a pattern, documents are taken in a seeded hash order until the flow of
each repetition is used up; the document on the edge is taken in part.

The edge of each pattern and repetition is found without sorting a pattern:
sizes are summed by hash bucket, the bucket with the edge is found from those
sums, and only its documents are ranked. Choosing is then a row-wise
comparison with a table of one row a pattern.

Defined results: a null source is a source of its own, last in order; a null or
empty text has size 0 and is never taken; rows that repeat an id and size are
tied and share what is left at the edge equally, rounded down, so results do
not depend on row order; an empty table gives an empty mix.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerolens.session import scratch_path

from .common import words

SEED = 42
SHARE = 1.5
MAX_REPEATS = 2
WEIGHTS = (5, 2, 1)
_NO_ID = -(1 << 63)


@dataclass
class Mix:
    #: One row a source: (source, source_size, target).
    sources: DataFrame
    #: One row a pattern: (pattern, marks), marks[r] being the last document of repetition r.
    marks: DataFrame
    #: Words routed: {(pattern, source): words}.
    routed: dict[tuple[str, str | None], int]


def water_fill(caps: list[int], weights: list[int], total: float) -> list[float]:
    """Shares of ``total`` by weight, none above its cap, the excess shared again by weight."""
    order = sorted(range(len(caps)), key=lambda i: (caps[i] / weights[i], i))
    left, weight, out = total, sum(weights), [0.0] * len(caps)
    capped = 0
    for at, i in enumerate(order):
        level = left / weight
        if caps[i] / weights[i] > level:
            break
        out[i], left, weight, capped = float(caps[i]), left - caps[i], weight - weights[i], at + 1
    for i in order[capped:]:
        out[i] = left / weight * weights[i]
    return out


def min_cost_flow(offers: dict[str, int], members: dict[str, list], quotas: dict, repeats: int) -> dict[tuple, int]:
    """Most flow at least cost from patterns to sources: {(pattern, source, repetition): words}.

    Arcs: start -> (pattern, r), capacity the pattern's words, cost r; (pattern, r) -> each of
    its sources; source -> end, capacity its quota. Successive shortest paths with potentials.
    """
    node = count(2)
    ids = {k: next(node) for k in [("p", p, r) for p in offers for r in range(repeats)] + [("s", s) for s in quotas]}
    arcs: list[list[int]] = []  # [to, capacity, cost]; arc i ^ 1 is its reverse
    out: list[list[int]] = [[] for _ in range(len(ids) + 2)]

    def arc(a: int, b: int, cap: int, cost: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, cap, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    routes = {}
    for p, size in offers.items():
        for r in range(repeats):
            arc(0, ids["p", p, r], size, r)
            for s in members[p]:
                routes[p, s, r] = arc(ids["p", p, r], ids["s", s], size, 0)
    for s, q in quotas.items():
        arc(ids["s", s], 1, q, 0)

    height = [0] * len(out)
    while True:
        far, came = [None] * len(out), [-1] * len(out)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for i in out[a]:
                b, cap, cost = arcs[i]
                if cap and (far[b] is None or d + cost + height[a] - height[b] < far[b]):
                    far[b], came[b] = d + cost + height[a] - height[b], i
                    heapq.heappush(heap, (far[b], b))
        if far[1] is None:
            break
        height = [h if d is None else h + d for h, d in zip(height, far)]
        path, at = [], 1
        while at:
            path.append(came[at])
            at = arcs[came[at] ^ 1][0]
        room = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= room
            arcs[i ^ 1][1] += room
    return {k: arcs[i ^ 1][1] for k, i in routes.items() if arcs[i ^ 1][1]}


def prepare(docs: DataFrame, id_col: Column, text: Column, members: Column) -> DataFrame:
    """``docs`` with what the mix reads of a row, in the one struct ``_mix``: (pattern, members, u, id, size)."""
    members = F.array_sort(F.array_distinct(members))
    ident = F.coalesce(id_col.cast("bigint"), F.lit(_NO_ID))
    return docs.withColumn("_mix", F.struct(
        F.to_json(members).alias("pattern"), members.alias("members"),
        F.md5(F.concat(F.lit(f"{SEED}:"), ident.cast("string"))).alias("u"), ident.alias("id"),
        F.size(words(text)).cast("bigint").alias("size")))


def plan_mix(prepared: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS,
             max_repeats: int = MAX_REPEATS) -> Mix:
    """Targets, flow and each pattern's marks for rows from ``prepare``."""
    spark = prepared.sparkSession
    path = scratch_path(spark, "mix-sizes")
    prepared.select("_mix.*").write.parquet(path)
    rows = spark.read.parquet(path)
    patterns = rows.groupBy("pattern", "members").agg(F.sum("size").alias("size")).collect()  # few: see the module text
    members = {r.pattern: list(r.members) for r in patterns}
    offers = {r.pattern: r["size"] for r in patterns}
    sizes: dict = {}
    for p in sorted(offers):
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + offers[p]
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    wish = water_fill([max_repeats * sizes[s] for s in names], [weights[i % len(weights)] for i in range(len(names))],
                      share * sum(offers.values()))
    flow = min_cost_flow({p: offers[p] for p in sorted(offers)}, members, {s: int(t) for s, t in zip(names, wish)}, max_repeats)
    quota: dict = {}
    routed: dict = {}
    for (p, s, r), n in flow.items():
        quota[p, r] = quota.get((p, r), 0) + n
        routed[p, s] = routed.get((p, s), 0) + n
    quotas = spark.createDataFrame([(p, r, n) for (p, r), n in quota.items()], "pattern string, rep int, quota bigint")
    sources = spark.createDataFrame([(s, sizes[s], t) for s, t in zip(names, wish)],
                                    "source string, source_size bigint, target double")
    return Mix(sources, _marks(rows, quotas, max_repeats), routed)


def _marks(rows: DataFrame, quotas: DataFrame, repeats: int) -> DataFrame:
    rows = rows.where(F.col("size") > 0).withColumn("bucket", F.substring("u", 1, 3))
    one = Window.partitionBy("pattern", "rep")
    start = one.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words")).join(quotas, "pattern")
            .withColumn("before", F.coalesce(F.sum("words").over(start), F.lit(0)))
            .where((F.col("before") < F.col("quota")) & (F.col("quota") <= F.col("before") + F.col("words")))
            .drop("words"))
    start = one.orderBy("u", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (rows.join(edge, ["pattern", "bucket"])
              .groupBy("pattern", "rep", "quota", "before", "u", "id", "size").agg(F.count("*").alias("ties"))
              .withColumn("at", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("ties")).over(start), F.lit(0)))
              .where((F.col("at") < F.col("quota")) & (F.col("quota") <= F.col("at") + F.col("size") * F.col("ties"))))
    mark = F.struct(F.struct("u", "id", "size").alias("key"),
                    F.floor((F.col("quota") - F.col("at")) / F.col("ties")).cast("bigint").alias("part"))
    return ranked.groupBy("pattern").agg(*[F.max(F.when(F.col("rep") == r, mark)).alias(f"mark{r}") for r in range(repeats)])


def taken(prepared: DataFrame, mix: Mix, max_repeats: int = MAX_REPEATS, out: str = "taken") -> DataFrame:
    """``prepared`` with the number of words that the mix takes of each row, repeats counted."""
    marks = mix.marks.select(F.col("pattern").alias("_pattern"), *[F.col(f"mark{r}").alias(f"_mark{r}") for r in range(max_repeats)])
    key = F.struct("_mix.u", "_mix.id", "_mix.size")

    def one(r: int) -> Column:
        m = F.col(f"_mark{r}")
        return (F.when(m.isNull() | (F.col("_mix.size") == 0), F.lit(0)).when(key < m["key"], F.col("_mix.size"))
                .when(key == m["key"], F.least(m["part"], F.col("_mix.size"))).otherwise(F.lit(0)))
    total = sum((one(r) for r in range(1, max_repeats)), one(0))
    return (prepared.join(marks, F.col("_mix.pattern") == F.col("_pattern"), "left")
            .withColumn(out, total.cast("bigint"))
            .drop("_pattern", *[f"_mark{r}" for r in range(max_repeats)]))
