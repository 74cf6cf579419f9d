"""Operator 10: exact top-k by inner product with a vector-approximation file.

Each component of an integer vector is cut to one of 256 equal cells between
the least and the greatest value of its dimension. The file of cells (one byte
a component) is scanned for every query: the corners of a cell bound the inner
product from below and above. What cannot be among the k best by those bounds
is dropped, and the exact vectors of the rest are read in the order of their
bounds until no unread bound reaches the k-th best exact score.

Vectors and queries meet in blocks of bounded size: vectors are dealt to slots,
queries to blocks, and each (slot, block) pair is one group. Each group keeps
only what its own bounds cannot exclude.

Defined results: a row whose id or vector is null, or whose vector holds a
null, NaN or infinite component, takes no part, nor does one whose vector has
not the table's most common length (ties: the longer). Rows that repeat an id
count once, with the greatest of their vectors. Equal scores go to the smaller
id. With fewer than k other vectors, all are returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from aerolens.session import scratch_path

from .common import bound_batches

CELLS = 256
SLOT_ROWS = 16_384
QUERY_ROWS = 512
#: Exact vectors read first, as a multiple of k, and how that grows.
FIRST_READ, GROWTH = 4, 4


def scaled(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(x * scale).cast("bigint")))


def _matrix(column, width: int, kind) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def build(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray]:
    """Write and read back the exact vectors (id, v) of ``rows`` with ``width`` components and their cells
    (id, cells); the cells' lowest value and width by dimension come with them."""
    import pyarrow as pa

    spark = rows.sparkSession
    exact_path, cell_path = scratch_path(spark, "va-exact"), scratch_path(spark, "va-cells")
    rows.where(F.size("v") == width).groupBy("id").agg(F.max("v").alias("v")).write.parquet(exact_path)
    exact = spark.read.parquet(exact_path)
    ends = exact.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    low, step = np.zeros(width, np.int64), np.ones(width, np.int64)
    for r in ends:
        low[r.d], step[r.d] = r.lo, max(1, -(-(r.hi - r.lo + 1) // CELLS))

    def cells(batches):
        for b in batches:
            v = _matrix(b.column(1), width, np.int64)
            c = ((v - low) // step).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in c], pa.binary())], names=["id", "cells"])

    exact.mapInArrow(cells, "id bigint, cells binary").write.parquet(cell_path)
    return exact, spark.read.parquet(cell_path), low, step


def scan(cells: DataFrame, queries: DataFrame, low: np.ndarray, step: np.ndarray, k: int) -> DataFrame:
    """(query_id, id, lo, hi): per slot, the vectors whose upper bound reaches the slot's
    k-th best lower bound. ``queries``: (id, v)."""
    import pyarrow as pa

    width = len(low)
    slots = max(1, -(-cells.count() // SLOT_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    left = cells.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64(F.lit("q"), "id"), F.lit(blocks)).cast("int")) \
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def group(vs: pa.Table, qs: pa.Table) -> pa.Table:
        out = []
        if vs.num_rows and qs.num_rows:
            ids, qids = vs.column("id").to_numpy(), qs.column("id").to_numpy()
            cell = np.frombuffer(b"".join(vs.column("cells").to_pylist()), np.uint8).reshape(-1, width)
            floor = (low + cell * step).T.astype(float)
            ceil = floor + (step - 1)[:, None]
            q = _matrix(qs.column("v"), width, float)
            for i in range(0, len(q), 64):
                up, down, some = np.maximum(q[i:i + 64], 0), np.minimum(q[i:i + 64], 0), qids[i:i + 64]
                lo, hi = up @ floor + down @ ceil, up @ ceil + down @ floor
                own = some[:, None] == ids[None, :]
                lo[own] = hi[own] = -np.inf
                kth = np.partition(lo, lo.shape[1] - k, axis=1)[:, -k] if lo.shape[1] > k else np.full(len(lo), -np.inf)
                a, b = np.nonzero((hi >= kth[:, None]) & ~own)
                out.append((some[a], ids[b], lo[a, b].astype(np.int64), hi[a, b].astype(np.int64)))
        cols = [np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(4)]
        return pa.table(dict(zip(("query_id", "id", "lo", "hi"), cols)))

    return left.groupBy("slot", "block").cogroup(right.groupBy("slot", "block")) \
        .applyInArrow(group, "query_id bigint, id bigint, lo bigint, hi bigint")


def top_k(vectors: DataFrame, id_col: str, vector: Column, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` best others of every vector whose ``id`` satisfies
    ``is_query``, a condition on the column ``id``. Vectors are compared with those of their own
    width: each width that some query has is a search of its own."""
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vector.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    # The widths of the queries' vectors: one for each model that made vectors of the table.
    widths = sorted(r.w for r in rows.where(is_query).select(F.size("v").alias("w")).distinct().collect())
    found = [_search(rows, w, is_query, k) for w in widths or [1]]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(rows: DataFrame, width: int, is_query: Column, k: int) -> DataFrame:
    spark = rows.sparkSession
    exact, cells, low, step = build(rows, width)
    queries = exact.where(is_query)
    by_query = Window.partitionBy("query_id")
    nth = F.row_number().over(by_query.orderBy(F.desc("lo"), "id"))
    kth = F.max(F.when(F.col("nth") == k, F.col("lo"))).over(by_query)
    left = (scan(cells, queries, low, step, k).withColumn("nth", nth).withColumn("kth", kth)
            .where(F.col("kth").isNull() | (F.col("hi") >= F.col("kth")))
            .select("query_id", "id", "hi", F.row_number().over(by_query.orderBy(F.desc("hi"), "id")).alias("turn")))
    path = scratch_path(spark, "va-bounds")
    left.write.parquet(path)
    left, read, known = spark.read.parquet(path), FIRST_READ * k, None
    q, x = queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), exact
    while True:
        path = scratch_path(spark, "va-scores")
        dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, p: s + p)
        left.where(F.col("turn") <= read).join(x, "id").join(q, "query_id").select("query_id", "id", dot.alias("score")).write.parquet(path)
        known = spark.read.parquet(path) if known is None else known.unionByName(spark.read.parquet(path))
        ranked = known.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        sure = ranked.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
        left = (left.where(F.col("turn") > read).join(sure, "query_id", "left")
                .where(F.col("kth").isNull() | (F.col("hi") >= F.col("kth"))).drop("kth"))
        if left.isEmpty():
            return ranked.select("query_id", "rank", "id", "score")
        read *= GROWTH
