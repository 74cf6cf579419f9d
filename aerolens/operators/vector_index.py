"""An index of vector groups for exact cosine top-k over many questions.

``build_index`` finds centres on a bounded sample, gives every vector to its nearest
centre and stores the vectors of a group in blocks, ordered by their angle to the
centre, so a block is a shell around it: all its vectors are between ``lo`` and ``hi``
radians away. By the triangle inequality of angles a question at angle t to the
centre is at least ``max(lo - t, t - hi)`` away from every vector of the shell, which
bounds their scores from above.

``top_k`` packs questions that are near each other, reads for each pack the nearest
groups (a small share of the vectors, k at least), takes each question's kth score from those, and then only
the groups (and in them the shells) whose bound is not below it. Packs and groups meet
in cells of bounded size: a slice of the vectors (some groups, or a part of a large one)
with a bundle of packs, cogrouped by Spark, so neither a hot group nor many questions
meet in one task, and each vector is sent once a bundle and not once a pack. In a cell
a product in single precision finds the pairs that may reach a question's kth score (its
rounding is bounded, and allowed for); only those are scored, in double precision.

Where bounds rule nothing out (directions that spread over many components), every
question meets every vector: that work grows with the product of their numbers.

Broadcast: the centres, at most ``MAX_GROUPS`` (and ``CENTRE_BYTES``). On the driver:
the centres, the sample they are fitted on (``SAMPLE_BYTES``) and group numbers.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import bound_batches, materialise, scratch_path
from ..settings import DEFAULT, Settings

#: Bounds of what is broadcast and sampled.
MAX_GROUPS, CENTRE_BYTES, SAMPLE_BYTES = 4096, 32 << 20, 64 << 20
#: Rounds of the centres' fit on the sample.
FIT_ROUNDS = 4
#: Vectors of a block, questions of a pack, full blocks of a slice, sub-keys that a group's rows are dealt to when blocks are formed.
BLOCK, PACK, SUB_BLOCKS, DEAL = 1024, 256, 64, 64
#: Packs that the questions of a sub-key fill.
DEAL_PACKS = 16
#: Bytes of a cell's vectors, and of its questions.
CELL_BYTES = 16 << 20
#: Vectors that a pack is multiplied with at once (the product stays in the processor's cache; more while no kth score is known), pairs
#: a question and k that a product may leave before the bar is raised, pairs held before they are cut to k.
TILE, FIRST_TILE, OPEN_PAIRS, MOST_PAIRS = 1024, 4096, 2, 1 << 20
#: Share of the vectors that a pack reads first: the better the kth scores known from there, the fewer pairs are scored later.
FIRST_SHARE = 1 / 32
#: What bounds allow for rounding: radians and score.
SLACK, SCORE_SLACK = 1e-6, 1e-9


class VectorIndex(NamedTuple):
    """``groups``: (group, centre, lo, hi, size, blocks). ``blocks``: (group, block, lo, hi, ids, vectors), vectors one after the other as bytes of floats."""
    groups: DataFrame
    blocks: DataFrame
    width: int


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The directions of finite, non-zero vectors, and which rows those are."""
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.linalg.norm(v, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    return v[ok] / norm[ok, None], ok


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def _matrix(column, width: int) -> np.ndarray:
    """A list column of vectors as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _rows(packed, kind: str, width: int) -> np.ndarray:
    """The vectors of one packed value."""
    return np.frombuffer(packed.as_buffer(), kind).reshape(-1, width)


def fit_centres(sample: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` directions: of the sample's distinct rows every so many, then means of what is nearest, a few times."""
    units = np.unique(_units(sample)[0], axis=0) if len(sample) else sample
    if not len(units):
        return np.zeros((0, sample.shape[1]))
    centres = units[np.unique(np.linspace(0, len(units) - 1, n).astype(int))]
    for _ in range(FIT_ROUNDS):
        near = np.concatenate([(units[i:i + 4096] @ centres.T).argmax(1) for i in range(0, len(units), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, units)
        centres = _units(sums)[0]
    return centres


def _chained(centres: np.ndarray) -> np.ndarray:
    """The centres in an order in which each is followed by the nearest one left, so that near groups have near numbers."""
    left, order = np.ones(len(centres), bool), []
    while left.any():
        order.append(int(np.argmax(np.where(left, centres @ centres[order[-1]] if order else 0.0, -np.inf))))
        left[order[-1]] = False
    return centres[order]


def build_index(incidents: DataFrame, id_col: str = "id", vec_col: str = "embedding", groups: int | None = None,
                width: int | None = None, path: str | None = None) -> VectorIndex:
    """Index the vectors of ``width`` components (default: the most that any has) and write it to ``path`` (default: the shared
    scratch folder). Vectors that are null, hold nulls or other than finite numbers, or are zero have no direction and are left out.
    ``groups`` defaults to the square root of the number of vectors over four."""
    spark = incidents.sparkSession
    bound_batches(spark)
    src = incidents.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    width = width or src.agg(F.max(F.size("v"))).first()[0] or 1
    src = materialise(src.where(F.size("v") == width), "vectors")  # read three times; vectors may come from texts
    n = src.count()
    groups = max(1, min(groups or math.ceil(math.sqrt(n) / 4), MAX_GROUPS, CENTRE_BYTES // (8 * width)))
    wanted = max(groups, min(64 * groups, SAMPLE_BYTES // (8 * width)))
    sample = src.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // wanted))) == 0).orderBy("id").limit(2 * wanted).toArrow()
    centres = fit_centres(_matrix(sample["v"].combine_chunks(), width) if n else np.zeros((0, width)), groups)
    centres = _chained(centres)
    path = path or scratch_path(spark, "vector-index")
    id_type = src.schema["id"].dataType.simpleString()
    near = src.mapInArrow(_assigner(spark.sparkContext.broadcast(centres), width), f"group int, angle double, id {id_type}, v array<float>")
    packed = near.repartition("group", F.pmod(F.xxhash64("id"), F.lit(DEAL))).sortWithinPartitions("group", "angle", "id") \
        .mapInArrow(_block_packer(BLOCK), f"group int, block bigint, lo double, hi double, ids array<{id_type}>, vectors binary")
    packed.write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    held = blocks.groupBy("group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.size("ids")).alias("size"), F.count("*").alias("blocks"))
    at = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "group int, centre array<double>")
    at.join(held, "group").select("group", "centre", "lo", "hi", "size", "blocks", F.lit(width).alias("width")).write.parquet(f"{path}/groups")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    groups = spark.read.parquet(f"{path}/groups")
    width = groups.agg(F.max("width")).first()[0] or 1
    return VectorIndex(groups, spark.read.parquet(f"{path}/blocks"), width)


def _assigner(sent, width: int):
    def work(batches):
        import pyarrow as pa

        centres = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                units, ok = _units(_matrix(part.column(1), width))
                rows = part.filter(pa.array(ok))
                if not rows.num_rows or not len(centres):
                    continue
                cos = units @ centres.T
                group = cos.argmax(1).astype(np.int32)
                angle = np.arccos(np.clip(cos[np.arange(len(group)), group], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(angle), *rows.columns], names=["group", "angle", "id", "v"])
    return work


def _block_packer(most: int):
    """Consecutive rows of a group as blocks of at most ``most`` rows."""
    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        seq, waiting = TaskContext.get().partitionId() << 32, None

        def rows(b):
            nonlocal seq
            seq += 1
            angle = b.column(1)
            return pa.RecordBatch.from_arrays(
                [b.column(0).slice(0, 1), pa.array([seq], pa.int64()), angle.slice(0, 1), angle.slice(b.num_rows - 1, 1),
                 pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(2)),
                 pa.array([b.column(3).flatten().to_numpy().astype("<f4").tobytes()], pa.binary())],
                names=["group", "block", "lo", "hi", "ids", "vectors"])

        for batch in batches:
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            group = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                last = b == batch.num_rows
                while b - a > most or (b > a and not last):
                    step = min(most, b - a)
                    yield rows(batch.slice(a, step))
                    a += step
                waiting = batch.slice(a, b - a) if last else None
        if waiting is not None and waiting.num_rows:
            yield rows(waiting)
    return work


# ---------------------------------------------------------------- questions


def _pack_nearest(sent, width: int):
    def work(batches):
        import pyarrow as pa

        centres = sent.value
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            units, ok = _units(v.astype(np.float64))
            if len(units):
                flat = pa.array(v[ok].ravel())
                yield pa.RecordBatch.from_arrays([pa.array((units @ centres.T).argmax(1).astype(np.int32)), batch.column(0).filter(pa.array(ok)),
                                                  pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1) * width, pa.int32()), flat)],
                                                 names=["near", "question_id", "v"])
    return work


def _question_packer(most: int):
    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                part = batch.slice(i, most)
                n, seq = part.num_rows, seq + 1
                yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), part.column(0).slice(0, 1), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(1)),
                                                  pa.array([part.column(2).flatten().to_numpy().tobytes()], pa.binary())],
                                                 names=["pack", "near", "question_ids", "asked"])
    return work


def _first_groups(angles: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """For each row of angles the nearest groups that together hold k vectors: which groups are among them for any."""
    order = angles.argsort(1, kind="stable")
    before = np.cumsum(size[order], 1) - size[order]
    first = np.zeros(angles.shape[1], bool)
    first[order[before < k]] = True
    return first


def _bound(angles: np.ndarray, lo, hi) -> np.ndarray:
    """The highest score that a vector between ``lo`` and ``hi`` of the centre can have."""
    return np.cos(np.maximum(np.maximum(lo - angles, angles - hi) - SLACK, 0.0))


def _router(sent, width: int, k: int, rest: bool, kind: str):
    """(pack, group): the groups that a pack reads first, or (``rest``) those that its questions' kth scores leave open."""
    def work(batches):
        import pyarrow as pa

        number, centres, lo, hi, size = sent.value
        for batch in batches:
            packs, groups = [], []
            for row in range(batch.num_rows):
                units = _units(_rows(batch.column(1)[row], kind, width).astype(np.float64))[0]
                angles = _angles(units, centres)
                open_ = _first_groups(angles, size, k) | _first_groups(-(units.sum(0) @ centres.T)[None, :], size, size.sum() * FIRST_SHARE)
                if rest:
                    least = batch.column(2).slice(row, 1).flatten().to_numpy(zero_copy_only=False)
                    open_ = ~open_ & (_bound(angles, lo, hi) >= least[:, None] - SCORE_SLACK).any(0)
                found = number[open_]
                packs.append(np.full(len(found), batch.column(0)[row].as_py(), np.int64))
                groups.append(found.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(packs)), pa.array(np.concatenate(groups))], names=["pack", "group"])
    return work


def _first_copies(v: np.ndarray, by_id: np.ndarray, k: int) -> np.ndarray:
    """Which rows stay if of more than k equal vectors only the k first by id can be among the k best."""
    keep = np.ones(len(v), bool)
    words = np.ascontiguousarray(v).view(np.uint32)
    odd = np.random.default_rng(0).integers(0, 1 << 63, words.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    mark = np.zeros(len(v), np.uint64)
    for j in range(words.shape[1]):
        mark += words[:, j] * odd[j]
    order = np.lexsort((by_id, mark))
    cuts = np.flatnonzero(np.diff(mark[order])) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(v)]])
    for at in np.flatnonzero(ends - starts > k):
        same = order[starts[at]:ends[at]]
        if (words[same] == words[same[0]]).all():
            keep[same[k:]] = False
    return keep


def _hits(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what is true; little is, so eight are passed over at once."""
    flat = hit.ravel()
    whole = len(flat) - len(flat) % 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at, np.arange(whole, len(flat))])
    return np.divmod(at[flat[at]], hit.shape[1])


def _cell_best(units: np.ndarray, least: np.ndarray, v: np.ndarray, norm: np.ndarray, near: np.ndarray, by_id: np.ndarray, k: int, digits: int):
    """(question, row, score): for each of ``units`` the k best (ties by id) of the rows that score ``least`` or more. ``near``: ``v`` as
    directions in single precision, whose product is off by less than ``slack`` and only says which pairs to score."""
    slack = (units.shape[1] + 8) * 2.0 ** -23
    small = units.astype(np.float32)
    bar = (least - SCORE_SLACK - slack).astype(np.float32)
    q, r, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    new_q, new_r, waiting = [], [], 0

    def cut():
        nonlocal q, r, s, waiting
        cq, cr = np.concatenate([np.empty(0, np.int64), *new_q]), np.concatenate([np.empty(0, np.int64), *new_r])
        rows, of_row = np.unique(cr, return_inverse=True)
        order, cs = np.argsort(of_row, kind="stable"), np.empty(len(cr))
        ends = np.searchsorted(of_row, np.arange(0, len(rows) + TILE, TILE), sorter=order)
        for i, a, b in zip(range(0, len(rows), TILE), ends, ends[1:]):
            part, pairs = rows[i:i + TILE], order[a:b]
            cs[pairs] = (v[part].astype(np.float64) @ units.T)[of_row[pairs] - i, cq[pairs]] / norm[part][of_row[pairs] - i]
        cs = np.round(cs, digits)
        ok = cs >= least[cq] - SCORE_SLACK
        q, r, s = np.concatenate([q, cq[ok]]), np.concatenate([r, cr[ok]]), np.concatenate([s, cs[ok]])
        order = np.lexsort((by_id[r], -s, q))
        q, r, s = q[order], r[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        at_k = place == k - 1
        bar[q[at_k]] = np.maximum(bar[q[at_k]], (s[at_k] - SCORE_SLACK - slack).astype(np.float32))
        q, r, s = q[place < k], r[place < k], s[place < k]
        new_q.clear()
        new_r.clear()
        waiting = 0

    tile = TILE if least.min() >= -1.0 else FIRST_TILE
    for start in range(0, len(near), tile):
        part = near[start:start + tile]
        if not start or len(part) < tile:
            sims, hit = np.empty((len(small), len(part)), np.float32), np.empty((len(small), len(part)), bool)
        np.matmul(small, part.T, out=sims)
        np.greater_equal(sims, bar[:, None], out=hit)
        if len(part) > k and np.count_nonzero(hit) > OPEN_PAIRS * k * len(small):
            kth = np.partition(sims, len(part) - k, axis=1)[:, len(part) - k]  # k rows score this or more, but for the slack
            bar = np.maximum(bar, kth - np.float32(2 * slack + SCORE_SLACK))
            np.greater_equal(sims, bar[:, None], out=hit)
        found_q, found_r = _hits(hit)
        new_q.append(found_q)
        new_r.append(found_r + start)
        waiting += len(found_q)
        if waiting > MOST_PAIRS:
            cut()
    cut()
    return q, r, s


def _scorer(sent, width: int, k: int, digits: int, id_type, kind: str):
    """(pack, at, id, raw) of one cell: the k best (ties by id) for each question of its packs, among the blocks that the
    pack reads and whose bound allows it. ``asked``: the packs, ``held``: the blocks."""
    def work(asked, held):
        import pyarrow as pa
        import pyarrow.compute as pc

        number, centres = sent.value[:2]
        ids = pa.concat_arrays([c.flatten() for c in held["ids"].chunks]) if held.num_rows else None
        out = [[], [], [], []]
        if held.num_rows and asked.num_rows:
            v = np.concatenate([_rows(x, "<f4", width) for x in held["vectors"]])
            of_block = np.repeat(np.arange(held.num_rows), pc.list_value_length(held["ids"]).to_numpy())
            by_id = np.empty(len(v), np.int64)
            by_id[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(v))
            keep = np.flatnonzero(_first_copies(v, by_id, k))
            if len(keep) < len(v):
                v, of_block, by_id, ids = v[keep], of_block[keep], by_id[keep], ids.take(pa.array(keep))
            norm = np.linalg.norm(v.astype(np.float64), axis=1)
            near = (v / norm[:, None]).astype(np.float32)
            lo, hi, group = (held[c].to_numpy() for c in ("lo", "hi", "group"))
            numbers, of_group = np.unique(group, return_inverse=True)
            middle = centres[np.searchsorted(number, numbers)]
            for row in range(asked.num_rows):
                units = _units(_rows(asked["asked"][row], kind, width).astype(np.float64))[0]
                least = np.asarray(asked["least"][row].values.to_numpy(zero_copy_only=False), np.float64)
                angles = _angles(units, middle)[:, of_group]
                reach = np.arccos(np.clip(least - SCORE_SLACK, -1.0, 1.0)) + SLACK
                open_ = np.maximum(lo - angles, angles - hi) <= reach[:, None]
                open_ &= np.isin(group, asked["groups"][row].values.to_numpy())
                at, blocks = np.flatnonzero(open_.any(1)), open_.any(0)
                if not len(at):
                    continue
                if blocks.all():
                    q, r, s = _cell_best(units[at], least[at], v, norm, near, by_id, k, digits)
                else:
                    rows = np.flatnonzero(blocks[of_block])
                    q, r, s = _cell_best(units[at], least[at], v[rows], norm[rows], near[rows], by_id[rows], k, digits)
                    r = rows[r]
                for column, found in zip(out, (np.full(len(q), asked["pack"][row].as_py(), np.int64), at[q].astype(np.int32), r, s)):
                    column.append(found)
        pack, at, r, s = (np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, (np.int64, np.int32, np.int64, np.float64)))
        found = ids.take(pa.array(r)) if ids is not None else pa.array([], id_type)
        return pa.Table.from_arrays([pa.array(pack), pa.array(at), found, pa.array(s)], names=["pack", "at", "id", "raw"])
    return work


def _parts(sizes: list, most: int) -> list[tuple]:
    """(key, first, parts) for (key, size): parts of at most ``most``, numbered from 0; small neighbours share one, a large key has several."""
    out, part, held = [], 0, 0
    for key, size in sizes:
        wanted = math.ceil(size / most)
        if held and (wanted > 1 or held + size > most):
            part, held = part + 1, 0
        out.append((key, part, max(1, wanted)))
        if wanted > 1:
            part += wanted
        else:
            held += size
    return out


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("pack", "at").orderBy(F.desc("raw"), F.asc("id"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def routes(index: VectorIndex, packs: DataFrame, k: int, sent, kind: str) -> DataFrame:
    """(pack, group) still to read, written; ``packs`` has (pack, asked) for the first groups, and ``least`` for the others.
    ``kind``: the NumPy type of the numbers in ``asked``."""
    return materialise(packs.mapInArrow(_router(sent, index.width, k, "least" in packs.columns, kind), "pack bigint, group int"), "routes")


def read_groups(index: VectorIndex, route: DataFrame) -> DataFrame:
    """The blocks of the groups that some pack reads; the others are not read from the file."""
    wanted = [r.group for r in route.select("group").distinct().collect()]  # at most MAX_GROUPS numbers
    return index.blocks.where(F.col("group").isin(wanted))


def top_k(index: VectorIndex, questions: DataFrame, k: int, settings: Settings = DEFAULT) -> DataFrame:
    """(question_id, id, raw, rank) for ``questions`` (question_id, v): the k best scores at ``settings.rank_digits``, ties by id.
    A question whose vector is null, holds a null, has another width or no direction has no rows."""
    spark, width = questions.sparkSession, index.width
    bound_batches(spark)  # a pack with a block is hundreds of KB: rows alone would let a batch reach gigabytes
    meta = index.groups.orderBy("group").toArrow()
    centres = _matrix(meta["centre"].combine_chunks(), width) if meta.num_rows else np.zeros((0, width))
    number, lo, hi, size = (meta[c].to_numpy() for c in ("group", "lo", "hi", "size"))
    ids = index.blocks.schema["ids"].dataType.elementType
    number_type, kind = ("float", "<f4") if questions.schema["v"].dataType.simpleString() == "array<float>" else ("double", "<f8")
    asked = questions.select("question_id", F.col("v").cast(f"array<{number_type}>").alias("v")).where((F.size("v") == width) & ~F.exists("v", lambda x: x.isNull()))
    if not len(centres):
        return asked.select("question_id", F.lit(None).cast(ids).alias("id"), F.lit(0.0).alias("raw"), F.lit(1).alias("rank")).limit(0)
    sent = spark.sparkContext.broadcast((number, centres, lo, hi, size))
    near = asked.mapInArrow(_pack_nearest(spark.sparkContext.broadcast(centres), width), f"near int, question_id string, v array<{number_type}>")
    near = materialise(near, "asked")
    asked_at = [tuple(r) for r in near.groupBy("near").count().orderBy("near").collect()]  # at most MAX_GROUPS rows
    bundles = spark.createDataFrame(_parts(asked_at, max(PACK, CELL_BYTES // (np.dtype(kind).itemsize * width))), "near int, first int, parts int")
    # A near group's questions are dealt only as far as there are many, so that a pack has few near groups.
    deals = spark.createDataFrame([(at, math.ceil(n / (DEAL_PACKS * PACK))) for at, n in asked_at], "near int, deals int")
    dealt = near.join(deals, "near").select("near", "question_id", "v", F.pmod(F.xxhash64("question_id"), F.col("deals")).alias("deal"))
    packs = materialise(dealt.repartition("near", "deal").drop("deal").sortWithinPartitions("near", "question_id")
                        .mapInArrow(_question_packer(PACK), "pack bigint, near int, question_ids array<string>, asked binary"), "packs")
    floor = -2.0 if settings.score_min is None else float(settings.score_min)

    slices = spark.createDataFrame(_parts(list(zip(number.tolist(), size.tolist())), max(1, min(SUB_BLOCKS * BLOCK, CELL_BYTES // (4 * width)))),
                                   "group int, first int, parts int")
    packs = packs.join(bundles, "near").withColumn("bundle", (F.col("first") + F.pmod(F.xxhash64("pack"), F.col("parts"))).cast("int")).drop("near", "first", "parts")
    cell = ["slice", "bundle"]

    def scored(packs_with_least: DataFrame, route: DataFrame) -> DataFrame:
        at = route.join(slices, "group").select("pack", "group", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("slice"))
        at = at.groupBy("pack", "slice").agg(F.collect_list("group").alias("groups"))
        parts = at.join(packs_with_least, "pack").select(*cell, "pack", "asked", "least", "groups")
        cells = at.join(packs.select("pack", "bundle"), "pack").select(*cell).distinct().toDF(*cell)
        blocks = read_groups(index, route).join(slices, "group").withColumn("slice", (F.col("first") + F.pmod(F.xxhash64("block"), F.col("parts"))).cast("int"))
        blocks = blocks.join(cells, "slice").select(*cell, "group", "lo", "hi", "ids", "vectors")
        return parts.groupBy(*cell).cogroup(blocks.groupBy(*cell)).applyInArrow(
            _scorer(sent, width, k, settings.rank_digits, to_arrow_type(ids), kind), f"pack bigint, at int, id {ids.simpleString()}, raw double")

    start = packs.select("pack", "bundle", "asked", F.transform("question_ids", lambda _: F.lit(floor)).alias("least"))
    first = materialise(_ranked(scored(start, routes(index, packs.select("pack", "asked"), k, sent, kind)), k), "first")
    kth = first.where(F.col("rank") == k).groupBy("pack").agg(F.map_from_entries(F.collect_list(F.struct("at", "raw"))).alias("kth"))
    least = F.transform("question_ids", lambda _, i: F.greatest(F.coalesce(F.try_element_at("kth", i), F.lit(floor)), F.lit(floor)))
    bounded = packs.join(kth, "pack", "left").select("pack", "bundle", "asked", F.coalesce(least, F.transform("question_ids", lambda _: F.lit(floor))).alias("least"))
    rest = scored(bounded, routes(index, bounded.select("pack", "asked", "least"), k, sent, kind))
    both = _ranked(first.drop("rank").unionByName(rest), k).where(F.col("raw") >= floor)
    named = packs.select("pack", F.posexplode("question_ids").alias("at", "question_id"))
    return both.join(named, ["pack", "at"]).select("question_id", "id", "raw", "rank")
