"""Operator 5: near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct word shingles (with fewer words than a
shingle has, the whole sequence as one), words being lower-cased (A-Z) runs of
non-space characters. Two documents are linked if 100 * |A and B| >=
``percent`` * |A or B|; components of links share the smallest id.

Tensored banding: instead of separate min-hashes for every table, two
collections of ``BANDS`` hashes of ``ROWS`` min-hashes each are computed, and
each pair (one from either) is the key of one of ``BANDS`` ** 2 tables. So 72
min-hashes give 144 tables of six: at similarity 0.8 a pair shares no table
with a chance of 0.0004, at 0.9 of 3e-7.

1. Equal sets are collapsed to one class, which goes by a number of its own and is read by
   one of its rows (found by two 64-bit hashes), however many rows share an id.
2. In each table bucket, every class is paired with the bucket's smallest (a
   star, never all pairs), and pairs are confirmed on their full sets.
3. Components of the confirmed links.
4. Where a pair was not confirmed and its ends are still apart, other members
   of those buckets may yet be linked. All links among them are found exactly,
   by a join on prefixes of their sets (rarest shingles first) that keeps
   pairs in different components that sizes and positions allow.

Nothing is capped, and nothing that follows the corpus reaches the driver.

Defined results: a text that is null or has no words has an empty set (0
shingles) and is linked with nothing; rows that share an id are one document,
linked to whatever any of them is linked to (``near_duplicates``); a null id counts
as the smallest and is returned as null. ``representatives`` looks at texts alone:
there rows that share an id, null or not, have nothing to do with each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from aerolens.session import scratch_path

from .common import bound_batches, map_texts

WIDTH, PERCENT = 5, 80
BANDS, ROWS = 12, 3
SEED = 20
#: Rows named to all tasks to pick their texts (24 bytes each); above, the texts are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
MEMO = 200_000
_NULL_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler(dict):
    """text -> sorted distinct 64-bit hashes of its shingles. Remembers the hashes of words."""

    def __init__(self, width: int):
        import xxhash

        super().__init__()
        self.width, self.hash = width, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = self.hash(word)
        return h

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space splits
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, n)
        width = min(n, self.width)
        out = np.full(n - width + 1, width, np.uint64)
        for j in range(width):
            out = _mix(out + h[j:n - width + 1 + j])
        return np.unique(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(id, r1, r2, n, k1, k2, a, b) a row: set size, a 128-bit name of the set, the two collections."""
    def factory():
        shingle = Shingler(width)
        rng = np.random.default_rng(SEED)
        size = 2 * BANDS * ROWS
        times = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        plus = rng.integers(0, 1 << 63, size, dtype=np.uint64)

        def fn(texts):
            sets = [shingle(t) for t in texts]
            n = np.array([len(s) for s in sets])
            some = np.flatnonzero(n)
            names = np.zeros((2, len(sets)), np.uint64)
            bands = np.zeros((len(sets), 2 * BANDS), np.uint64)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                start = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                names[0, some] = np.add.reduceat(_mix(flat + np.uint64(1)), start)
                names[1, some] = np.add.reduceat(_mix(flat + np.uint64(2)), start)
                for band in range(2 * BANDS):
                    key = np.full(len(some), band, np.uint64)
                    for i in range(band * ROWS, (band + 1) * ROWS):
                        x = flat * times[i] + plus[i]
                        key = _mix(key + np.minimum.reduceat(x ^ (x >> np.uint64(32)), start))
                    bands[some, band] = key
            names, bands = names.view(np.int64), bands.view(np.int64)
            return [n.tolist(), names[0].tolist(), names[1].tolist(), bands[:, :BANDS].tolist(), bands[:, BANDS:].tolist()]
        return fn

    return map_texts(docs, "text", "n bigint, k1 bigint, k2 bigint, a array<bigint>, b array<bigint>", factory).drop("text")


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, rep): one row for each class and pair of bands."""
    return (classes.select("rep", F.posexplode("a").alias("i", "x"), "b")
            .select("rep", "i", "x", F.posexplode("b").alias("j", "y"))
            .select(F.xxhash64("i", "j", "x", "y").alias("key"), "rep"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _texts(docs: DataFrame, reps: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, texts): one text of each class in ``reps`` (id, repeated or not), as an array; ``docs``: (r1, r2, text)."""
    side = _written(classes.select(F.col("rep").alias("id"), "r1", "r2").join(reps.distinct(), "id"), "near-rows")
    side = F.broadcast(side) if side.count() <= MAX_BROADCAST_IDS else side
    return docs.join(side, ["r1", "r2"]).groupBy("id").agg(F.collect_set("text").alias("texts"))


def confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` with a text of a and one of b similar enough, on their full sets."""
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), classes)
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("texts").alias("ta")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("texts").alias("tb")), "b").select("a", "b", "ta", "tb"))

    def work(batches):
        shingle, known = Shingler(width), {}

        def sets(texts):
            key = tuple(texts)
            found = known.get(key)
            if found is None:
                if len(known) >= 64:
                    known.clear()
                found = known[key] = [shingle(t) for t in texts]
            return found

        for batch in batches:
            ok = [any(linked(x, y, percent) for x in sets(ta) for y in sets(tb))
                  for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(work, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every node of the edges (a, b), a written table, the smallest node it reaches.

    Each round hangs every node below its smallest neighbour, follows those links a few steps,
    and contracts the edges; each round is written, so lineage stays short. The only shuffle that a round cannot do
    without is that of its edges to their nodes; repeated edges do no harm, so none are looked for."""
    edges = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo")
    nodes = None
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct("hi", "lo"), F.struct(F.col("lo").alias("hi"), "lo"))).alias("end")).select("end.*")
        up = _written(ends.groupBy("hi").agg(F.min("lo").alias("up")), "near-up")
        for _ in range(2):
            above = up.select(F.col("hi").alias("up"), F.col("up").alias("next"))
            up = _written(up.join(above, "up").select("hi", F.col("next").alias("up")), "near-up")

        def lift(df, column):
            m = up.select(F.col("hi").alias(column), F.col("up").alias("_up"))
            return df.join(m, column, "left").withColumn(column, F.coalesce("_up", column)).drop("_up")
        moved = lift(lift(edges, "hi"), "lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
        edges = _written(moved.where("hi <> lo"), "near-edges")
        # The first round's table holds every node.
        nodes = up.select(F.col("hi").alias("id"), F.col("up").alias("component")) if nodes is None else \
            _written(lift(nodes, "component").select("id", "component"), "near-nodes")
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")) if nodes is None else nodes


def families(across: DataFrame, comp: DataFrame) -> DataFrame:
    """(component, family): the largest component (ties: the largest number) among each one of ``across`` (c1, c2) and its neighbours."""
    pair = lambda x, y: F.struct(F.col(x).alias("component"), F.col(y).alias("other"))
    beside = across.select(F.explode(F.array(pair("c1", "c2"), pair("c2", "c1"), pair("c1", "c1"), pair("c2", "c2"))).alias("p")).select("p.*").distinct()
    sizes = comp.groupBy(F.col("component").alias("other")).agg(F.count("*").alias("members"))
    return beside.join(sizes, "other").groupBy("component").agg(F.max(F.struct("members", "other"))["other"].alias("family"))


def _joined(marks: DataFrame, percent: int) -> DataFrame:
    """(a, b), some repeated: ids in different components, and with another ``apart``, whose marks of one field may have the overlap that
    their h ask for: 2 * (100 + percent) * overlap >= hx + hy > 0. ``marks``: (field, mark, id, part, component, apart, n, h, size, least),
    ``least`` being the smallest overlap that a partner may ask for. Prefix, size and position filters."""
    often = marks.groupBy("field", "mark").agg(F.count("*").alias("often"), (F.min("apart") != F.max("apart")).alias("shared"))
    # A mark within one family (component) only cannot be common to a pair across two: it ranks first and is not joined.
    order = Window.partitionBy("field", "id", "part").orderBy(F.when(F.col("shared"), F.col("often")).otherwise(0), "mark")
    prefix = (marks.join(often, ["field", "mark"]).withColumn("at", F.row_number().over(order))
              .where(F.col("shared") & (F.col("at") <= F.col("size") - F.col("least") + 1)).select("field", "mark", "id", "component", "apart", "n", "h", "size", "at"))
    prefix = _written(prefix, "near-prefix")
    x, y = (prefix.select("field", "mark", *[F.col(k).alias(f"{k}{s}") for k in ("id", "component", "apart", "n", "h", "size", "at")]) for s in "xy")
    need, room = F.col("hx") + F.col("hy"), 1 + F.least(F.col("sizex") - F.col("atx"), F.col("sizey") - F.col("aty"))
    allowed = ((F.col("componentx") < F.col("componenty")) & (F.col("apartx") != F.col("aparty")) & (need > 0)
               & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & (2 * (100 + percent) * room >= need))
    return x.join(y, ["field", "mark"]).where(allowed).select(F.col("idx").alias("a"), F.col("idy").alias("b"))


def _within_families(sets: DataFrame, tokens: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """For pairs of a family that may be linked although in different components: (a, b) of some of them, and marks to find the others by.

    Let c be the shingles that most sets of the family hold, x lack dx of them and have others. Then |x and y| = |c| - dx - dy
    + what the two lack or add alike. So sets are joined on what tells them from c, and those that are far from it must share much of that:
    2 * (100 + percent) * shared >= hx + hy with h = 2 * percent * n + 2 * (100 + percent) * d - (100 + percent) * |c|. Where
    hx + hy <= 0 a pair is linked anyway, then both are linked to the family's set of smallest h too, and are paired with that one alone."""
    mixed = sets.groupBy("family").agg((F.min("component") != F.max("component")).alias("mixed"), F.count("*").alias("sets")).where("mixed")
    mixed = _written(mixed.select("family", "sets"), "near-families")
    held = tokens.join(mixed, "family")
    base = held.groupBy("family", "token").agg(F.count("*").alias("held"), F.first("sets").alias("sets")).where("2 * held > sets")
    base = _written(base.groupBy("family").agg(F.collect_list("token").alias("base")), "near-bases")
    apart = (sets.join(mixed.select("family"), "family").join(base, "family", "left").withColumn("base", F.coalesce("base", F.array().cast("array<bigint>")))
             .withColumn("lacks", F.array_except("base", "tokens")).withColumn("adds", F.array_except("tokens", "base")))
    both, n = 100 + percent, F.size("tokens")
    apart = _written(apart.select("id", "part", "component", "family", n.alias("n"), F.concat("lacks", "adds").alias("marks"),
                                  (2 * percent * n + 2 * both * F.size("lacks") - both * F.size("base")).cast("bigint").alias("h")), "near-apart")
    centre = _written(apart.groupBy("family").agg(F.min(F.struct("h", "id", "component")).alias("centre")), "near-centres")
    apart = apart.join(centre, "family")
    near = apart.where((F.col("h") + F.col("centre.h") <= 0) & (F.col("component") != F.col("centre.component")))
    near = near.select(F.col("id").alias("a"), F.col("centre.id").alias("b"))
    least = F.greatest(F.lit(1), F.ceil((F.col("h") + F.col("centre.h")) / (2 * both)))
    return near, apart.select(F.col("family").alias("field"), "id", "part", "component", F.col("component").alias("apart"), "n", "h",
                              F.size("marks").alias("size"), least.alias("least"), F.explode("marks").alias("mark"))


def open_pairs(docs: DataFrame, classes: DataFrame, stars: DataFrame, comp: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): pairs that may be linked although in different components, among all members of the
    buckets that hold an unconfirmed pair across components: enough to find every component. Within a family
    (a component and the smaller ones that meet it in a bucket) pairs are found by what tells sets from the family's
    common shingles, across families by their shingles."""
    c = comp.select("id", "component")
    across = (stars.join(c.withColumnsRenamed({"id": "rep", "component": "c1"}), "rep")
              .join(c.withColumnsRenamed({"id": "lead", "component": "c2"}), "lead").where("c1 <> c2"))
    across = _written(across.select("lead", "c1", "c2"), "near-open")
    some = stars.join(across.select("lead").distinct(), "lead").select(F.explode(F.array("rep", "lead")).alias("id"))
    family = _written(families(across, comp), "near-family")

    def factory():
        shingle = Shingler(width)
        return lambda texts: [[s.view(np.int64).tolist() for s in map(shingle, texts)]]
    texts = _texts(docs, some, classes).select("id", F.posexplode("texts").alias("part", "text"))
    sets = map_texts(texts, "text", "tokens array<bigint>", factory).select("id", "part", "tokens")
    sets = sets.join(c, "id").join(family, "component", "left").withColumn("family", F.coalesce("family", "component"))
    sets = _written(sets, "near-sets")
    n = F.size("tokens")
    # Families are numbers of classes, so -1 is none of them: the field where sets of different families meet by their shingles.
    marks = sets.select(F.lit(-1).cast("bigint").alias("field"), "id", "part", "component", F.col("family").alias("apart"), n.alias("n"), n.alias("size"),
                        (2 * percent * n).cast("bigint").alias("h"), F.ceil(n * percent / 100).alias("least"), F.explode("tokens").alias("mark"))
    near, within = _within_families(sets, sets.select("family", F.explode("tokens").alias("token")), percent)
    return near.unionByName(_joined(marks.unionByName(within), percent)).distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows as (r1, r2, text); their signatures; and (k1, k2, rep, first, r1, r2, rows, a, b) a class of equal sets: its
    number, smallest id, the row that stands for it and how many rows are equal to that one."""
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(_NULL_ID)).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumns(row_name(F.col("id"), F.col("text")))
    sig = _written(signatures(rows, width), "near-signatures")
    least = F.min(F.struct("id", "r1", "r2")).alias("least")
    classes = sig.where("n > 0").groupBy("k1", "k2").agg(least, F.first("a").alias("a"), F.first("b").alias("b"))
    # The numbers are those of the written table, so they are read alike from then on.
    classes = _written(classes.select("k1", "k2", F.monotonically_increasing_id().alias("rep"), F.col("least.id").alias("first"),
                                      F.col("least.r1").alias("r1"), F.col("least.r2").alias("r2"), "a", "b"), "near-classes")
    return rows.select("r1", "r2", "text"), sig, classes


def row_name(doc_id: Column, text: Column) -> dict[str, Column]:
    """Two hashes that tell rows with other ids or texts apart."""
    return {"r1": F.xxhash64(doc_id, text), "r2": F.xxhash64(text, doc_id, F.lit(1))}


def _linked_classes(texts: DataFrame, classes: DataFrame, ties: DataFrame | None, width: int, percent: int) -> DataFrame:
    """(rep, component, first): every class, the number of its component and its smallest id."""
    keys = table_keys(classes)
    lead = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").drop("last")
    stars = _written(keys.join(lead, "key").where("rep <> lead").select("rep", "lead").distinct(), "near-stars")
    links = confirm(texts, classes, stars.select(F.col("rep").alias("a"), F.col("lead").alias("b")), width, percent)
    links = _written(links if ties is None else links.unionByName(ties), "near-links")

    def of_class(comp):
        return _written(classes.select(F.col("rep").alias("id"), "first").join(comp, "id", "left")
                        .select("id", F.coalesce("component", "id").alias("component"), "first"), "near-class-components")
    comp = of_class(components(links))
    more = _written(confirm(texts, classes, _written(open_pairs(texts, classes, stars, comp, width, percent), "near-open-pairs"), width, percent), "near-more-links")
    if not more.isEmpty():
        # These links join components, so only those are gone through again.
        ends = [comp.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
        joins = _written(more.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")), "near-joins")
        joined = components(joins).withColumnsRenamed({"component": "all", "id": "component"})
        comp = _written(comp.join(joined, "component", "left").select("id", F.coalesce("all", "component").alias("component"), "first"), "near-joined")
    return comp.withColumnRenamed("id", "rep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component, kept) for every row: kept where the id is its component's smallest."""
    texts, sig, classes = _classes(docs, id_col, text_col, width)
    named = _written(sig.join(classes.select("k1", "k2", "rep"), ["k1", "k2"], "left").select("id", "n", "rep"), "near-named")
    # An id whose rows fall into several classes ties those together.
    spread = named.where("rep IS NOT NULL").groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    ties = named.join(_written(spread, "near-spread"), "id").where("rep > low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    comp = _linked_classes(texts, classes, ties, width, percent)
    least = comp.groupBy("component").agg(F.min("first").alias("least"))
    by_class = _written(comp.join(least, "component").select("rep", "least"), "near-least")
    some = named.join(by_class, "rep").select("id", "n", "least")
    # Rows without words: their id may have other rows.
    none = named.where("rep IS NULL").select("id", "n")
    other = some.join(none.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("least").alias("least"))
    none = none.join(other, "id", "left").select("id", "n", F.coalesce("least", "id").alias("least"))
    real = {c: F.when(F.col(c) != _NULL_ID, F.col(c)) for c in ("id", "least")}
    return some.unionByName(none).select(real["id"].alias("id"), F.col("n").alias("n_shingles"), real["least"].alias("component"),
                                         (F.col("id") == F.col("least")).alias("kept"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(r1, r2, rows): the name (``row_name``) of the one row that stands for each group of near-duplicate texts, and how many rows have
    that name, being equal in id and text. It is the row with the group's smallest id. Rows without words stand for themselves."""
    texts, sig, classes = _classes(docs, id_col, text_col, width)
    comp = _linked_classes(texts, classes, None, width, percent).join(classes.select("rep", "r1", "r2"), "rep")
    best = comp.groupBy("component").agg(F.min(F.struct("first", "r1", "r2")).alias("best")).select("best.r1", "best.r2")
    equal = sig.join(best, ["r1", "r2"], "left_semi").groupBy("r1", "r2").agg(F.count("*").alias("rows"))
    return equal.unionByName(sig.where("n = 0").groupBy("r1", "r2").agg(F.lit(1).cast("bigint").alias("rows")))
