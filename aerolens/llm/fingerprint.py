"""Operator 1: document fingerprints (bottom-k sketches of shingle hashes).

A text's shingles are its runs of five words (a shorter text is one shingle of
all its words). Each is hashed with MD5, cut to 16 hex digits, and the sketch
is the sorted list of the ``k`` smallest distinct hashes. Two sketches merge by
taking the ``k`` smallest of their union, so sketches of parts give the sketch
of the whole. All of it is Column expressions: no shuffle to sketch a table.

Defined results: a null or empty text, or one without words, has the empty
sketch; two empty sketches resemble each other fully (1.0), an empty one and
another not at all (0.0); a sketch shorter than ``k`` holds every shingle, so
its estimates are exact. Repeated rows are sketched one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import hex_fraction, let, words

K = 128
SHINGLE = 5
#: At most so many ranges of ids are laid out to find each document's successor.
MAX_RANGES = 4096
ROWS_PER_RANGE = 20_000
_FIRST = -(1 << 63)


def sketch(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    """Sorted array of the ``k`` smallest distinct shingle hashes."""
    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1)))
        one = F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, width), " ")), 1, 16))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(
            F.slice(F.sort_array(F.array_distinct(one)), 1, k))
    return let(words(text), hashes)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's bottom-k in both."""
    both = let(merge(a, b, k), lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both.cast("double"))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else (k-1) / k-th hash."""
    kth = hex_fraction(F.element_at(s, k))
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(float(k - 1)) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has, from resemblance and counts
    (an empty ``a`` is contained in everything)."""
    na, nb, j = distinct_shingles(a, k), distinct_shingles(b, k), resemblance(a, b, k)
    share = j * (na + nb) / ((F.lit(1.0) + j) * na)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def merge_by(sketches: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch per group. Hashes are made distinct per group before they are
    ranked, and Spark keeps only ``k`` a group in every task before the shuffle,
    so a group with a third of all rows sends ``k`` hashes a task."""
    one = sketches.select(*keys, F.explode_outer(column).alias("_h")).distinct()
    w = Window.partitionBy(*keys).orderBy(F.col("_h").asc_nulls_last())
    low = one.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return low.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))


def with_next(docs: DataFrame, id_col: str, text_col: str, keep: list[Column]) -> tuple[DataFrame, Window]:
    """Rows of (``keep``, ``text``) laid out by ascending id so that ``lead`` over the
    returned window reaches the next row (after the last: the first).

    Ids are cut into ranges at approximate quantiles. The first row of each
    range is copied to the end of the range before it (``_halo`` = 1), so no
    window spans ranges. A null id comes first; equal ids go by text.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_FIRST))
    n = docs.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(MAX_RANGES, n, max(4 * parts, n // ROWS_PER_RANGE)))
    cut = [i / ranges for i in range(1, ranges)] or [0.5]
    least, marks = docs.agg(F.min(key), F.percentile_approx(key, cut, 10 * MAX_RANGES)).first()
    bounds = sorted({least, *marks}) if n else [0]
    last = len(bounds) - 1
    marks = F.array(*[F.lit(b) for b in bounds])
    rng = F.size(F.filter(marks, lambda b: b <= F.col("_key"))) - 1
    own = F.struct(F.col("_own").alias("range"), F.lit(0).alias("halo"))
    before = F.struct(F.when(F.col("_own") == 0, last).otherwise(F.col("_own") - 1).alias("range"), F.lit(1).alias("halo"))
    rows = (docs.select(key.alias("_key"), F.col(text_col).alias("text"), *keep)
            .withColumn("_own", rng)
            .withColumn("_at", F.explode(F.when(F.element_at(marks, F.col("_own") + 1) == F.col("_key"),
                                                F.array(own, before)).otherwise(F.array(own))))
            .withColumns({"_range": F.col("_at.range"), "_halo": F.col("_at.halo")}).drop("_at", "_own"))
    order = Window.partitionBy("_range").orderBy("_halo", "_key", F.col("text").asc_nulls_first())
    return rows, order


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Sketches of every text, of its edited text (the last half of its code points
    replaced by the first as many of the next document's, or all it has), and
    their likeness. One row per input row:
    (doc_id, n_chars, edited, sketch, edited_sketch, near_edited, near_next)."""
    rows, order = with_next(docs, id_col, text_col, [F.col(id_col).alias("doc_id")])
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.withColumn("_next", F.coalesce(F.lead("text").over(order), F.lit("")))
    # ``order`` sorts by text, so the text stays until the second window has run.
    cut = F.floor(F.col("n_chars") / 2).cast("int")
    rows = (rows.withColumn("n_chars", F.length(text).cast("bigint"))
            .withColumn("edited", F.concat(text.substr(F.lit(1), (F.col("n_chars") - cut).cast("int")),
                                           F.col("_next").substr(F.lit(1), cut)))
            .drop("_next")
            .withColumn("sketch", sketch(F.col("text"), k))
            .withColumn("_next_sketch", F.lead("sketch").over(order))
            .where(F.col("_halo") == 0)
            .withColumn("edited_sketch", sketch(F.col("edited"), k)))
    return rows.select("doc_id", "n_chars", "edited", "sketch", "edited_sketch",
                       resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
                       resemblance(F.col("sketch"), F.col("_next_sketch"), k).alias("near_next"))
