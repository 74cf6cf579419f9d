"""Descriptive aggregates (G1-G3, G9-G13, T5, T6) and exact global quantiles.

Per-group top-n uses ``row_number() <= n``: Spark places a partial
WindowGroupLimit before the shuffle, so a hot group sends at most n rows per
map partition. Global statistics never gather a column in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from ..settings import DEFAULT, Settings

FACETS = (("cause_category", 10), ("flight_phase", 10), ("risk_level", None))


def _key(group_cols):
    return list(group_cols) if group_cols else []


def facet_counts(df: DataFrame, specs=FACETS, group_cols=(), fill: str = "NA") -> DataFrame:
    """G1: value frequencies per facet (null -> "NA"), ranked by count then value.

    Columns: group columns, ``facet``, ``value``, ``n``, ``rank``. A facet whose
    column is absent gives no rows (an empty table).
    """
    g = _key(group_cols)
    present = [(c, lim) for c, lim in specs if c in df.columns]
    if not present:
        return df.select(*g, F.lit("").alias("facet"), F.lit("").alias("value"), F.lit(0).cast("long").alias("n"),
                         F.lit(0).alias("rank")).where(F.lit(False))
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias("value"))
                      for c, _ in present])
    counts = (df.select(*g, F.inline(pairs)).groupBy(*g, "facet", "value").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(*g, "facet").orderBy(F.desc("n"), F.asc("value"))

    def ranked(facets, lim):
        # A condition on the rank alone lets Spark keep the best ``lim`` of each task before the shuffle.
        part = counts.where(F.col("facet").isin(*facets)).withColumn("rank", F.row_number().over(w))
        return part if lim is None else part.where(F.col("rank") <= lim)

    by_limit: dict = {}
    for c, lim in present:
        by_limit.setdefault(lim, []).append(c)
    if len(by_limit) > 1:
        counts = materialise(counts, "facets")  # post-aggregation, read once per limit
    out = [ranked(facets, lim) for lim, facets in by_limit.items()]
    for part in out[1:]:
        out[0] = out[0].unionByName(part)
    return out[0]


def facet_strings(counts: DataFrame, group_cols=()) -> DataFrame:
    """One row per group: ``by_cause``/``by_phase``/``risk`` as ``value:count, ...`` text in
    rank order, plus the top value and count of each facet."""
    g = _key(group_cols)
    item = F.struct("rank", F.concat(F.col("value"), F.lit(":"), F.col("n").cast("string")).alias("s"),
                    "value", "n")
    per = counts.groupBy(*g, "facet").agg(F.array_sort(F.collect_list(item)).alias("items"))
    per = per.select(*g, "facet", F.array_join(F.transform("items", lambda x: x["s"]), ", ").alias("text"),
                     F.element_at("items", 1)["value"].alias("top_value"), F.element_at("items", 1)["n"].alias("top_n"))
    out = per.groupBy(*g).pivot("facet", ["cause_category", "flight_phase", "risk_level"]).agg(
        F.first("text").alias("text"), F.first("top_value").alias("top_value"), F.first("top_n").alias("top_n"))
    ren = {"cause_category": "cause", "flight_phase": "phase", "risk_level": "risk"}
    for src, dst in ren.items():
        out = (out.withColumnRenamed(f"{src}_text", f"by_{dst}").withColumnRenamed(f"{src}_top_value", f"top_{dst}")
               .withColumnRenamed(f"{src}_top_n", f"top_{dst}_n"))
    return out


def exact_quantile(df: DataFrame, col: str, q: float = 0.5, settings: Settings = DEFAULT,
                   materialize: bool = True) -> float | None:
    """G2 (global form): the exact q-quantile of one column; see ``exact_quantiles``."""
    return exact_quantiles(df, [col], q, settings, materialize)[col]


#: Parts into which each round of ``exact_quantiles`` cuts a value range.
QUANTILE_PARTS = 2048
_HUGE = 1.7976931348623157e308


def exact_quantiles(df: DataFrame, cols, q: float = 0.5, settings: Settings = DEFAULT,
                    materialize: bool = True) -> dict:
    """Exact q-quantiles of several columns with linear interpolation (NumPy's
    default; the median averages the two middle values). Nulls and NaN ignored;
    a column without values gives None.

    Distributed selection, all columns in the same passes: each round cuts the
    range that holds a wanted rank into ``QUANTILE_PARTS`` equal parts, counts the
    rows of each part with its least and greatest value, and goes on with the part
    that holds the rank, until that part holds one value. Only those counts reach
    the driver, a fixed number a round however many rows or ties there are.
    """
    cols = list(cols)
    base = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols])
    if materialize:
        # Several passes follow: write the projected columns once.
        base = materialise(base, "quantiles")
    # Infinities take part as the greatest finite numbers.
    base = base.select(*[F.when(F.col(c).isNotNull(), F.greatest(F.lit(-_HUGE), F.least(F.lit(_HUGE), F.col(c)))).alias(c) for c in cols])
    ends = base.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols)
                      for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    wanted = {}  # (column, rank) -> [lo, hi, rows below lo]
    for i, c in enumerate(cols):
        pos = q * (ends[f"n{i}"] - 1)
        for k in {math.floor(pos), math.ceil(pos)} if ends[f"n{i}"] else ():
            wanted[c, k] = [ends[f"lo{i}"], ends[f"hi{i}"], 0]
    while True:
        open_ = sorted({(c, lo, hi) for (c, _), (lo, hi, _b) in wanted.items() if lo < hi})
        if not open_:
            break
        # Halves keep the width finite for any two doubles.
        part = lambda c, lo, hi: F.least(F.lit(QUANTILE_PARTS - 1), F.floor(
            (F.col(c) / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2 or 5e-324) * QUANTILE_PARTS)).cast("int")
        rows = F.array(*[F.when((F.col(c) >= F.lit(lo)) & (F.col(c) <= F.lit(hi)),
                                F.struct(F.lit(s).alias("s"), part(c, lo, hi).alias("p"), F.col(c).alias("v")))
                         for s, (c, lo, hi) in enumerate(open_)])
        counts = (base.select(F.inline(F.array_compact(rows))).groupBy("s", "p")
                  .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("s", "lo").collect())
        for (c, k), state in wanted.items():
            if (c, state[0], state[1]) in open_:
                s, below = open_.index((c, state[0], state[1])), state[2]
                for r in (r for r in counts if r.s == s):
                    if k < below + r.n:
                        wanted[c, k] = [r.lo, r.hi, below]
                        break
                    below += r.n
    out = {c: None for c in cols}
    for i, c in enumerate(cols):
        if not ends[f"n{i}"]:
            continue
        pos = q * (ends[f"n{i}"] - 1)
        a, b = (math.copysign(math.inf, v) if abs(v) == _HUGE else v for v in (wanted[c, math.floor(pos)][0], wanted[c, math.ceil(pos)][0]))
        t = pos - math.floor(pos)
        if a == b:
            out[c] = a
        elif q == 0.5:
            out[c] = (a + b) / 2.0
        else:
            out[c] = a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)
    return out


#: Size parameter of a quantile sketch.
SKETCH_K = 1024


def sketch_error(k: int = SKETCH_K) -> float:
    """Normalised rank error that a KLL quantile sketch of parameter ``k`` keeps with 99 % confidence (Karnin, Lang and
    Liberty, 2016; constants of the public DataSketches library): 0.44 % for 1,024."""
    return 2.296 / k ** 0.9021


def quantile_sketches(df: DataFrame, col: str, group_cols=(), k: int = SKETCH_K) -> DataFrame:
    """G2 on request, approximate: per group (none: all rows) ``n`` values and their mergeable quantile ``sketch``, a few kilobytes however
    many rows there are. Nulls and NaN are left out; sketches of parts, days or namespaces can be stored and merged."""
    x = F.col(col).cast("double")
    x = F.when(~F.isnan(x), x)
    return df.groupBy(*group_cols).agg(F.count(x).alias("n"), F.kll_sketch_agg_double(x, k).alias("sketch"))


def merge_sketches(sketches: DataFrame, group_cols=(), k: int = SKETCH_K) -> DataFrame:
    """Sketches of parts as one per group."""
    return sketches.where("n > 0").groupBy(*group_cols).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantile(sketches: DataFrame, q: float = 0.5, out: str = "median") -> DataFrame:
    """The ``q``-quantile that each sketch estimates (null where there are no values), instead of the sketch."""
    value = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))))
    return sketches.withColumn(out, value).drop("sketch")


def group_median(df: DataFrame, col: str, group_cols) -> DataFrame:
    """G2 (per group): exact median per bounded group (e.g. top-k rows of a question)."""
    return df.groupBy(*group_cols).agg(F.median(F.col(col).cast("double")).alias(f"median_{col}"))


def ask_stats(df: DataFrame, group_col: str = "question_id", miss_col: str = "miss_distance_num") -> DataFrame:
    """Per group: row count, median miss distance, facet texts and top values."""
    base = df.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("count"),
        F.median(F.when(~F.isnan(F.col(miss_col)), F.col(miss_col))).alias("median_miss_distance"))
    facets = facet_strings(facet_counts(df, group_cols=[group_col]), [group_col])
    return base.join(facets, group_col, "left")


def spike_factor(df: DataFrame, group_col: str, month_col: str = "month") -> DataFrame:
    """Last month's count / mean of the earlier months, when a group has >= 4
    months. Only months present count; null months are ignored."""
    mc = df.where(F.col(month_col).isNotNull()).groupBy(group_col, month_col).agg(F.count(F.lit(1)).alias("cnt"))
    g = mc.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("months"), F.sum("cnt").alias("total"),
        F.max(month_col).alias("last_month"), F.max_by("cnt", month_col).alias("last_count"))
    prev = (F.col("total") - F.col("last_count")).cast("double") / (F.col("months") - 1)
    return g.withColumn("prev_avg", F.when(F.col("months") > 1, prev)).withColumn(
        "spike_factor", F.when((F.col("months") >= 4) & (F.col("prev_avg") > 0),
                               F.col("last_count") / F.col("prev_avg")))


def top_values(df: DataFrame, group_col: str, col: str, n: int = 3, fill: str = "NA",
               out: str | None = None) -> DataFrame:
    """``value:count`` of the n most frequent values per group, comma joined."""
    out = out or f"top_{col}"
    v = F.coalesce(F.col(col).cast("string"), F.lit(fill)) if col in df.columns else F.lit(fill)
    counts = df.select(group_col, v.alias("_v")).groupBy(group_col, "_v").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group_col).orderBy(F.desc("_n"), F.asc("_v"))
    top = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    item = F.struct("_r", F.concat(F.col("_v"), F.lit(":"), F.col("_n").cast("string")).alias("s"))
    return top.groupBy(group_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), ", ").alias(out))


def temporal_confidence(df: DataFrame, month_col: str = "month") -> DataFrame:
    """Share of rows with a month: > 0.7 HIGH, > 0.3 MEDIUM, else LOW (no column: LOW)."""
    if month_col not in df.columns:
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            "rows", F.lit(None).cast("double").alias("coverage"), F.lit("LOW").alias("temporal_confidence"))
    cov = F.avg(F.col(month_col).isNotNull().cast("double"))
    return df.agg(F.count(F.lit(1)).alias("rows"), cov.alias("coverage")).withColumn(
        "temporal_confidence",
        F.when(F.col("rows") == 0, F.lit("UNKNOWN")).when(F.col("coverage") > 0.7, "HIGH")
        .when(F.col("coverage") > 0.3, "MEDIUM").otherwise("LOW"))


def monthly_counts(df: DataFrame, month_col: str = "month") -> DataFrame:
    """Rows per month, ascending, null months dropped. ``shown`` says whether the
    chart would be drawn (more than one month)."""
    m = df.where(F.col(month_col).isNotNull()).groupBy(month_col).agg(F.count(F.lit(1)).alias("n"))
    # The month table is bounded by the calendar, so one window over it is cheap.
    return m.withColumn("shown", F.count(F.lit(1)).over(Window.partitionBy()) > 1).orderBy(month_col)


def keep_top_values(df: DataFrame, col: str, n: int = 10, fill: str = "NA") -> DataFrame:
    """Rows whose value (null -> "NA") is among the n most frequent.

    The top-n table has n rows by construction, so the semi join broadcasts it.
    """
    v = F.coalesce(F.col(col).cast("string"), F.lit(fill))
    top = (df.select(v.alias("_top_v")).groupBy("_top_v").agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.desc("_n"), F.asc("_top_v")).limit(n).select("_top_v"))
    return df.join(F.broadcast(top), v == F.col("_top_v"), "left_semi")


def crosstab(df: DataFrame, row: str = "flight_phase", col: str = "risk_level", top: int = 10,
             fill: str = "NA") -> DataFrame:
    """Row x column counts over the ``top`` most frequent row values (null -> "NA"),
    long form ``(row, col, n, row_total, row_rank)``. One scan: the source is grouped
    once, and the row totals are ranked from the (small) counts."""
    r = F.coalesce(F.col(row).cast("string"), F.lit(fill)).alias(row)
    c = F.coalesce(F.col(col).cast("string"), F.lit(fill)).alias(col)
    counts = materialise(df.select(r, c).groupBy(row, col).agg(F.count(F.lit(1)).alias("n")), "crosstab")
    totals = counts.groupBy(row).agg(F.sum("n").alias("row_total")).orderBy(F.desc("row_total"), F.asc(row)).limit(top)
    totals = totals.withColumn("row_rank", F.row_number().over(Window.orderBy(F.desc("row_total"), F.asc(row))))  # <= top rows
    return counts.join(totals, row)


def closest(df: DataFrame, order_cols: list, n: int = 3, col: str = "miss_distance_num",
            group_col: str | None = None) -> DataFrame:
    """T5: the n smallest values of ``col``, nulls last (per group when given)."""
    order = [F.asc_nulls_last(col), *order_cols]
    if group_col is None:
        return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(group_col).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def examples(df: DataFrame, group_col: str, order_cols: list, n: int = 5, col: str = "report_number",
             out: str = "examples") -> DataFrame:
    """The first n values of ``col`` per group in row order, comma joined (null -> 'None')."""
    w = Window.partitionBy(group_col).orderBy(*order_cols)
    first = df.select(group_col, F.coalesce(F.col(col).cast("string"), F.lit("None")).alias("_v"),
                      F.row_number().over(w).alias("_r")).where(F.col("_r") <= n)
    return first.groupBy(group_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"]), ", ").alias(out))
