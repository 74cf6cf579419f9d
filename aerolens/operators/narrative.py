"""Text built from result tables (W2, W5, W8, G15). Column expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import py_float_str
from . import rules as R
from . import stats

# The texts of summaries and claims here and in ``compose_answer``.
NO_MATCH = "No matching incidents were found for the specified criteria."


def distinct_first(df: DataFrame, col: str, order_cols: list, n: int = 5) -> DataFrame:
    """Distinct values of ``col``, each at its first position, the first n.
    ``min_by`` per value is a partial aggregate (no sort of a hot value's rows)."""
    first = df.groupBy(col).agg(F.min(F.struct(*order_cols)).alias("_pos"))
    top = first.orderBy("_pos").limit(n)
    return top.withColumn("ord", F.row_number().over(Window.orderBy("_pos"))).drop("_pos")


def strong_narratives(general_rules: DataFrame, n: int = 5) -> DataFrame:
    """Strong rules (F6) as sentences, distinct, first n in rule order.

    Rule order (not fixed upstream) is lift, then confidence, descending, then
    the antecedent and consequent text.
    """
    strong = R.strong_rule_sentences(R.filter_strong_rules(general_rules))
    strong = strong.withColumns({"_a": F.array_join("antecedents", ","), "_c": F.array_join("consequents", ",")})
    order = [(-F.col("lift")).alias("l"), (-F.col("confidence")).alias("c"), F.col("_a").alias("a"),
             F.col("_c").alias("k")]
    return distinct_first(strong, "sentence", order, n)


def compose_answer(rows: DataFrame, questions: DataFrame, group_col: str = "question_id",
                   order_col: str = "rank", closest_claim: bool = True) -> DataFrame:
    """Per question a summary and claims with citations.

    ``rows`` are a question's ranked, filtered incidents (normalised columns).
    Claims: top cause, top phase, risk distribution (citing the first five
    report numbers) and the three closest misses (citing their reports). A
    question without rows gets the fixed text and no claims. ``closest_claim`` is
    False where the corpus has no miss distances: there is no fourth claim then.
    """
    q = group_col
    facets = stats.facet_strings(stats.facet_counts(rows, group_cols=[q]), [q])
    first5 = rows.withColumn("_r", F.row_number().over(Window.partitionBy(q).orderBy(order_col))) \
        .where(F.col("_r") <= 5)
    ex = first5.groupBy(q).agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "_r", F.coalesce(F.col("report_number").cast("string"), F.lit("None")).alias("v")))), lambda x: x["v"])
        .alias("ex_reports"))
    near = stats.closest(rows, [order_col], 3, "miss_distance_num", group_col=q)
    near = near.groupBy(q).agg(F.array_sort(F.collect_list(F.struct(
        F.col("rank").alias("r"),
        F.concat(F.lit("Report "), F.coalesce(F.col("report_number").cast("string"), F.lit("None")),
                 F.lit(" miss_distance="), py_float_str(F.coalesce("miss_distance_num", F.lit(float("nan"))))).alias("t"),
        F.coalesce(F.col("report_number").cast("string"), F.lit("None")).alias("c")))).alias("_near"))
    cnt = rows.groupBy(q).agg(F.count(F.lit(1)).alias("total"))
    a = (questions.select(q).distinct().join(cnt, q, "left").join(facets, q, "left").join(ex, q, "left")
         .join(near, q, "left"))
    total = F.coalesce(F.col("total"), F.lit(0))
    tc, tcn = F.coalesce("top_cause", F.lit("N/A")), F.coalesce(F.col("top_cause_n"), F.lit(0)).cast("string")
    tp, tpn = F.coalesce("top_phase", F.lit("N/A")), F.coalesce(F.col("top_phase_n"), F.lit(0)).cast("string")
    risk = F.coalesce(F.col("by_risk"), F.lit("N/A"))
    exs = F.array_join("ex_reports", ", ")
    t = total.cast("string")
    summary = F.concat(
        F.lit("This subset includes "), t, F.lit(" incident(s). The most frequent cause category is '"), tc,
        F.lit("' ("), tcn, F.lit(" cases). The most common flight phase is '"), tp, F.lit("' ("), tpn,
        F.lit(" cases). Risk score distribution: "), risk, F.lit(". Representative reports: "), exs, F.lit("."))
    claim = lambda text, cites: F.struct(text.alias("text"), cites.alias("citations"))
    claims = [
        claim(F.concat(F.lit("Most common cause category is '"), tc, F.lit("' ("), tcn, F.lit("/"), t,
                       F.lit(" incidents).")), F.col("ex_reports")),
        claim(F.concat(F.lit("Most common flight phase is '"), tp, F.lit("' ("), tpn, F.lit("/"), t,
                       F.lit(" incidents).")), F.col("ex_reports")),
        claim(F.concat(F.lit("Risk score distribution for this subset is: "), risk, F.lit(".")), F.col("ex_reports")),
        claim(F.concat(F.lit("Smallest recorded miss_distance values in this subset indicate notable proximity "
                             "events: "), F.array_join(F.transform("_near", lambda x: x["t"]), "; ")),
              F.transform("_near", lambda x: x["c"])),
    ]
    claims = F.array(*claims[:4 if closest_claim else 3])
    empty = total == 0
    return a.select(
        q, total.alias("count"),
        F.when(empty, F.lit(NO_MATCH)).otherwise(summary).alias("summary"),
        F.when(empty, F.array().cast("array<struct<text:string,citations:array<string>>>")).otherwise(claims)
        .alias("claims"),
        "by_cause", "by_phase", "by_risk")


def headlines(watch: DataFrame, n: int = 3) -> DataFrame:
    """The first n watch items as ``- context: statement`` lines; ``None.`` when empty."""
    top = watch.where(F.col("rank") <= n)
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat(
        F.lit("- "), F.col("context"), F.lit(": "), F.coalesce(F.col("severity_statement"), F.lit("None"))).alias("l"))))
    agg = top.agg(lines.alias("_l"))
    return agg.select(F.when(F.size("_l") > 0, F.array_join(F.transform("_l", lambda x: x["l"]), "\n"))
                      .otherwise(F.lit("None.")).alias("headlines"))
