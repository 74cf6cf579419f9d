"""Association rules for elevated risk.

Each driver gives exactly one token per row (its value, null read as "NA"), so
an itemset holds at most one token per driver. The elevated-risk rules over the
four drivers read all their supports from one ``CUBE`` over rows that are counted
by their values first. General itemsets, over any number of attributes, and their
rules grow level by level from what was frequent (or confident) enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import fmt_fixed
from ..functions.risk import elevated, pretty_token, risk_phrase
from ..session import materialise
from ..settings import DEFAULT, Settings
from .normalise import canonical_drivers

# How each driver reads in a rule's context text.
CONTEXT_LABELS = {
    "flight_phase": "flight phase",
    "light": "lighting",
    "atc_advisory": "ATC",
    "cause_category": "cause",
}
MISSING_ATC = ("na", "n/a", "not_available", "not available")


def _flag(df: DataFrame, settings: Settings):
    if "risk_high" in df.columns:
        return F.coalesce(F.col("risk_high"), F.lit(False))
    if "risk_level" in df.columns:
        return elevated("risk_level", settings.elevated_threshold)
    return F.lit(False)  # D7: no risk column -> nothing is elevated


def baseline(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows, elevated rows and their share, as one row."""
    f = _flag(df, settings)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(f.cast("long")).alias("elevated"),
    ).select("rows", F.coalesce("elevated", F.lit(0)).alias("elevated"),
             F.when(F.col("rows") > 0, F.col("elevated") / F.col("rows")).otherwise(F.lit(0.0)).alias("baseline"))


def _context_cols(attrs):
    order = sorted(attrs, key=lambda a: a + "_")  # token order: the sorted one-hot names
    present = [F.when(F.col(a).isNotNull(), F.struct(F.lit(a).alias("key"), F.col(a).alias("value"))) for a in order]
    entries = F.array_compact(F.array(*present))
    parts = F.array_compact(F.array(*[
        F.when(F.col(a).isNotNull(), F.concat(F.lit(CONTEXT_LABELS.get(a, a.replace("_", " ")) + " = "), F.col(a)))
        for a in order]))
    text = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(F.lit("any context"))
    return F.map_from_entries(entries), text


def mine_risk_rules(df: DataFrame, settings: Settings = DEFAULT, attrs=None) -> DataFrame:
    """Every non-empty condition set A with support(A and elevated) >= min_support
    and lift >= 1. Columns: the driver values (null = not in A), ``context`` map,
    ``context_text``, ``rows`` (= |A|), ``n``, ``support``, ``confidence``, ``lift``,
    ``uplift``, ``baseline``. Arithmetic follows the apriori formulas exactly.
    """
    attrs = list(attrs or settings.drivers)
    flag = _flag(df, settings)
    d = canonical_drivers(df.select(*[c for c in attrs if c in df.columns], flag.alias("_flag")), attrs)
    schema_cols = [*attrs, "context", "context_text", "rows", "n", "support", "confidence", "lift",
                   "uplift", "baseline"]
    full = (1 << len(attrs)) - 1
    # One scan: rows are counted by their values, the cube then adds up those counts, and its all-rolled-up
    # cell is the grand total. The cells (one per value combination and grouping set) are written once and
    # read twice instead of scanning the source again.
    by_value = d.groupBy(*attrs).agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.col("_flag").cast("long")).alias("_n"))
    cells = materialise(by_value.cube(*attrs).agg(F.sum("_rows").alias("rows"), F.sum("_n").alias("n"), F.grouping_id().alias("_gid")), "rule-cells")
    tot = cells.where(F.col("_gid") == full).select("rows", "n").first()
    total, elev = (int(tot["rows"]), int(tot["n"] or 0)) if tot else (0, 0)
    if total == 0 or elev == 0:
        return d.sparkSession.createDataFrame([], _rules_schema(attrs)).select(*schema_cols)
    cells = cells.where((F.col("_gid") != full) & ((F.col("n") / F.lit(total)) >= F.lit(settings.min_support)))
    base = elev / total
    support = F.col("n") / F.lit(total)
    ant = F.col("rows") / F.lit(total)
    conf = support / ant
    ctx, text = _context_cols(attrs)
    return (
        cells.withColumns({"support": support, "confidence": conf})
        .withColumn("lift", F.col("confidence") / F.lit(base))
        .where(F.col("lift") >= F.lit(1.0))
        .select(*attrs, ctx.alias("context"), text.alias("context_text"), "rows", "n", "support",
                "confidence", "lift", (F.col("confidence") / F.lit(base)).alias("uplift"),
                F.lit(base).alias("baseline"))
    )


def _rules_schema(attrs):
    from pyspark.sql.types import (DoubleType, LongType, MapType, StringType, StructField, StructType)

    return StructType([StructField(a, StringType()) for a in attrs] + [
        StructField("context", MapType(StringType(), StringType())), StructField("context_text", StringType()),
        StructField("rows", LongType()), StructField("n", LongType()), StructField("support", DoubleType()),
        StructField("confidence", DoubleType()), StructField("lift", DoubleType()),
        StructField("uplift", DoubleType()), StructField("baseline", DoubleType())])


def filter_rules(rules: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """uplift >= 1.2 (NaN out), n >= 30, and not a lone missing-ATC condition."""
    ctx = F.col("context")
    lone_missing_atc = (F.size(ctx) == 1) & F.lower(ctx.getItem("atc_advisory")).isin(*MISSING_ATC)
    return rules.where(
        ~F.isnan("uplift") & (F.col("uplift") >= F.lit(settings.min_uplift))
        & (F.col("n") >= F.lit(settings.min_rule_n)) & ~F.coalesce(lone_missing_atc, F.lit(False))
    )


def rank_rules(rules: DataFrame, n: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """By uplift, then volume, descending (context text breaks ties); keep ``n``."""
    n = settings.rules_reported if n is None else n
    order = [F.desc("uplift"), F.desc("n"), F.asc("context_text")]
    w = Window.orderBy(*order)
    top = rules.orderBy(*order).limit(n)  # TakeOrderedAndProject: a bounded top-n, no full sort
    return top.withColumn("rank", F.row_number().over(w))


def with_narrative(rules: DataFrame) -> DataFrame:
    """``When <context>, <pct>% of incidents were classified elevated risk
    (~<uplift>× baseline, <n> incidents).`` Numbers rounded the way Python does (D14)."""
    pct = F.bround(F.col("confidence") * F.lit(100.0), 0).cast("bigint")
    return rules.withColumn("narrative", F.concat(
        F.lit("When "), F.col("context_text"), F.lit(", "), pct.cast("string"),
        F.lit("% of incidents were classified elevated risk (~"), fmt_fixed("uplift", 1),
        F.lit("× baseline, "), F.col("n").cast("string"), F.lit(" incidents).")))


def risk_rules_report(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """G5 -> F5 -> T7 -> W1: the ranked, narrated rules the Discover bundle reports."""
    return with_narrative(rank_rules(filter_rules(mine_risk_rules(df, settings), settings), settings=settings))


# ---------------------------------------------------------------- general itemsets and rules


def frequent_itemsets(df: DataFrame, attrs, min_support: float = DEFAULT.min_support, target: str | None = None) -> DataFrame:
    """All token sets with support >= ``min_support``, level by level.

    Tokens are ``<attr>_<value>`` (value null read as "NA", stripped) plus, when
    ``target`` names a boolean column, the token ``target`` on rows where it is
    true. Rows are first counted by their values. Each level then extends only the
    frequent sets of the level before, by a later attribute's token with which they
    were frequent; what a row still may be extended by shrinks with it, and rows that
    have become alike are added up. So the work follows the frequent sets, not the
    2^k sets of attributes. Columns: ``itemset`` (sorted tokens), ``size``, ``count``, ``support``.
    """
    attrs = list(attrs)
    flag = [F.coalesce(F.col(target), F.lit(False)).alias("_target")] if target else []
    names = [*attrs, *([target] if target else [])]
    plain = [f"_{i}" for i in range(len(attrs))]
    d = canonical_drivers(df.select(*[c for c in attrs if c in df.columns], *flag), attrs).toDF(*_renamed(df, attrs, plain, target))
    combos = materialise(d.groupBy(*plain, *(["_target"] if target else [])).agg(F.count("*").alias("w")), "itemset-rows")
    total = combos.agg(F.sum("w")).first()[0] or 0
    if not total:
        return d.sparkSession.createDataFrame([], "itemset array<string>, size int, count bigint, support double")
    enough = (F.col("count") / F.lit(total)) >= F.lit(min_support)
    # Within the levels an item is its attribute's number and its value, so items sort by attribute.
    items = {f"_{i}": F.concat(F.lit(f"{i:04d}:"), F.col(c)) for i, c in enumerate(plain)}
    if target:
        items["_target"] = F.when(F.col("_target"), F.lit(f"{len(attrs):04d}:"))
    rows = combos.select(*[v.alias(c) for c, v in items.items()], "w")
    single = materialise(rows.select(F.explode(F.array_compact(F.array(*items))).alias("item"), "w").groupBy("item")
                         .agg(F.sum("w").alias("count")).where(enough), "items")
    for i, c in enumerate(items):  # a row keeps its frequent items
        own = single.where(F.col("item").startswith(f"{i:04d}:")).select(F.col("item").alias(f"{c}f"))
        rows = rows.join(own, F.col(c) == F.col(f"{c}f"), "left")
    rows = rows.select(F.array_compact(F.array(*[f"{c}f" for c in items])).alias("tail"), "w").groupBy("tail").agg(F.sum("w").alias("w"))
    found = single.select(F.array("item").alias("items"), "count")
    records = _extended(rows.select(F.array().cast("array<string>").alias("items"), "tail", "w"))
    for size in range(2, len(names) + 1):
        records = materialise(records, "itemset-records")
        counted = materialise(records.select("items", F.explode("tail").alias("item"), "w").groupBy("items", "item")
                              .agg(F.sum("w").alias("count")).where(enough), "itemsets")
        if counted.isEmpty():
            break
        found = found.unionByName(counted.select(F.concat("items", F.array("item")).alias("items"), "count"))
        if size < len(names):
            grown = counted.groupBy("items").agg(F.collect_set("item").alias("more"))
            kept = records.join(grown, "items").select("items", F.filter("tail", lambda t: F.array_contains("more", t)).alias("tail"), "w")
            records = _extended(kept)
    labels = F.array(*[F.lit(n) for n in names])

    def token(item):
        at = F.substring(item, 1, 4).cast("int") + 1
        name = F.element_at(labels, at)
        return name if target and not attrs else F.when(at == len(attrs) + 1, name).otherwise(F.concat(name, F.lit("_"), F.substring(item, 6, 1 << 30)))
    return found.select(F.array_sort(F.transform("items", token)).alias("itemset"), F.size("items").alias("size"), "count",
                        (F.col("count") / F.lit(total)).alias("support"))


def _renamed(df: DataFrame, attrs: list[str], plain: list[str], target: str | None) -> list[str]:
    """New names of the columns that ``canonical_drivers`` gives: those of ``df`` first, then the target, then missing ones."""
    here = [plain[i] for i, c in enumerate(attrs) if c in df.columns]
    return [*here, *(["_target"] if target else []), *(plain[i] for i, c in enumerate(attrs) if c not in df.columns)]


def _extended(records: DataFrame) -> DataFrame:
    """(items, tail, w): every record's items with each item of its tail and what follows that, alike records added up."""
    at = records.select("items", "tail", "w", F.posexplode("tail").alias("p", "item"))
    out = at.select(F.concat("items", F.array("item")).alias("items"), F.slice("tail", F.col("p") + 2, F.size("tail")).alias("tail"), "w")
    return out.where(F.size("tail") > 0).groupBy("items", "tail").agg(F.sum("w").alias("w"))


def association_rules(itemsets: DataFrame, metric: str = "lift", min_threshold: float = 1.0,
                      min_confidence: float | None = None) -> DataFrame:
    """Every rule A -> C with A, C non-empty, A u C a frequent itemset.

    Consequents grow level by level, by items after their last one; a rule's confidence
    falls as its consequent grows, so with ``min_confidence`` (or ``confidence`` as the
    metric) only consequents that reach it are extended. Without a bound these are all
    splits. Supports come from equi-joins on the sorted token key (J6), whose strategy
    Spark picks by size. Columns: ``antecedents``, ``consequents``, ``antecedent_support``,
    ``consequent_support``, ``support``, ``count``, ``confidence``, ``lift``,
    ``leverage``, ``conviction``.
    """
    sep = "\u0001"
    if metric == "confidence":
        min_confidence = max(min_threshold, min_confidence if min_confidence is not None else min_threshold)
    # The itemset table is joined with itself: written once to the shared folder.
    itemsets = materialise(itemsets, "itemsets")
    lookup = itemsets.select(F.array_join("itemset", sep).alias("key"), "support")
    of_antecedent = lookup.select(F.col("key").alias("a_key"), F.col("support").alias("antecedent_support"))
    of_consequent = lookup.select(F.col("key").alias("c_key"), F.col("support").alias("consequent_support"))
    largest = itemsets.agg(F.max("size")).first()[0] or 0
    # ``picked``: the places of the consequent in the itemset, in order.
    level = itemsets.where("size >= 2").select("itemset", "size", "count", "support", F.array().cast("array<int>").alias("picked"))
    levels = []
    for n in range(1, largest):
        after = F.coalesce(F.try_element_at("picked", F.lit(-1)) + 1, F.lit(0))
        grown = level.where((F.col("size") > n) & (after < F.col("size"))).select(
            "itemset", "size", "count", "support", F.col("picked").alias("before"), F.explode(F.sequence(after, F.col("size") - 1)).alias("p"))
        grown = grown.withColumn("picked", F.concat("before", F.array("p"))).drop("before", "p")
        chosen = F.filter("itemset", lambda _, i: ~F.array_contains("picked", i))
        grown = grown.withColumn("a_key", F.array_join(chosen, sep)).join(of_antecedent, "a_key").drop("a_key")
        grown = grown.withColumn("confidence", F.col("support") / F.col("antecedent_support"))
        if min_confidence is not None:
            grown = grown.where(F.col("confidence") >= F.lit(min_confidence))
        level = materialise(grown, "rules")
        if level.isEmpty():
            break
        levels.append(level)
        level = level.drop("antecedent_support", "confidence")
    if not levels:
        levels = [level.select("itemset", "size", "count", "support", "picked", F.col("support").alias("antecedent_support"),
                               F.col("support").alias("confidence")).limit(0)]
    r = levels[0]
    for more in levels[1:]:
        r = r.unionByName(more)
    r = r.withColumns({"antecedents": F.filter("itemset", lambda _, i: ~F.array_contains("picked", i)),
                       "consequents": F.filter("itemset", lambda _, i: F.array_contains("picked", i))})
    r = r.withColumn("c_key", F.array_join("consequents", sep)).join(of_consequent, "c_key").withColumns({
        "lift": F.col("confidence") / F.col("consequent_support"),
        "leverage": F.col("support") - F.col("antecedent_support") * F.col("consequent_support"),
        "conviction": F.when(F.col("confidence") < 1.0,
                             (F.lit(1.0) - F.col("consequent_support")) / (F.lit(1.0) - F.col("confidence")))
        .otherwise(F.lit(float("inf"))),
    })
    return r.where(F.col(metric) >= F.lit(min_threshold)).select(
        "antecedents", "consequents", "antecedent_support", "consequent_support", "support", "count",
        "confidence", "lift", "leverage", "conviction")


def only_target(rules: DataFrame, target: str = "risk_high") -> DataFrame:
    """F8: rules whose consequent is exactly the target token."""
    return rules.where((F.size("consequents") == 1) & (F.element_at("consequents", 1) == F.lit(target)))


def filter_strong_rules(rules: DataFrame, min_confidence: float = 0.6, min_lift: float = 1.5,
                        min_count: int = 10, consequent_prefix: str = "risk_level") -> DataFrame:
    """confidence >= 0.6, lift >= 1.5, at least 10 supporting rows, and a
    consequent that speaks about risk (a token starting with ``risk_level``)."""
    return rules.where(
        (F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift) & (F.col("count") >= min_count)
        & F.exists("consequents", lambda t: t.startswith(consequent_prefix))
    )


def strong_rule_sentences(rules: DataFrame, consequent_prefix: str = "risk_level") -> DataFrame:
    """W2 sentence for each rule: ``When <a> and <b>, <pct>% of incidents were
    classified <risk phrase>, ~<lift>× the baseline rate (<n> incidents).``"""
    from ..functions.numeric import py_round

    ants = F.filter("antecedents", lambda t: ~t.startswith(consequent_prefix))
    ant_text = F.when(F.size(ants) > 0, F.array_join(F.transform(ants, lambda t: pretty_token(t)), " and ")) \
        .otherwise(F.lit("these conditions"))
    cons = F.filter("consequents", lambda t: t.startswith(consequent_prefix))
    pct = F.bround(F.col("confidence") * F.lit(100.0), 0).cast("bigint")
    lift1 = py_round("lift", 1)
    return rules.withColumn("sentence", F.concat(
        F.lit("When "), ant_text, F.lit(", "), pct.cast("string"), F.lit("% of incidents were classified "),
        risk_phrase(cons), F.lit(", ~"), lift1.cast("string"), F.lit("× the baseline rate ("),
        F.col("count").cast("string"), F.lit(" incidents).")))
