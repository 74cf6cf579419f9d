"""Registered queries: one per operator of the inventory, each with its DuckDB twin.

Every query reads the shared test tables (or views Spark derives from them)
in full. ``QUERIES[key](spark, sf_dir)`` returns a DataFrame; ``ORACLE[key]`` is
the SQL giving the same rows. Outputs are flat: integers as BIGINT, dates and
times as text, lists joined to text, so both engines hash the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (ByteType, DateType, DecimalType, FloatType, IntegerType, ShortType,
                               TimestampNTZType, TimestampType)

from . import sqltext as S
from .functions import dates as fdates, numeric as fnum, risk as frisk
from .operators import clusters, critical, normalise, rules, stats
from .settings import DEFAULT
from .sources import fixtures, incidents as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

KEY = list(fixtures.SRC_KEY)
KEY_NAMES = list(fixtures.SRC_KEY)


def register(key: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir, _fn=fn):
            # The engine reads and prints times in UTC (SURVEY: session zone UTC).
            if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return flat(_fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql.strip()
        return run
    return deco


def flat(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (IntegerType, ShortType, ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, (FloatType, DecimalType)):
            c = c.cast("double")
        elif isinstance(t, DateType):
            c = c.cast("string")
        elif isinstance(t, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def inc(spark, sf_dir):
    return fixtures.incidents(spark, sf_dir)


def norm(spark, sf_dir):
    return normalise.normalise_incidents(inc(spark, sf_dir))


NORM = f"WITH {S.INC}, {S.norm_cte()}"

# ------------------------------------------------------------------ sources


@register("load_incidents", """SELECT doc_id, text, lang, source, n_chars FROM documents""")
def q_load_incidents(spark, sf_dir):
    """The documents table opened in place, one namespace (language) at a time;
    rows without a namespace are read without one."""
    path = f"{sf_dir}/documents.parquet"
    whole = src.load_incidents(spark, path)
    parts = [src.load_incidents(spark, path, namespace=n, namespace_col="lang") for n in ("en", "fr", "de", "es")]
    out = whole.where(F.col("lang").isNull() | ~F.col("lang").isin("en", "fr", "de", "es"))
    for p in parts:
        out = out.unionByName(p)
    return out.select("doc_id", "text", "lang", "source", "n_chars")


@register("flatten_matches", f"""WITH {S.INC} SELECT report_number AS match_id, CAST(l_extendedprice AS DOUBLE) AS score,
  report_number, datetime, flight_phase, light, atc_advisory, cause_category, risk_level, miss_distance, altitude
FROM incidents""")
def q_flatten_matches(spark, sf_dir):
    """Matches carrying metadata as JSON text are flattened back to columns."""
    cols = ["report_number", "datetime", "flight_phase", "light", "atc_advisory", "cause_category",
            "risk_level", "miss_distance", "altitude"]
    m = inc(spark, sf_dir).select(F.col("report_number").alias("id"), F.col("l_extendedprice").alias("score"),
                                  F.to_json(F.struct(*cols)).alias("metadata"))
    return src.flatten_matches(m).select("match_id", "score", *cols)


@register("flatten_matches_nested", f"""WITH {S.INC} SELECT report_number AS match_id, CAST(l_extendedprice AS DOUBLE) AS score,
  report_number, CAST(l_extendedprice AS DOUBLE) AS price, l_extendedprice > 30000 AS dear, flight_phase AS phase,
  CAST(length(cause_category) AS BIGINT) AS cause_length, light AS first_tag, CAST(2 AS BIGINT) AS n_tags FROM incidents""")
def q_flatten_matches_nested(spark, sf_dir):
    """S2 with typed metadata: numbers, booleans, an object and a list inside the JSON keep their types."""
    m = inc(spark, sf_dir).select(
        F.col("report_number").alias("id"), F.col("l_extendedprice").alias("score"), F.to_json(F.struct(
            "report_number", F.col("l_extendedprice").cast("double").alias("price"), (F.col("l_extendedprice") > 30000).alias("dear"),
            F.struct(F.col("flight_phase").alias("phase"), F.struct(F.length("cause_category").alias("length")).alias("cause")).alias("scene"),
            F.array("light", "atc_advisory").alias("tags"))).alias("metadata"))
    flat = src.flatten_matches(m, typed=True)
    return flat.select("match_id", "score", "report_number", "price", "dear", F.col("scene.phase").alias("phase"),
                       F.col("scene.cause.length").alias("cause_length"), F.col("tags")[0].alias("first_tag"),
                       F.size("tags").cast("long").alias("n_tags"))


@register("read_incident_csv", f"""WITH {S.INC} SELECT nullif(report_number, '') AS report_number,
  nullif(datetime, '') AS datetime, nullif(flight_phase, '') AS flight_phase, nullif(light, '') AS light,
  nullif(atc_advisory, '') AS atc_advisory, nullif(cause_category, '') AS cause_category,
  nullif(risk_level, '') AS risk_level, nullif(miss_distance, '') AS miss_distance, nullif(altitude, '') AS altitude
FROM incidents""")
def q_read_incident_csv(spark, sf_dir):
    """S3: the corpus dumped to CSV by Spark and read back as all-text columns.

    A CSV cell cannot tell an empty text from a missing one; both read as null
    (as a pandas CSV reader does). Surrounding blanks are kept.
    """
    from .session import scratch_path

    cols = ["report_number", "datetime", "flight_phase", "light", "atc_advisory", "cause_category",
            "risk_level", "miss_distance", "altitude"]
    path = scratch_path(spark, "incidents-csv")
    inc(spark, sf_dir).select(*cols).write.option("header", "true") \
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return src.read_incident_csv(spark, path, ignoreLeadingWhiteSpace="false",
                                 ignoreTrailingWhiteSpace="false").select(*cols)


@register("load_questions", f"""WITH {S.CONVQ} SELECT question_id, question, date_from, date_to, phase FROM questions""")
def q_load_questions(spark, sf_dir):
    """The user turns of ``conversations`` as a question table."""
    return src.load_questions(fixtures.conversation_questions(spark, sf_dir))


# ------------------------------------------------------------------ normalisation


@register("to_number", f"""WITH {S.INC} SELECT {S.SRC_KEY}, {S.num('miss_distance')} AS miss_distance_num,
  {S.num('altitude')} AS altitude_num, {S.num('risk_level')} AS risk_value FROM incidents""")
def q_to_number(spark, sf_dir):
    """N1 on miss distance, altitude and the risk text."""
    return inc(spark, sf_dir).select(*KEY, fnum.to_number("miss_distance").alias("miss_distance_num"),
                                     fnum.to_number("altitude").alias("altitude_num"),
                                     fnum.to_number("risk_level").alias("risk_value"))


@register("to_utc_timestamp", f"""WITH {S.INC} SELECT {S.SRC_KEY}, datetime,
  strftime({S.ts('datetime')}, '%Y-%m-%d %H:%M:%S') AS ts FROM incidents""")
def q_to_utc(spark, sf_dir):
    """N2 on the dirty ``datetime`` text."""
    return inc(spark, sf_dir).select(*KEY, "datetime", fdates.to_utc("datetime").alias("ts"))


@register("calendar_columns", f"""{NORM} SELECT {S.SRC_KEY}, CAST(date AS VARCHAR) AS date, week, month, hour_of_day
FROM norm""")
def q_calendar(spark, sf_dir):
    """Date, ISO week, month, hour."""
    return norm(spark, sf_dir).select(*KEY, "date", "week", "month", "hour_of_day")


@register("normalise_month", f"""{NORM} SELECT {S.SRC_KEY}, datetime, month FROM norm""")
def q_normalise_month(spark, sf_dir):
    """Month only where a timestamp parsed (never the text 'NaT')."""
    d = inc(spark, sf_dir).withColumn("ts", fdates.to_utc("datetime"))
    return fdates.normalise_month(d, "ts").select(*KEY, "datetime", "month")


@register("risk_numeric", f"""{NORM} SELECT {S.SRC_KEY}, risk_level, risk_numeric FROM norm""")
def q_risk_numeric(spark, sf_dir):
    """Words to 1/2/3."""
    return inc(spark, sf_dir).select(*KEY, "risk_level", frisk.risk_numeric("risk_level").alias("risk_numeric"))


@register("elevated_flag", f"""{NORM} SELECT {S.SRC_KEY}, risk_level, risk_high FROM norm""")
def q_elevated(spark, sf_dir):
    """Numeric risk >= 4."""
    return inc(spark, sf_dir).select(*KEY, "risk_level", frisk.elevated("risk_level").alias("risk_high"))


@register("high_text_flag", f"""{NORM} SELECT {S.SRC_KEY}, risk_level, risk_text_high FROM norm""")
def q_high_text(spark, sf_dir):
    """The risk text says 'high'."""
    return inc(spark, sf_dir).select(*KEY, "risk_level", frisk.high_text("risk_level").alias("risk_text_high"))


@register("canonical_drivers", f"""WITH {S.INC} SELECT {S.SRC_KEY}, {S.driver('flight_phase')} AS flight_phase,
  {S.driver('light')} AS light, {S.driver('atc_advisory')} AS atc_advisory,
  {S.driver('cause_category')} AS cause_category FROM incidents""")
def q_canonical_drivers(spark, sf_dir):
    """The four drivers, null as NA, stripped."""
    return normalise.canonical_drivers(inc(spark, sf_dir)).select(*KEY, *DEFAULT.drivers)


@register("enrich_incidents", f"""WITH {S.INC}, e AS (SELECT *, {S.ts('datetime')} AS ts FROM incidents)
SELECT {S.SRC_KEY}, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts, '%Y-%m') AS month,
  {S.num('risk_level')} AS risk_value, coalesce(flight_phase, '—') AS flight_phase,
  coalesce(cause_category, '—') AS cause_category, coalesce(light, '—') AS light,
  coalesce(atc_advisory, '—') AS atc_advisory, {S.num('miss_distance')} AS miss_distance_num,
  {S.num('altitude')} AS altitude_num FROM e""")
def q_enrich(spark, sf_dir):
    """The one-pass cleaner."""
    return normalise.enrich_incidents(inc(spark, sf_dir)).select(
        *KEY, "ts", "month", "risk_value", "flight_phase", "cause_category", "light", "atc_advisory",
        "miss_distance_num", "altitude_num")


@register("conform_schema", f"""WITH {S.INC} SELECT report_number, risk_level, CAST(NULL AS VARCHAR) AS id,
  CAST(NULL AS VARCHAR) AS datetime, CAST(NULL AS VARCHAR) AS flight_phase, CAST(NULL AS VARCHAR) AS light,
  CAST(NULL AS VARCHAR) AS atc_advisory, CAST(NULL AS VARCHAR) AS cause_category,
  CAST(NULL AS VARCHAR) AS miss_distance, CAST(NULL AS VARCHAR) AS altitude,
  CAST(NULL AS VARCHAR) AS summary_ai, CAST(NULL AS VARCHAR) AS synopsis,
  CAST(NULL AS VARCHAR) AS primary_problem, CAST(NULL AS VARCHAR) AS full_narrative,
  CAST(NULL AS DOUBLE) AS score FROM incidents""")
def q_conform(spark, sf_dir):
    """A two-column projection conformed to the full schema (vector column left out)."""
    return src.conform(inc(spark, sf_dir).select("report_number", "risk_level")).drop("embedding")


@register("cluster_text", f"""WITH {S.TXT} SELECT doc_id,
  concat_ws(' ', coalesce(synopsis, ''), coalesce(primary_problem, ''), coalesce(full_narrative, '')) AS cluster_text
FROM incident_texts""")
def q_cluster_text(spark, sf_dir):
    """N11 on the narratives (summary column absent, synopsis partly null)."""
    from .functions.text import cluster_text

    return cluster_text(fixtures.incident_texts(spark, sf_dir)).select("doc_id", "cluster_text")


ONEHOT_SQL = f"""{NORM}, t AS (
  SELECT {S.SRC_KEY}, 'flight_phase_' || {S.driver('flight_phase')} AS token FROM norm
  UNION ALL SELECT {S.SRC_KEY}, 'light_' || {S.driver('light')} FROM norm
  UNION ALL SELECT {S.SRC_KEY}, 'atc_advisory_' || {S.driver('atc_advisory')} FROM norm
  UNION ALL SELECT {S.SRC_KEY}, 'cause_category_' || {S.driver('cause_category')} FROM norm
  UNION ALL SELECT {S.SRC_KEY}, 'risk_high' FROM norm WHERE risk_high)"""


@register("onehot_conditions", f"{ONEHOT_SQL} SELECT * FROM t")
def q_onehot(spark, sf_dir):
    """Long-form indicator tokens per row."""
    return normalise.onehot(norm(spark, sf_dir), KEY_NAMES)


def _pretty_sql(tok: str) -> str:
    def v(e):
        e = S.strip(f"replace({e}, '_', ' ')")
        e = f"regexp_replace({e}, '^''+|''+$', '', 'g')"
        return f"regexp_replace({e}, '^\"+|\"+$', '', 'g')"

    def named(prefix, nice):
        return f"WHEN starts_with({tok}, '{prefix}_') THEN " + S.strip(f"'{nice} = ' || " + v(f"substr({tok}, {len(prefix) + 2})"))

    risk = v(f"substr({tok}, 12)")
    return (f"CASE {named('flight_phase', 'flight phase')} {named('cause_category', 'cause category')} "
            f"{named('atc_advisory', 'ATC advisory')} "
            f"WHEN starts_with({tok}, 'risk_level_') THEN CASE WHEN {risk} <> '' THEN {risk} || ' risk' ELSE 'High risk' END "
            f"{named('light', 'lighting')} ELSE {v(tok)} END")


@register("pretty_token", f"""{ONEHOT_SQL}, u AS (SELECT DISTINCT token FROM t
  UNION SELECT 'risk_level_' || {S.driver('risk_level')} FROM norm)
SELECT token, {_pretty_sql('token')} AS pretty FROM u""")
def q_pretty(spark, sf_dir):
    """N13 on every distinct condition token and every risk-level token of the data."""
    n = norm(spark, sf_dir)
    toks = normalise.onehot(n, KEY_NAMES).select("token").distinct()
    risk = n.select(F.concat(F.lit("risk_level_"), frisk.canonical_driver("risk_level")).alias("token"))
    return toks.unionByName(risk).distinct().select("token", frisk.pretty_token("token").alias("pretty"))


@register("risk_phrase", f"""{NORM} SELECT {S.SRC_KEY},
  CASE WHEN contains(lower('risk_level_' || {S.driver('risk_level')}), 'high') THEN 'High risk'
       WHEN contains(lower('risk_level_' || {S.driver('risk_level')}), 'med') THEN 'Medium risk'
       WHEN contains(lower('risk_level_' || {S.driver('risk_level')}), 'low') THEN 'Low risk'
       ELSE 'elevated risk' END AS risk_phrase FROM norm""")
def q_risk_phrase(spark, sf_dir):
    """N14 on each row's risk-level token list."""
    n = inc(spark, sf_dir)
    toks = F.array(F.concat(F.lit("risk_level_"), frisk.canonical_driver("risk_level")))
    return n.select(*KEY, frisk.risk_phrase(toks).alias("risk_phrase"))


@register("canonical_context_key", f"""WITH {S.INC}, {S.norm_cte()}, r AS ({{RULES}})
SELECT context_text, concat('phase:', lower(coalesce(flight_phase, '')), '|light:', lower(coalesce(light, '')),
  '|cause:', lower(coalesce(cause_category, ''))) AS context_key FROM r""")
def q_context_key(spark, sf_dir):
    """N17 on the context of every mined rule."""
    r = rules.mine_risk_rules(norm(spark, sf_dir))
    return r.select("context_text", frisk.context_key("context").alias("context_key"))


# ------------------------------------------------------------------ rules

RULES_SQL = f"""WITH d AS (SELECT {S.driver('flight_phase')} AS flight_phase, {S.driver('light')} AS light,
    {S.driver('atc_advisory')} AS atc_advisory, {S.driver('cause_category')} AS cause_category, risk_high FROM norm),
  tot AS (SELECT count(*) AS total, sum(CAST(risk_high AS BIGINT)) AS elev FROM d),
  cells AS (SELECT flight_phase, light, atc_advisory, cause_category, count(*) AS rows,
    sum(CAST(risk_high AS BIGINT)) AS n, GROUPING(flight_phase, light, atc_advisory, cause_category) AS gid
    FROM d GROUP BY CUBE (flight_phase, light, atc_advisory, cause_category)),
  m AS (SELECT cells.*, CAST(n AS DOUBLE) / total AS support, (CAST(n AS DOUBLE) / total) / (CAST(rows AS DOUBLE) / total) AS confidence,
    CAST(elev AS DOUBLE) / total AS base FROM cells, tot WHERE elev > 0 AND gid <> 15 AND CAST(n AS DOUBLE) / total >= 0.02)
  SELECT flight_phase, light, atc_advisory, cause_category,
    concat_ws('; ', CASE WHEN atc_advisory IS NOT NULL THEN 'ATC = ' || atc_advisory END,
      CASE WHEN cause_category IS NOT NULL THEN 'cause = ' || cause_category END,
      CASE WHEN flight_phase IS NOT NULL THEN 'flight phase = ' || flight_phase END,
      CASE WHEN light IS NOT NULL THEN 'lighting = ' || light END) AS context_text,
    rows, n, support, confidence, confidence / base AS lift, confidence / base AS uplift, base AS baseline
  FROM m WHERE confidence / base >= 1.0"""

def _rules_sql(select: str) -> str:
    return f"{NORM}, r AS (SELECT * FROM ({RULES_SQL})) {select}"


ORACLE["canonical_context_key"] = ORACLE["canonical_context_key"].replace("{RULES}", RULES_SQL)

RULE_COLS = ["flight_phase", "light", "atc_advisory", "cause_category", "context_text", "rows", "n", "support",
             "confidence", "lift", "uplift", "baseline"]


@register("risk_rules", _rules_sql("SELECT * FROM r"))
def q_risk_rules(spark, sf_dir):
    """Condition sets -> elevated risk, one CUBE over the four drivers."""
    return rules.mine_risk_rules(norm(spark, sf_dir)).select(*RULE_COLS)


FILTER_SQL = """uplift >= 1.2 AND NOT isnan(uplift) AND n >= 30 AND NOT coalesce(
  flight_phase IS NULL AND light IS NULL AND cause_category IS NULL
  AND lower(atc_advisory) IN ('na', 'n/a', 'not_available', 'not available'), false)"""


@register("filter_rules", _rules_sql(f"SELECT * FROM r WHERE {FILTER_SQL}"))
def q_filter_rules(spark, sf_dir):
    """the noise filter over G5."""
    return rules.filter_rules(rules.mine_risk_rules(norm(spark, sf_dir))).select(*RULE_COLS)


RANKED_SQL = f"""SELECT *, CAST(row_number() OVER (ORDER BY uplift DESC, n DESC, context_text) AS BIGINT) AS rank
  FROM r WHERE {FILTER_SQL} QUALIFY rank <= 6"""


@register("rank_rules", _rules_sql(RANKED_SQL))
def q_rank_rules(spark, sf_dir):
    """The six strongest rules."""
    return rules.rank_rules(rules.filter_rules(rules.mine_risk_rules(norm(spark, sf_dir)))).select(*RULE_COLS, "rank")


NARRATIVE_SQL = f"""concat('When ', context_text, ', ', CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR),
  '% of incidents were classified elevated risk (~', {S.py_fixed('uplift', 1)}, '× baseline, ',
  CAST(n AS VARCHAR), ' incidents).')"""


@register("rule_narratives", _rules_sql(f"SELECT context_text, n, {NARRATIVE_SQL} AS narrative FROM r WHERE {FILTER_SQL}"))
def q_rule_narratives(spark, sf_dir):
    """The narrative of every reported-quality rule."""
    r = rules.with_narrative(rules.filter_rules(rules.mine_risk_rules(norm(spark, sf_dir))))
    return r.select("context_text", "n", "narrative")


@register("baseline_rate", f"""{NORM} SELECT count(*) AS rows, sum(CAST(risk_high AS BIGINT)) AS elevated,
  CAST(sum(CAST(risk_high AS BIGINT)) AS DOUBLE) / count(*) AS baseline FROM norm""")
def q_baseline(spark, sf_dir):
    """Share of elevated rows."""
    return rules.baseline(norm(spark, sf_dir))


# ------------------------------------------------------------------ descriptive statistics

FACET_SQL = f"""{NORM}, p AS (
  SELECT 'cause_category' AS facet, coalesce(cause_category, 'NA') AS value FROM norm
  UNION ALL SELECT 'flight_phase', coalesce(flight_phase, 'NA') FROM norm
  UNION ALL SELECT 'risk_level', coalesce(risk_level, 'NA') FROM norm),
c AS (SELECT facet, value, count(*) AS n FROM p GROUP BY facet, value),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS BIGINT) AS rank FROM c)"""


@register("facet_counts", f"{FACET_SQL} SELECT * FROM rk WHERE facet = 'risk_level' OR rank <= 10")
def q_facets(spark, sf_dir):
    """G1 over the whole corpus."""
    return stats.facet_counts(norm(spark, sf_dir))


@register("median_miss", f"""{NORM} SELECT median(miss_distance_num) AS median_miss_distance,
  count(miss_distance_num) AS n FROM norm""")
def q_median(spark, sf_dir):
    """Exact global median by distributed selection (no single-task percentile)."""
    n = norm(spark, sf_dir)
    med = stats.exact_quantile(n, "miss_distance_num", 0.5)
    return n.agg(F.count("miss_distance_num").alias("n")).select(
        F.lit(med).cast("double").alias("median_miss_distance"), "n")


@register("temporal_confidence", f"""{NORM} SELECT count(*) AS rows, avg(CASE WHEN month IS NOT NULL THEN 1e0 ELSE 0e0 END) AS coverage,
  CASE WHEN count(*) = 0 THEN 'UNKNOWN' WHEN avg(CASE WHEN month IS NOT NULL THEN 1e0 ELSE 0e0 END) > 0.7 THEN 'HIGH'
       WHEN avg(CASE WHEN month IS NOT NULL THEN 1e0 ELSE 0e0 END) > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS temporal_confidence
FROM norm""")
def q_temporal(spark, sf_dir):
    """G11."""
    return stats.temporal_confidence(norm(spark, sf_dir))


@register("monthly_histogram", f"""{NORM} SELECT month, count(*) AS n, count(*) OVER () > 1 AS shown
FROM norm WHERE month IS NOT NULL GROUP BY month""")
def q_monthly(spark, sf_dir):
    """G12."""
    return stats.monthly_counts(norm(spark, sf_dir))


TOP_PHASE_SQL = """tp AS (SELECT coalesce(flight_phase, 'NA') AS v, count(*) AS c FROM norm GROUP BY 1
  ORDER BY c DESC, v LIMIT 10)"""


@register("phase_risk_crosstab", f"""{NORM}, {TOP_PHASE_SQL},
x AS (SELECT coalesce(flight_phase, 'NA') AS flight_phase, coalesce(risk_level, 'NA') AS risk_level, count(*) AS n
  FROM norm WHERE coalesce(flight_phase, 'NA') IN (SELECT v FROM tp) GROUP BY 1, 2),
t AS (SELECT flight_phase, sum(n) AS row_total FROM x GROUP BY 1),
t2 AS (SELECT *, CAST(row_number() OVER (ORDER BY row_total DESC, flight_phase) AS BIGINT) AS row_rank FROM t)
SELECT x.flight_phase, risk_level, n, CAST(row_total AS BIGINT) AS row_total, row_rank
FROM x JOIN t2 USING (flight_phase)""")
def q_crosstab(spark, sf_dir):
    """G13 long form."""
    return stats.crosstab(norm(spark, sf_dir))


@register("filter_top_categories", f"""{NORM}, {TOP_PHASE_SQL}
SELECT {S.SRC_KEY}, flight_phase FROM norm WHERE coalesce(flight_phase, 'NA') IN (SELECT v FROM tp)""")
def q_top_categories(spark, sf_dir):
    """rows of the ten most frequent phases."""
    return stats.keep_top_values(norm(spark, sf_dir), "flight_phase", 10).select(*KEY, "flight_phase")


@register("top_value_semi_join", f"""{NORM}, {TOP_PHASE_SQL}
SELECT coalesce(flight_phase, 'NA') AS flight_phase, count(*) AS n FROM norm
WHERE coalesce(flight_phase, 'NA') IN (SELECT v FROM tp) GROUP BY 1""")
def q_semi(spark, sf_dir):
    """The semi join of F4, counted per kept value."""
    kept = stats.keep_top_values(norm(spark, sf_dir), "flight_phase", 10)
    return kept.groupBy(F.coalesce("flight_phase", F.lit("NA")).alias("flight_phase")).agg(
        F.count(F.lit(1)).alias("n"))


CRIT_BASE = f"""{NORM}, fl AS (SELECT max(CAST(risk_text_high AS INT)) AS hi, max(CAST(risk_numeric IS NOT NULL AS INT)) AS num FROM norm),
c AS (SELECT norm.*, CASE WHEN fl.hi = 1 THEN 1 WHEN fl.num = 1 THEN 2 ELSE 3 END AS tier FROM norm, fl
  WHERE fl.hi = 0 OR risk_text_high)"""
CRIT_SELECT = f"""SELECT CAST(row_number() OVER (ORDER BY
    CASE WHEN tier = 1 THEN miss_distance_num WHEN tier = 2 THEN -risk_numeric END ASC NULLS LAST,
    CASE WHEN tier = 1 THEN -risk_numeric WHEN tier = 2 THEN miss_distance_num END ASC NULLS LAST,
    {S.SRC_KEY}) AS BIGINT) AS rank,
  report_number, flight_phase, miss_distance_num AS miss_distance, cause_category, risk_level
FROM c QUALIFY rank <= 5"""
CRIT_SQL = f"{CRIT_BASE} {CRIT_SELECT}"


@register("critical5", CRIT_SQL)
def q_critical(spark, sf_dir):
    """T4: the Critical 5."""
    return critical.critical_incidents(norm(spark, sf_dir), KEY)


@register("closest_miss", f"""{NORM} SELECT CAST(row_number() OVER (ORDER BY miss_distance_num ASC NULLS LAST, {S.SRC_KEY}) AS BIGINT) AS rank,
  report_number, miss_distance_num FROM norm QUALIFY rank <= 3""")
def q_closest(spark, sf_dir):
    """T5: the three closest misses of the corpus."""
    return stats.closest(norm(spark, sf_dir), KEY).select("rank", "report_number", "miss_distance_num")


CLUSTER_CTE = f"""{NORM}, cl AS (SELECT *, l_orderkey % 6 AS cluster FROM norm)"""


@register("first_examples", f"""{CLUSTER_CTE}, e AS (SELECT cluster, coalesce(report_number, 'None') AS v,
  row_number() OVER (PARTITION BY cluster ORDER BY {S.SRC_KEY}) AS r FROM cl)
SELECT cluster, string_agg(v, ', ' ORDER BY r) AS examples FROM e WHERE r <= 5 GROUP BY cluster""")
def q_examples(spark, sf_dir):
    """First five report numbers per cluster (cluster = order key mod 6, FIXTURES F-C)."""
    cl = norm(spark, sf_dir).withColumn("cluster", F.col("l_orderkey") % 6)
    return stats.examples(cl, "cluster", KEY)


SPIKE_SQL = """sp AS (SELECT cluster, count(*) AS months, sum(cnt) AS total, max(month) AS last_month,
    arg_max(cnt, month) AS last_count FROM (SELECT cluster, month, count(*) AS cnt FROM cl WHERE month IS NOT NULL
    GROUP BY 1, 2) GROUP BY cluster),
  sp2 AS (SELECT *, CASE WHEN months > 1 THEN CAST(total - last_count AS DOUBLE) / (months - 1) END AS prev_avg FROM sp),
  sp3 AS (SELECT *, CASE WHEN months >= 4 AND prev_avg > 0 THEN last_count / prev_avg END AS spike_factor FROM sp2)"""


@register("spike_factor", f"""{CLUSTER_CTE}, {SPIKE_SQL} SELECT * FROM sp3""")
def q_spike(spark, sf_dir):
    """G9 per cluster."""
    cl = norm(spark, sf_dir).withColumn("cluster", F.col("l_orderkey") % 6)
    return stats.spike_factor(cl, "cluster")


def _topvals_sql(col: str, out: str) -> str:
    return f"""{out}_c AS (SELECT cluster, coalesce(CAST({col} AS VARCHAR), 'NA') AS v, count(*) AS c FROM cl GROUP BY 1, 2),
  {out} AS (SELECT cluster, string_agg(v || ':' || CAST(c AS VARCHAR), ', ' ORDER BY r) AS {out} FROM
    (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, v) AS r FROM {out}_c) WHERE r <= 3 GROUP BY cluster)"""


@register("top_values_string", f"""{CLUSTER_CTE}, {_topvals_sql('flight_phase', 'top_phases')},
  {_topvals_sql('cause_category', 'top_causes')}
SELECT cluster, top_phases, top_causes FROM top_phases JOIN top_causes USING (cluster)""")
def q_top_values(spark, sf_dir):
    """Top three phases and causes per cluster."""
    cl = norm(spark, sf_dir).withColumn("cluster", F.col("l_orderkey") % 6)
    a = stats.top_values(cl, "cluster", "flight_phase", 3, out="top_phases")
    b = stats.top_values(cl, "cluster", "cause_category", 3, out="top_causes")
    return a.join(b, "cluster")


INSIGHTS_SQL = f"""{CLUSTER_CTE}, {SPIKE_SQL}, {_topvals_sql('flight_phase', 'top_phases')},
  {_topvals_sql('cause_category', 'top_causes')},
  ex AS (SELECT cluster, string_agg(v, ', ' ORDER BY r) AS examples FROM (SELECT cluster, coalesce(report_number, 'None') AS v,
    row_number() OVER (PARTITION BY cluster ORDER BY {S.SRC_KEY}) AS r FROM cl) WHERE r <= 5 GROUP BY cluster),
  b AS (SELECT cluster, count(*) AS size, sum(CAST(risk_text_high AS BIGINT)) AS high, avg(risk_numeric) AS avg_risk FROM cl GROUP BY cluster),
  ins AS (SELECT b.cluster, 'n/a' AS label, size, (CAST(high AS DOUBLE) / size) * 100.0 AS pct_high_risk, avg_risk,
    coalesce(avg_risk, 0.0) * (1.0 + CAST(size AS DOUBLE) / greatest(sum(size) OVER (), 1)) AS risk_priority,
    spike_factor, top_phases, top_causes, examples
  FROM b LEFT JOIN sp3 USING (cluster) LEFT JOIN top_phases USING (cluster) LEFT JOIN top_causes USING (cluster)
  LEFT JOIN ex USING (cluster))"""


@register("cluster_insights", f"{INSIGHTS_SQL} SELECT * FROM ins")
def q_insights(spark, sf_dir):
    """G8 with cluster = order key mod 6 (no model; FIXTURES F-C)."""
    cl = norm(spark, sf_dir).withColumn("cluster", F.col("l_orderkey") % 6)
    return clusters.cluster_insights(cl, KEY)


@register("rank_clusters", f"""{INSIGHTS_SQL} SELECT *, CAST(row_number() OVER (ORDER BY risk_priority DESC NULLS LAST, cluster) AS BIGINT) AS rank FROM ins""")
def q_rank_clusters(spark, sf_dir):
    """T9."""
    cl = norm(spark, sf_dir).withColumn("cluster", F.col("l_orderkey") % 6)
    return clusters.rank_clusters(clusters.cluster_insights(cl, KEY))


DISPLAY_SQL = f"""SELECT CAST(cluster AS VARCHAR) AS cluster, label, CAST(size AS VARCHAR) AS size,
  coalesce(CAST({S.py_round('pct_high_risk', 1)} AS VARCHAR), '—') AS pct_high_risk,
  coalesce(CAST({S.py_round('avg_risk', 2)} AS VARCHAR), '—') AS avg_risk,
  coalesce(CAST({S.py_round('risk_priority', 3)} AS VARCHAR), '—') AS risk_priority,
  coalesce(CAST({S.py_round('spike_factor', 2)} AS VARCHAR), '—') AS spike_factor,
  coalesce(top_phases, '—') AS top_phases, coalesce(top_causes, '—') AS top_causes, coalesce(examples, '—') AS examples
FROM ins"""


@register("cluster_display", f"{INSIGHTS_SQL} {DISPLAY_SQL}")
def q_cluster_display(spark, sf_dir):
    """The cluster table as display text (numbers rounded as Python does, null as —)."""
    cl = norm(spark, sf_dir).withColumn("cluster", F.col("l_orderkey") % 6)
    ins = clusters.cluster_insights(cl, KEY).withColumns({
        "pct_high_risk": fnum.py_round("pct_high_risk", 1), "avg_risk": fnum.py_round("avg_risk", 2),
        "risk_priority": fnum.py_round("risk_priority", 3), "spike_factor": fnum.py_round("spike_factor", 2)})
    return normalise.display(ins, ["cluster", "label", "size", "pct_high_risk", "avg_risk", "risk_priority",
                                   "spike_factor", "top_phases", "top_causes", "examples"])


CRIT_DISPLAY_SQL = f"""{CRIT_BASE}, k AS ({CRIT_SELECT})
SELECT coalesce(report_number, '—') AS report_number, coalesce(flight_phase, '—') AS flight_phase,
  coalesce(CAST(miss_distance AS VARCHAR), '—') AS miss_distance, coalesce(cause_category, '—') AS cause_category,
  coalesce(risk_level, '—') AS risk_level FROM k"""


@register("critical_display", CRIT_DISPLAY_SQL)
def q_critical_display(spark, sf_dir):
    """N16 for the Critical 5: text columns, the distance as Python prints it, null as —."""
    c = critical.critical_incidents(norm(spark, sf_dir), KEY)
    c = c.withColumn("miss_distance", fnum.py_float_str("miss_distance"))
    return normalise.display(c, ["report_number", "flight_phase", "miss_distance", "cause_category", "risk_level"])
