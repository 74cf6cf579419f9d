"""Registered queries, part 3: general itemsets and rules, watchlists, text
themes, outliers and the Discover pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sqltext as S
from .functions.text import STOP_WORDS, cluster_text, remove_stop_words, tokens
from .operators import anomalies, critical, filters, narrative, normalise, rules, themes, watchlist
from .queries import CRIT_SELECT, CRIT_BASE, KEY, NORM, RULES_SQL, FILTER_SQL, inc, norm, register
from .session import materialise
from .settings import DEFAULT
from .sources import fixtures

#: The test tables are single files: text and feature inputs are dealt to so many tasks.
PARTITIONS = 16

ATTRS5 = ["flight_phase", "light", "atc_advisory", "cause_category", "risk_level"]
ATTRS4 = ["flight_phase", "light", "atc_advisory", "cause_category"]


def itemsets5(spark, sf_dir, rows=None):
    return rules.frequent_itemsets(norm(spark, sf_dir) if rows is None else rows, ATTRS5, DEFAULT.min_support)


def watch_rows(spark, sf_dir):
    """The incident columns that rules and Critical 5 read, joined and written once for the queries that need both."""
    columns = dict.fromkeys([*KEY, "report_number", *DEFAULT.drivers, "risk_level", "miss_distance"])
    return normalise.normalise_incidents(materialise(inc(spark, sf_dir).select(*columns), "watch-rows"))


def _tok_sql(a: str) -> str:
    return f"CASE WHEN GROUPING({a}) = 0 THEN '{a}_' || {a} END"


def itemsets_sql(attrs, target=None) -> str:
    cols = list(attrs) + ([target] if target else [])
    toks = [_tok_sql(a) for a in attrs] + ([f"CASE WHEN GROUPING({target}) = 0 AND {target} THEN '{target}' END"]
                                           if target else [])
    where_t = f" AND (GROUPING({target}) = 1 OR {target})" if target else ""
    sel = ", ".join(f"{S.driver(a)} AS {a}" for a in attrs) + (f", {target}" if target else "")
    return f"""d5 AS MATERIALIZED (SELECT {sel} FROM norm),
  t5 AS (SELECT count(*) AS total FROM d5),
  c5 AS (SELECT list_sort(list_filter([{', '.join(toks)}], lambda x: x IS NOT NULL)) AS itemset, count(*) AS count
    FROM d5 GROUP BY CUBE ({', '.join(cols)}) HAVING true{where_t}),
  fi AS MATERIALIZED (SELECT itemset, array_to_string(itemset, chr(1)) AS ik, CAST(len(itemset) AS BIGINT) AS size, count, CAST(count AS DOUBLE) / total AS support
    FROM c5, t5 WHERE len(itemset) > 0 AND CAST(count AS DOUBLE) / total >= 0.02)"""


FI5 = f"{NORM}, {itemsets_sql(ATTRS5)}"


@register("frequent_itemsets", f"""{FI5} SELECT array_to_string(itemset, ' & ') AS itemset, size, count, support FROM fi""")
def q_itemsets(spark, sf_dir):
    """Every token set with support >= 2 % over five attributes, level by level."""
    return itemsets5(spark, sf_dir).select(F.array_join("itemset", " & ").alias("itemset"), "size", "count", "support")


def rules_sql(fi_cte: str) -> str:
    return f"""{fi_cte},
  sp AS MATERIALIZED (SELECT itemset, count, support, m FROM fi, range(1, CAST(pow(2, len(itemset)) AS BIGINT) - 1) AS g(m)
    WHERE len(itemset) >= 2),
  sp2 AS MATERIALIZED (SELECT *, array_to_string(antecedents, chr(1)) AS ak, array_to_string(consequents, chr(1)) AS ck FROM (
    SELECT itemset, count, support, list_filter(itemset, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS antecedents,
    list_filter(itemset, lambda x, i: ((m >> (i - 1)) & 1) = 0) AS consequents FROM sp)),
  ar AS MATERIALIZED (SELECT sp2.antecedents, sp2.consequents, a.support AS antecedent_support, c.support AS consequent_support,
    sp2.support, sp2.count, sp2.support / a.support AS confidence
    FROM sp2 JOIN fi a ON a.ik = ak JOIN fi c ON c.ik = ck),
  ar2 AS (SELECT *, confidence / consequent_support AS lift,
    support - antecedent_support * consequent_support AS leverage,
    CASE WHEN confidence < 1.0 THEN (1.0 - consequent_support) / (1.0 - confidence) ELSE 'inf'::DOUBLE END AS conviction
    FROM ar)"""


RULES5 = rules_sql(FI5)
AR_COLS = ("array_to_string(antecedents, ' & ') AS antecedents, array_to_string(consequents, ' & ') AS consequents, "
           "antecedent_support, consequent_support, support, count, confidence, lift, leverage, conviction")


def _flat_rules(r):
    return r.select(F.array_join("antecedents", " & ").alias("antecedents"),
                    F.array_join("consequents", " & ").alias("consequents"), "antecedent_support",
                    "consequent_support", "support", "count", "confidence", "lift", "leverage", "conviction")


@register("association_rules", f"{RULES5} SELECT {AR_COLS} FROM ar2 WHERE lift >= 1.0")
def q_assoc(spark, sf_dir):
    """All rules with lift >= 1 from the G6 itemsets."""
    return _flat_rules(rules.association_rules(itemsets5(spark, sf_dir), "lift", 1.0))


@register("rule_subset_join", f"""{RULES5} SELECT array_to_string(antecedents, ' & ') AS antecedents,
  array_to_string(consequents, ' & ') AS consequents, antecedent_support, consequent_support, support FROM ar2""")
def q_subset_join(spark, sf_dir):
    """Every (antecedent, consequent) split joined to both supports, before any metric filter."""
    r = rules.association_rules(itemsets5(spark, sf_dir), "lift", float("-inf"))
    return r.select(F.array_join("antecedents", " & ").alias("antecedents"),
                    F.array_join("consequents", " & ").alias("consequents"), "antecedent_support",
                    "consequent_support", "support")


RULES_T = rules_sql(f"{NORM}, {itemsets_sql(ATTRS4, 'risk_high')}")


@register("consequent_filter", f"""{RULES_T} SELECT {AR_COLS} FROM ar2
  WHERE lift >= 1.0 AND len(consequents) = 1 AND consequents[1] = 'risk_high'""")
def q_only_target(spark, sf_dir):
    """F8: the generic path (G6 with the elevated flag as an item -> G7) kept to
    consequent = {risk_high}; the same rules as the single-cube G5."""
    fi = rules.frequent_itemsets(norm(spark, sf_dir), ATTRS4, DEFAULT.min_support, target="risk_high")
    return _flat_rules(rules.only_target(rules.association_rules(fi, "lift", 1.0)))


STRONG_WHERE = """lift >= 1.0 AND confidence >= 0.6 AND lift >= 1.5 AND count >= 10
  AND len(list_filter(consequents, lambda t: starts_with(t, 'risk_level'))) > 0"""


@register("filter_strong_rules", f"{RULES5} SELECT {AR_COLS} FROM ar2 WHERE {STRONG_WHERE}")
def q_strong(spark, sf_dir):
    """confidence >= 0.6, lift >= 1.5, >= 10 rows, a risk-level consequent."""
    return _flat_rules(rules.filter_strong_rules(strong_rules(spark, sf_dir)))


def _pretty_list(lst: str) -> str:
    from .queries import _pretty_sql

    return f"list_transform({lst}, lambda t: {_pretty_sql('t')})"


SENTENCE_SQL = f"""'When ' || CASE WHEN len(list_filter(antecedents, lambda t: NOT starts_with(t, 'risk_level'))) > 0
    THEN array_to_string({_pretty_list("list_filter(antecedents, lambda t: NOT starts_with(t, 'risk_level'))")}, ' and ')
    ELSE 'these conditions' END || ', ' || CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR)
  || '% of incidents were classified ' || (CASE
    WHEN contains(lower(array_to_string(list_filter(consequents, lambda t: starts_with(t, 'risk_level')), ' ')), 'high') THEN 'High risk'
    WHEN contains(lower(array_to_string(list_filter(consequents, lambda t: starts_with(t, 'risk_level')), ' ')), 'med') THEN 'Medium risk'
    WHEN contains(lower(array_to_string(list_filter(consequents, lambda t: starts_with(t, 'risk_level')), ' ')), 'low') THEN 'Low risk'
    ELSE 'elevated risk' END)
  || ', ~' || CAST({S.py_round('lift', 1)} AS VARCHAR) || '× the baseline rate (' || CAST(count AS VARCHAR) || ' incidents).'"""

STRONG_SENT = f"""{RULES5}, ss AS (SELECT *, {SENTENCE_SQL} AS sentence,
    array_to_string(antecedents, ',') AS a_txt, array_to_string(consequents, ',') AS c_txt FROM ar2 WHERE {STRONG_WHERE}),
  g15 AS (SELECT sentence, min((-lift, -confidence, a_txt, c_txt)) AS pos FROM ss GROUP BY sentence),
  g15r AS (SELECT sentence, CAST(row_number() OVER (ORDER BY pos) AS BIGINT) AS ord FROM g15 QUALIFY ord <= 5)"""


def strong_rules(spark, sf_dir, rows=None):
    """Rules that may be strong: consequents are grown only while the confidence that strong rules need is held."""
    return rules.association_rules(itemsets5(spark, sf_dir, rows), "lift", 1.0, min_confidence=0.6)


@register("strong_rule_narratives", f"""{STRONG_SENT} SELECT array_to_string(antecedents, ' & ') AS antecedents,
  array_to_string(consequents, ' & ') AS consequents, sentence FROM ss""")
def q_strong_narr(spark, sf_dir):
    """The sentence of every strong rule (with N13 and N14 inside)."""
    s = rules.strong_rule_sentences(rules.filter_strong_rules(strong_rules(spark, sf_dir)))
    return s.select(F.array_join("antecedents", " & ").alias("antecedents"),
                    F.array_join("consequents", " & ").alias("consequents"), "sentence")


@register("distinct_narratives", f"{STRONG_SENT} SELECT ord, sentence FROM g15r")
def q_distinct(spark, sf_dir):
    """Distinct sentences, first five in rule order."""
    return narrative.strong_narratives(strong_rules(spark, sf_dir)).select("ord", "sentence")


def crit(rows):
    return critical.critical_incidents(rows, KEY)


CRIT_CTE = CRIT_BASE.split("WITH ", 1)[1].split(", fl AS", 1)[1]
CRIT_CTES = f"fl AS{CRIT_CTE}, crit AS ({CRIT_SELECT})"


def _items_sql(sent_cte: str) -> str:
    ctx = f"""CASE WHEN starts_with(lower(sentence), 'when ') THEN {S.strip("split_part(substr(sentence, 6), ',', 1)")} ELSE '' END"""
    return f"""it AS (SELECT ord, {ctx} AS context, sentence AS severity_statement,
    TRY_CAST(nullif(regexp_extract(sentence, '(\\d+)% of incidents', 1), '') AS INT) AS pct,
    TRY_CAST(nullif(regexp_extract(sentence, '~([0-9.]+)×', 1), '') AS DOUBLE) AS lift,
    TRY_CAST(nullif(regexp_extract(sentence, '\\((\\d+)\\s+incidents\\)', 1), '') AS BIGINT) AS volume
    FROM {sent_cte}),
  it2 AS (SELECT *, CASE WHEN lift IS NOT NULL AND volume IS NOT NULL THEN {S.py_round('lift * log10(volume + 1)', 2)} END AS risk_index,
    CASE WHEN contains(lower(context), 'parked') OR contains(lower(context), 'lighting') THEN 'Audit ramp / ground handling in low or no lighting.'
      WHEN contains(lower(context), 'cruise') AND contains(lower(context), 'pilot') THEN 'Review workload management and checklist discipline in cruise.'
      WHEN contains(lower(context), 'taxi') THEN 'Review surface movement / taxi guidance and clearances.'
      ELSE 'Requires operational review.' END AS action_hint FROM it),
  ev AS (SELECT it2.ord, list(coalesce(crit.report_number, 'None') ORDER BY crit.rank)[1:5] AS evidence
    FROM it2 JOIN crit ON lower(coalesce(crit.flight_phase, 'None')) <> ''
      AND contains(lower(it2.context), lower(coalesce(crit.flight_phase, 'None'))) GROUP BY it2.ord),
  it3 AS (SELECT it2.*, coalesce(ev.evidence, []) AS evidence FROM it2 LEFT JOIN ev USING (ord))"""


WATCH_TEXT_SQL = f"""{STRONG_SENT}, {CRIT_CTES}, {_items_sql('g15r')}"""


def text_items(spark, sf_dir):
    rows = watch_rows(spark, sf_dir)
    sents = narrative.strong_narratives(strong_rules(spark, sf_dir, rows))
    return watchlist.watchlist_from_text(sents, crit(rows), k=1 << 30)


@register("attach_evidence", f"""{WATCH_TEXT_SQL} SELECT ord, context, array_to_string(evidence, ', ') AS evidence FROM it3""")
def q_attach_evidence(spark, sf_dir):
    """Critical incidents whose phase occurs in each watch item's context."""
    return text_items(spark, sf_dir).select("ord", "context", F.array_join("evidence", ", ").alias("evidence"))


@register("watchlist_from_text", f"""{WATCH_TEXT_SQL}
SELECT CAST(row_number() OVER (ORDER BY coalesce(risk_index, pct / 10.0, 0.0) DESC, ord) AS BIGINT) AS rank,
  context, pct, lift, volume, risk_index, action_hint, array_to_string(evidence, ', ') AS evidence FROM it3 QUALIFY rank <= 3""")
def q_watch_text(spark, sf_dir):
    """Watch items parsed back from the strong-rule sentences, top 3 by risk index."""
    rows = watch_rows(spark, sf_dir)
    sents = narrative.strong_narratives(strong_rules(spark, sf_dir, rows))
    w = watchlist.watchlist_from_text(sents, crit(rows))
    return w.select("rank", "context", "pct", "lift", "volume", "risk_index", "action_hint",
                    F.array_join("evidence", ", ").alias("evidence"))


NARR_SQL = f"""concat('When ', context_text, ', ', CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR),
  '% of incidents were classified elevated risk (~', {S.py_fixed('uplift', 1)}, '× baseline, ',
  CAST(n AS VARCHAR), ' incidents).')"""

DEDUPE_SQL = f"""{STRONG_SENT}, {CRIT_CTES},
  r AS (SELECT * FROM ({RULES_SQL})),
  w1 AS (SELECT {NARR_SQL} AS sentence, context_text FROM r WHERE {FILTER_SQL}),
  allsent AS (SELECT CAST(ord AS BIGINT) AS ord, sentence FROM g15r
    UNION ALL SELECT 100 + row_number() OVER (ORDER BY context_text), sentence FROM w1),
  {_items_sql('allsent')},
  dd AS (SELECT lower({S.strip('context')}) AS context_key,
      arg_min({S.strip('context')}, ord) AS context,
      arg_max(severity_statement, (risk_index IS NOT NULL, risk_index, -ord)) AS severity_statement,
      arg_max(action_hint, (risk_index IS NOT NULL, risk_index, -ord)) AS action_hint,
      max(risk_index) AS risk_index, list_sort(list_distinct(flatten(list(evidence)))) AS evidence, min(ord) AS first_ord
    FROM it3 GROUP BY 1)
SELECT context_key, context, severity_statement, action_hint, risk_index, array_to_string(evidence, ', ') AS evidence,
  first_ord, CAST(row_number() OVER (ORDER BY risk_index DESC NULLS LAST, first_ord) AS BIGINT) AS rank,
  CASE WHEN risk_index IS NULL THEN '—' ELSE CAST({S.py_round('risk_index', 2)} AS VARCHAR) END AS risk_index_display FROM dd"""


@register("dedupe_watchlist", DEDUPE_SQL)
def q_dedupe_watch(spark, sf_dir):
    """Items from the strong-rule sentences and the rule narratives merged by context."""
    rows = watch_rows(spark, sf_dir)
    sents = narrative.strong_narratives(strong_rules(spark, sf_dir, rows)).select("ord", "sentence")
    w1 = rules.with_narrative(rules.filter_rules(rules.mine_risk_rules(rows)))
    from pyspark.sql import Window

    w1 = w1.select((F.lit(100) + F.row_number().over(Window.orderBy("context_text"))).alias("ord"),
                   F.col("narrative").alias("sentence"))
    items = watchlist.watchlist_from_text(sents.unionByName(w1), crit(rows), k=1 << 30)
    d = watchlist.dedupe_watchlist(items)
    return d.select("context_key", "context", "severity_statement", "action_hint", "risk_index",
                    F.array_join("evidence", ", ").alias("evidence"), "first_ord", "rank", "risk_index_display")


RULE_WATCH_SQL = f"""{NORM}, r AS (SELECT * FROM ({RULES_SQL})),
  rr AS (SELECT *, row_number() OVER (ORDER BY uplift DESC, n DESC, context_text) AS rule_rank FROM r WHERE {FILTER_SQL}
    QUALIFY rule_rank <= 6),
  wl AS (SELECT rule_rank, context_text AS context, {NARR_SQL} AS severity_statement, {S.py_round('coalesce(uplift, 0.0)', 2)} AS uplift_x,
    n AS exposure_incidents, CASE WHEN coalesce(uplift, 0.0) >= 2.0 THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
    CASE WHEN contains(lower(context_text), 'final approach') OR contains(lower(context_text), 'initial approach') OR contains(lower(context_text), 'approach') THEN 'Crew SOP / approach stability review.'
      WHEN contains(lower(context_text), 'lighting') OR contains(lower(context_text), 'not_available') OR contains(lower(context_text), 'night') THEN 'Ramp / ground handling in low/no lighting.'
      WHEN contains(lower(context_text), 'equipment failure') OR contains(lower(context_text), 'failure') THEN 'Review abnormal / emergency procedures and redundancy.'
      WHEN contains(lower(context_text), 'initial climb') OR contains(lower(context_text), 'climb') THEN 'Review climb-out workload and callout discipline.'
      WHEN contains(lower(context_text), 'descent') OR contains(lower(context_text), 'landing') THEN 'Stabilised descent / landing discipline review.'
      ELSE 'Audit procedures & briefing in this context.' END AS action_hint FROM rr),
  wr AS (SELECT *, CAST(row_number() OVER (ORDER BY uplift_x * greatest(exposure_incidents, 1) DESC, rule_rank) AS BIGINT) AS rank
    FROM wl QUALIFY rank <= 5)"""


def rule_watch(spark, sf_dir):
    return watchlist.watchlist(rules.risk_rules_report(norm(spark, sf_dir)))


@register("watchlist", f"""{RULE_WATCH_SQL} SELECT rank, context, severity_statement, uplift_x, exposure_incidents, priority,
  action_hint FROM wr""")
def q_watchlist(spark, sf_dir):
    """The watchlist from the top six rules."""
    return rule_watch(spark, sf_dir).select("rank", "context", "severity_statement", "uplift_x",
                                            "exposure_incidents", "priority", "action_hint")


@register("headlines", f"""{RULE_WATCH_SQL} SELECT coalesce(string_agg('- ' || context || ': ' || coalesce(severity_statement, 'None'),
  chr(10) ORDER BY rank) FILTER (WHERE rank <= 3), 'None.') AS headlines FROM wr""")
def q_headlines(spark, sf_dir):
    """The first three watch items as headline lines."""
    return narrative.headlines(rule_watch(spark, sf_dir))


# ------------------------------------------------------------------ text themes

STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"
TOK_SQL = f"""list_filter(regexp_extract_all(lower(coalesce(synopsis, '') || ' ' || coalesce(primary_problem, '') || ' ' || coalesce(full_narrative, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
  lambda t: NOT list_contains({STOP_SQL}, t))"""


@register("tokenise", f"""WITH {S.TXT}, t AS (SELECT doc_id, {TOK_SQL} AS toks FROM incident_texts)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM t""")
def q_tokenise(spark, sf_dir):
    """M1 over every document's whole joined text."""
    d = cluster_text(fixtures.incident_texts(spark, sf_dir)).withColumn("_raw", tokens("cluster_text"))
    d = remove_stop_words(d, "_raw", "toks")
    return d.select("doc_id", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


TFIDF_SQL = f"""WITH {S.TXT},
  nd AS (SELECT count(*) AS n FROM incident_texts),
  tt AS (SELECT doc_id, unnest({TOK_SQL}) AS term FROM incident_texts),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM tt GROUP BY ALL),
  ts AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term),
  vocab AS (SELECT term, ln((1 + CAST(n AS DOUBLE)) / (1 + CAST(df AS DOUBLE))) + 1 AS idf FROM ts, nd ORDER BY total DESC, term LIMIT 5000),
  w AS (SELECT doc_id, term, tf, tf * idf AS w FROM tf JOIN vocab USING (term)),
  wn AS (SELECT doc_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


def tfidf_docs(spark, sf_dir):
    d = cluster_text(fixtures.incident_texts(spark, sf_dir))
    return themes.tfidf(d, "doc_id", "cluster_text", DEFAULT.vocab_size, input_partitions=PARTITIONS)


@register("tfidf", f"{TFIDF_SQL} SELECT doc_id, term, tf, round(weight, 9) AS weight FROM wn")
def q_tfidf(spark, sf_dir):
    """M2: TF-IDF of every document, top 5000 terms, smoothed idf + 1, L2 (weights to 9 dp)."""
    w, _ = tfidf_docs(spark, sf_dir)
    return w.select("doc_id", "term", "tf", F.round("weight", 9).alias("weight"))


@register("cluster_count", """SELECT count(*) AS rows, CAST(greatest(4, least(12, greatest(1, count(*) // 200))) AS BIGINT) AS k
FROM documents""")
def q_cluster_count(spark, sf_dir):
    """M3 on the document count."""
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count("*").alias("rows"))
    return n.select("rows", themes.cluster_count_column(F.col("rows")).alias("k"))


LABELS_SQL = f"""{TFIDF_SQL}, a AS (SELECT doc_id, lang AS cluster FROM incident_texts),
  sz AS (SELECT cluster, count(*) AS size FROM a GROUP BY cluster),
  cw AS (SELECT cluster, term, sum(weight) AS s FROM wn JOIN a USING (doc_id) GROUP BY ALL),
  cm AS (SELECT cw.cluster, term, s / size AS mean_weight FROM cw JOIN sz USING (cluster)),
  top AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(mean_weight, 12) DESC, term) AS r FROM cm QUALIFY r <= 5),
  lab AS (SELECT cluster, string_agg(term, ', ' ORDER BY r) AS cluster_label FROM top GROUP BY cluster)"""


def lang_labels(spark, sf_dir):
    w, _ = tfidf_docs(spark, sf_dir)
    a = fixtures.incident_texts(spark, sf_dir).select("doc_id", F.col("lang").alias("cluster"))
    return themes.cluster_labels(w, a, "doc_id", "cluster"), a


@register("cluster_labels", f"{LABELS_SQL} SELECT cluster, cluster_label FROM lab")
def q_cluster_labels(spark, sf_dir):
    """M5: the five heaviest mean TF-IDF terms of each group (the language as the assignment)."""
    lab, _ = lang_labels(spark, sf_dir)
    return lab


@register("attach_cluster_label", f"{LABELS_SQL} SELECT doc_id, cluster, cluster_label FROM a LEFT JOIN lab USING (cluster)")
def q_attach_labels(spark, sf_dir):
    """Each document with its group's label."""
    lab, a = lang_labels(spark, sf_dir)
    return themes.attach_labels(a, lab).select("doc_id", "cluster", "cluster_label")


@register("cluster_themes")
def q_themes(spark, sf_dir):
    """M4: k-means themes of every document (10 seeded restarts; rows only)."""
    d = fixtures.incident_texts(spark, sf_dir)
    assign, _ = themes.cluster_themes(d, "doc_id", DEFAULT.with_(input_partitions=PARTITIONS))
    return assign


@register("cluster_themes_summary", """SELECT count(*) AS n_rows, count(*) AS labelled, true AS in_range FROM documents""")
def q_themes_summary(spark, sf_dir):
    """M4 as invariants: every document in one theme, themes in range, each with a label."""
    themed = q_themes(spark, sf_dir)
    n = themed.agg(F.count("*").alias("n_rows"), F.sum((F.col("cluster_label") != "").cast("int")).cast("long").alias("labelled"),
                   F.min("cluster").alias("lo"), F.max("cluster").alias("hi"))
    return n.select("n_rows", "labelled", ((F.col("lo") >= 0) & (F.col("hi") < themes.cluster_count_column(F.col("n_rows")))).alias("in_range"))


@register("nearest_centroid", f"""WITH {S.VEC},
  ex AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x,
    generate_subscripts(embedding, 1) AS i FROM incident_vectors) GROUP BY label, i),
  ce AS (SELECT label AS cluster, list(m ORDER BY i) AS centroid FROM ex GROUP BY label),
  d AS (SELECT v.vec_id, ce.cluster, round(list_distance(CAST(v.embedding AS DOUBLE[]), ce.centroid), 9) AS distance
    FROM incident_vectors v, ce)
SELECT vec_id, CAST(arg_min(cluster, (distance, cluster)) AS BIGINT) AS cluster, min(distance) AS distance FROM d GROUP BY vec_id""")
def q_nearest(spark, sf_dir):
    """M6: every vector to its closest label centroid (centroid = per-dimension mean)."""
    v = fixtures.incident_vectors(spark, sf_dir)
    cents = themes.centroids_by(v, "label").withColumnRenamed("label", "cluster")
    return themes.assign_nearest(v.select("vec_id", "embedding"), cents).select("vec_id", "cluster", "distance")


# ------------------------------------------------------------------ outliers


@register("anomaly_features", f"""{NORM} SELECT {S.SRC_KEY}, miss_distance_num, altitude_num,
  CAST(hour_of_day AS DOUBLE) AS hour_num FROM norm""")
def q_features(spark, sf_dir):
    """M8: the three outlier features (no column is all null here)."""
    return anomalies.anomaly_features(norm(spark, sf_dir)).select(*KEY, *anomalies.FEATURES)


def forest_sql(trees: int = DEFAULT.iforest_trees, psi: int = DEFAULT.iforest_sample) -> str:
    """CTEs that grow the same isolation forest: ``scored`` has every incident's score and flag. Trees are grown to the depth
    of a full sample, so tables of fewer than ``psi`` rows are not covered."""
    depth, seed = (psi - 1).bit_length(), DEFAULT.seed
    fraction = lambda text: f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    keys = " || ':' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in KEY)
    number = lambda what: fraction(f"'{seed}:' || t || ':' || node || ':{what}'")
    ctes = [f"""md AS (SELECT coalesce(median(miss_distance_num), 0) AS m0, coalesce(median(altitude_num), 0) AS m1,
    coalesce(median(CAST(hour_of_day AS DOUBLE)), 0) AS m2, count(*) AS n FROM norm)""",
            f"""ft AS MATERIALIZED (SELECT norm.*, row_number() OVER () AS rid, coalesce(miss_distance_num, m0)::DOUBLE AS x0, coalesce(altitude_num, m1)::DOUBLE AS x1,
    coalesce(CAST(hour_of_day AS DOUBLE), m2)::DOUBLE AS x2, n, {fraction(f"'{seed}:' || {keys}")} AS u FROM norm, md)""",
            f"""sm AS (SELECT t, x0, x1, x2, 1::BIGINT AS node FROM (SELECT t, x0, x1, x2, n, (u - t / {float(trees)}::DOUBLE) - floor(u - t / {float(trees)}::DOUBLE) AS h
    FROM ft, range({trees}) AS g(t)) WHERE h < least(1.0, {4 * psi + 64}.0 / n) QUALIFY row_number() OVER (PARTITION BY t ORDER BY h, x0, x1, x2) <= {psi})"""]
    rows = "sm"
    for d in range(depth):
        ctes.append(f"""a{d} AS MATERIALIZED (SELECT *, v[CAST(floor({number('feature')} * len(v)) AS INT) + 1] AS f FROM (SELECT t, node, count(*) AS size,
      [min(x0), min(x1), min(x2)] AS lo, [max(x0), max(x1), max(x2)] AS hi,
      list_filter([1, 2, 3], lambda i: [max(x0), max(x1), max(x2)][i] > [min(x0), min(x1), min(x2)][i]) AS v FROM {rows} GROUP BY t, node) WHERE len(v) > 0)""")
        ctes.append(f"""c{d} AS MATERIALIZED (SELECT t, node, f, lo[f] + {number('cut')} * (hi[f] - lo[f]) AS thr FROM a{d})""")
        ctes.append(f"""r{d} AS MATERIALIZED (SELECT s.t, x0, x1, x2, CASE WHEN f IS NULL THEN s.node ELSE 2 * s.node + ([x0, x1, x2][f] >= thr)::BIGINT END AS node
    FROM {rows} s LEFT JOIN c{d} c ON c.t = s.t AND c.node = s.node)""")
        rows = f"r{d}"
    inner = " UNION ALL ".join(f"SELECT t, node, f, thr FROM c{d}" for d in range(depth))
    size = 2 ** (depth + 1) - 1
    ctes.append(f"""lf AS (SELECT t, node, count(*) AS size FROM {rows} GROUP BY t, node)""")
    ctes.append(f"""nd AS MATERIALIZED (SELECT g.t, list(f ORDER BY g.node) AS nf, list(thr ORDER BY g.node) AS nt,
    list(CAST(round(1000000 * (floor(log2(g.node)) + CASE WHEN size <= 1 THEN 0.0 WHEN size = 2 THEN 1.0
      ELSE 2.0 * (ln(size - 1) + {anomalies._EULER}) - 2.0 * (size - 1) / size END)) AS BIGINT) ORDER BY g.node) AS np
    FROM (SELECT t, node FROM range({trees}) AS x(t), range(1, {size + 1}) AS y(node)) g LEFT JOIN ({inner}) i ON i.t = g.t AND i.node = g.node
    LEFT JOIN lf ON lf.t = g.t AND lf.node = g.node GROUP BY g.t)""")
    walk = "SELECT rid, x0, x1, x2, nf, nt, np, 1::BIGINT AS node FROM ft, nd"
    for _ in range(depth):
        walk = (f"SELECT rid, x0, x1, x2, nf, nt, np, CASE WHEN nf[node] IS NULL THEN node ELSE 2 * node + "
                f"((CASE nf[node] WHEN 1 THEN x0 WHEN 2 THEN x1 ELSE x2 END) >= nt[node])::BIGINT END AS node FROM ({walk})")
    normal = anomalies.c_factor(psi)
    ctes.append(f"""pl AS (SELECT rid, round(pow(2.0, -(sum(np[node])::DOUBLE / {trees * anomalies.MICRO}.0) / {normal!r}::DOUBLE), {anomalies.SCORE_DIGITS}) AS score FROM ({walk}) GROUP BY rid)""")
    ctes.append(f"""scored AS (SELECT ft.*, score, score > (SELECT quantile_cont(score, {1 - DEFAULT.contamination!r}) FROM pl) AS anomaly FROM ft JOIN pl USING (rid))""")
    return f"{NORM}, {', '.join(ctes)}"


def flags(rows):
    return anomalies.detect_anomalies(rows, KEY, DEFAULT.with_(input_partitions=PARTITIONS))


def flag_rows(spark, sf_dir):
    """The incidents that are flagged and get their flags back, joined and written once."""
    columns = dict.fromkeys([*KEY, *filters.OUTLIER_COLUMNS, "hour_of_day"])
    return materialise(norm(spark, sf_dir).select(*columns), "flag-rows")


@register("detect_anomalies", f"{forest_sql()} SELECT {S.SRC_KEY}, score, anomaly FROM scored")
def q_anomalies(spark, sf_dir):
    """M7: isolation-forest score and flag for every incident."""
    return flags(norm(spark, sf_dir))


@register("attach_anomaly", f"{forest_sql()} SELECT {S.SRC_KEY}, report_number, anomaly FROM scored")
def q_attach_anomaly(spark, sf_dir):
    """The forest's flags by key put back on the incident rows; rows without a flag are false."""
    rows = flag_rows(spark, sf_dir)
    return anomalies.attach_anomaly(rows, flags(rows), KEY).select(*KEY, "report_number", "anomaly")


@register("outlier_rows", f"""{forest_sql()} SELECT report_number, miss_distance, altitude, flight_phase, cause_category, risk_level
FROM scored WHERE anomaly ORDER BY {S.SRC_KEY} LIMIT 20""")
def q_outliers(spark, sf_dir):
    """the first 20 rows that the forest flags, display columns."""
    rows = flag_rows(spark, sf_dir)
    return filters.outliers(anomalies.attach_anomaly(rows, flags(rows), KEY), KEY, 20)


@register("outliers_flagged", f"{forest_sql()} SELECT count(score) AS n_rows, count(*) FILTER (anomaly) AS flagged, round(min(score) FILTER (anomaly), 6) AS least_flagged FROM scored")
def q_outliers_flagged(spark, sf_dir):
    """M7 in short: rows scored, rows flagged, and the least score flagged."""
    x = flags(norm(spark, sf_dir))
    return x.agg(F.count("score").alias("n_rows"), F.count_if("anomaly").alias("flagged"), F.round(F.min(F.when(F.col("anomaly"), F.col("score"))), 6).alias("least_flagged"))


# ------------------------------------------------------------------ sink, pipeline


@register("write_bundle", f"""{NORM}, r AS (SELECT * FROM ({RULES_SQL}))
SELECT context_text, n, support, confidence, lift, uplift,
  CAST(row_number() OVER (ORDER BY uplift DESC, n DESC, context_text) AS BIGINT) AS rank FROM r WHERE {FILTER_SQL}
QUALIFY rank <= 6""")
def q_write_bundle(spark, sf_dir):
    """The ranked rules and Critical 5 written as a JSON briefing pack by the
    executors, the rules table read back."""
    from .session import scratch_path
    from .sources.sinks import write_bundle

    n = norm(spark, sf_dir)
    ranked = rules.rank_rules(rules.filter_rules(rules.mine_risk_rules(n))).select(
        "context_text", "n", "support", "confidence", "lift", "uplift", "rank")
    paths = write_bundle({"rules": ranked, "critical5": critical.critical_incidents(n, KEY)},
                         scratch_path(spark, "bundle"), fmt="json")
    return spark.read.schema(ranked.schema).json(paths["rules"])


@register("discover")
def q_discover(spark, sf_dir):
    """P2 (+W6, W7): Discover by seeded sweep over the vector incidents with their
    narratives; the bundle as one JSON row (rows only)."""
    from .plans.discover import discover

    inc = fixtures.vectors_with_text(spark, sf_dir)
    out = discover(inc, DEFAULT.with_(analysis_date="2026-01-01"), sample="sweep")
    return out["bundle"].select(F.to_json(F.struct("*")).alias("bundle"))


@register("run_metadata", f"""{NORM}, c AS (SELECT count(*) AS n, avg(CAST(month IS NOT NULL AS INT)) AS cov FROM norm)
SELECT '2026-01-01' AS generated_at, n AS sample_size, CASE WHEN n = 0 THEN 'UNKNOWN' WHEN cov > 0.7 THEN 'HIGH' WHEN cov > 0.3 THEN 'MEDIUM' ELSE 'LOW' END
  AS temporal_confidence, 'incidents' AS source, 'none' AS summary_model, CAST(42 AS BIGINT) AS seed,
  'Full scan of ''incidents'': every incident analysed.' AS method FROM c""")
def q_meta(spark, sf_dir):
    """The audit row of a full-table Discover run over the structured incidents."""
    from .plans.discover import methodology, run_metadata
    from .operators import stats

    n = norm(spark, sf_dir)
    conf = stats.temporal_confidence(n).first()
    settings = DEFAULT.with_(analysis_date="2026-01-01")
    return run_metadata(spark, conf["rows"], conf["temporal_confidence"], settings,
                        methodology(settings, "all", None))


@register("discover_bundle")
def q_bundle(spark, sf_dir):
    """The Discover bundle of a full-table run over the incidents with their narratives, as one
    JSON row (rows only)."""
    from .plans.discover import discover

    out = discover(fixtures.incidents_with_text(spark, sf_dir), DEFAULT.with_(analysis_date="2026-01-01", input_partitions=PARTITIONS),
                   key_cols=KEY, order_cols=KEY)
    return out["bundle"].select(F.to_json(F.struct("*")).alias("bundle"))


@register("discover_bundle_parts", f"""{CRIT_BASE}, r AS (SELECT * FROM ({RULES_SQL})),
  rk AS (SELECT * FROM r WHERE {FILTER_SQL} QUALIFY row_number() OVER (ORDER BY uplift DESC, n DESC, context_text) <= {DEFAULT.rules_reported}),
  cr AS ({CRIT_SELECT}),
  cv AS (SELECT count(*) AS n, avg(CAST(month IS NOT NULL AS INT)) AS cov FROM norm)
SELECT 'rule' AS part, context_text AS name, n, uplift AS value FROM rk
UNION ALL SELECT 'critical', report_number, rank, miss_distance FROM cr
UNION ALL SELECT 'sample', CASE WHEN n = 0 THEN 'UNKNOWN' WHEN cov > 0.7 THEN 'HIGH' WHEN cov > 0.3 THEN 'MEDIUM' ELSE 'LOW' END, n, NULL FROM cv
UNION ALL SELECT 'run', 'Full scan of ''incidents'': every incident analysed.', {DEFAULT.seed}, NULL""")
def q_bundle_parts(spark, sf_dir):
    """The parts of the full-table bundle that SQL can repeat (rules, Critical 5, sample, run),
    read out of the finished bundle row. Themes are not compared, so they are fitted once, without restarts."""
    from .plans.discover import discover

    out = discover(fixtures.incidents_with_text(spark, sf_dir), DEFAULT.with_(analysis_date="2026-01-01", input_partitions=PARTITIONS, kmeans_restarts=1),
                   key_cols=KEY, order_cols=KEY)
    bundle = materialise(out["bundle"], "bundle")  # one row
    none = F.lit(None).cast("double")
    parts = [bundle.select(F.inline("rules_struct")).select(F.lit("rule").alias("part"), F.col("context_text").alias("name"), F.col("n").cast("long").alias("n"), F.col("uplift").alias("value")),
             bundle.select(F.inline("critical5")).select(F.lit("critical"), "report_number", F.col("rank").cast("long"), "miss_distance"),
             bundle.select(F.lit("sample"), "temporal_confidence", "sample.total_incidents", none),
             bundle.select(F.lit("run"), "run_metadata.method", "run_metadata.seed", none)]
    for part in parts[1:]:
        parts[0] = parts[0].union(part)
    return parts[0]
