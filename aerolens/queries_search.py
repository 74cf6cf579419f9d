"""Registered queries, part 2: similarity, question routing and Ask answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sqltext as S
from .functions import questions as fq
from .functions.text import TOKEN_RE
from .operators import filters, narrative, normalise, similarity, stats, vector_index
from .queries import register
from .settings import DEFAULT
from .sources import fixtures

VEC_COLS = ["id", "vec_id", "report_number", "datetime", "flight_phase", "cause_category", "risk_level",
            "miss_distance", "label"]
VEC_COLS_SQL = ", ".join(VEC_COLS)


def ranked(spark, sf_dir, k=None):
    """T1 over the label questions (one per label, its first vector)."""
    inc = fixtures.incident_vectors(spark, sf_dir)
    q = fixtures.label_questions(spark, sf_dir)
    return similarity.similarity_topk(inc, q, k or DEFAULT.top_k, keep_cols=VEC_COLS)


TOPK_SQL = f"""WITH {S.VEC}, {S.LQ},
  s AS (SELECT q.question_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS raw,
    {', '.join('v.' + c for c in VEC_COLS)} FROM incident_vectors v, label_questions q),
  ranked AS (SELECT * EXCLUDE (raw), round(raw, 6) AS score,
    CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(raw, 12) DESC, id) AS BIGINT) AS rank
    FROM s QUALIFY rank <= 40)"""


@register("question_topk", f"{TOPK_SQL} SELECT * FROM ranked")
def q_topk(spark, sf_dir):
    """T1 (+J4): the 40 incidents most similar to each question."""
    return ranked(spark, sf_dir)


RANKED_NORM = f"""{TOPK_SQL}, ranked_c AS (SELECT *, CAST(NULL AS VARCHAR) AS altitude FROM ranked),
  {S.norm_cte('ranked_c', 'rn')},
  qb AS (SELECT question_id, date_from, date_to, phase FROM label_questions),
  j AS (SELECT rn.*, qb.date_from, qb.date_to, qb.phase,
    (qb.date_from IS NULL OR date >= TRY_CAST(qb.date_from AS DATE)) AND (qb.date_to IS NULL OR date <= TRY_CAST(qb.date_to AS DATE)) AS in_dates,
    (qb.phase IS NULL OR trim(qb.phase) = '' OR coalesce(contains(lower({S.strip('flight_phase')}), lower({S.strip('qb.phase')})), false)) AS in_phase
    FROM rn JOIN qb USING (question_id))"""


def ranked_with_bounds(spark, sf_dir):
    r = normalise.normalise_incidents(ranked(spark, sf_dir))
    q = fixtures.label_questions(spark, sf_dir).select("question_id", "date_from", "date_to", "phase")
    return r.join(q, "question_id")


@register("filter_date_range", f"""{RANKED_NORM}
SELECT question_id, rank, id, CAST(date AS VARCHAR) AS date FROM j WHERE coalesce(in_dates, false)""")
def q_filter_dates(spark, sf_dir):
    """F1 with each question's own bounds."""
    r = ranked_with_bounds(spark, sf_dir)
    return filters.filter_dates(r, F.col("date_from"), F.col("date_to")).select("question_id", "rank", "id", "date")


@register("filter_phase", f"""{RANKED_NORM} SELECT question_id, rank, id, flight_phase FROM j WHERE in_phase""")
def q_filter_phase(spark, sf_dir):
    """F2 with each question's wanted phase."""
    r = ranked_with_bounds(spark, sf_dir)
    return r.where(filters.phase_predicate(F.col("phase"))).select("question_id", "rank", "id", "flight_phase")


RELAXED_SQL = f"""{RANKED_NORM},
  k AS (SELECT *, coalesce(in_dates, false) AND in_phase AS strict,
    max(CAST(coalesce(in_dates, false) AND in_phase AS INT)) OVER (PARTITION BY question_id) AS any_strict FROM j),
  rows AS (SELECT *, any_strict = 0 AS relaxed FROM k WHERE strict OR (any_strict = 0 AND in_phase))"""


@register("ask_with_relaxation", f"{RELAXED_SQL} SELECT question_id, rank, id, relaxed FROM rows")
def q_relax(spark, sf_dir):
    """strict filters, or the phase alone when nothing passes."""
    rows = filters.relax_if_empty(ranked_with_bounds(spark, sf_dir))
    return rows.select("question_id", "rank", "id", "relaxed")


def relaxed_rows(spark, sf_dir):
    return filters.relax_if_empty(ranked_with_bounds(spark, sf_dir))


@register("evidence_projection", f"""{RELAXED_SQL} SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank) AS BIGINT) AS row_no,
  report_number, datetime, flight_phase, cause_category, risk_level, miss_distance, score FROM rows QUALIFY row_no <= 50""")
def q_evidence(spark, sf_dir):
    """The display columns of each question's first 50 kept rows."""
    return normalise.evidence(relaxed_rows(spark, sf_dir), ["rank"], 50, group_col="question_id")


STATS_SQL = f"""{RELAXED_SQL},
  p AS (SELECT question_id, 'cause_category' AS facet, coalesce(cause_category, 'NA') AS value FROM rows
    UNION ALL SELECT question_id, 'flight_phase', coalesce(flight_phase, 'NA') FROM rows
    UNION ALL SELECT question_id, 'risk_level', coalesce(risk_level, 'NA') FROM rows),
  fc AS (SELECT question_id, facet, value, count(*) AS n FROM p GROUP BY ALL),
  fr AS (SELECT *, row_number() OVER (PARTITION BY question_id, facet ORDER BY n DESC, value) AS r FROM fc),
  fk AS (SELECT * FROM fr WHERE facet = 'risk_level' OR r <= 10),
  fs AS (SELECT question_id,
    string_agg(CASE WHEN facet = 'cause_category' THEN value || ':' || CAST(n AS VARCHAR) END, ', ' ORDER BY r) AS by_cause,
    string_agg(CASE WHEN facet = 'flight_phase' THEN value || ':' || CAST(n AS VARCHAR) END, ', ' ORDER BY r) AS by_phase,
    string_agg(CASE WHEN facet = 'risk_level' THEN value || ':' || CAST(n AS VARCHAR) END, ', ' ORDER BY r) AS by_risk,
    max(CASE WHEN facet = 'cause_category' AND r = 1 THEN value END) AS top_cause,
    max(CASE WHEN facet = 'cause_category' AND r = 1 THEN n END) AS top_cause_n,
    max(CASE WHEN facet = 'flight_phase' AND r = 1 THEN value END) AS top_phase,
    max(CASE WHEN facet = 'flight_phase' AND r = 1 THEN n END) AS top_phase_n,
    max(CASE WHEN facet = 'risk_level' AND r = 1 THEN value END) AS top_risk,
    max(CASE WHEN facet = 'risk_level' AND r = 1 THEN n END) AS top_risk_n
    FROM fk GROUP BY question_id),
  st AS (SELECT question_id, count(*) AS count, median(miss_distance_num) AS median_miss_distance FROM rows GROUP BY question_id)"""


@register("subset_stats", f"{STATS_SQL} SELECT * FROM st JOIN fs USING (question_id)")
def q_subset_stats(spark, sf_dir):
    """G3 (+G1 per question, G2 per question) over each question's kept rows."""
    return stats.ask_stats(relaxed_rows(spark, sf_dir), "question_id")


ANSWER_SQL = f"""{STATS_SQL},
  ex AS (SELECT question_id, list(coalesce(report_number, 'None') ORDER BY rank) FILTER (WHERE rk <= 5) AS ex_reports
    FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rk FROM rows) GROUP BY question_id),
  nr AS (SELECT question_id,
      string_agg('Report ' || coalesce(report_number, 'None') || ' miss_distance=' || CAST(coalesce(miss_distance_num, 'nan'::DOUBLE) AS VARCHAR), '; ' ORDER BY nk) AS near_text,
      list(coalesce(report_number, 'None') ORDER BY nk) AS near_cites
    FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY miss_distance_num ASC NULLS LAST, rank) AS nk FROM rows)
    WHERE nk <= 3 GROUP BY question_id),
  qs AS (SELECT DISTINCT question_id FROM label_questions),
  a AS (SELECT qs.question_id, coalesce(st.count, 0) AS count, fs.*, ex.ex_reports, nr.near_text, nr.near_cites
    FROM qs LEFT JOIN st USING (question_id) LEFT JOIN fs USING (question_id) LEFT JOIN ex USING (question_id)
    LEFT JOIN nr USING (question_id))
SELECT question_id, count,
  CASE WHEN count = 0 THEN 'No matching incidents were found for the specified criteria.' ELSE
  'This subset includes ' || CAST(count AS VARCHAR) || ' incident(s). The most frequent cause category is ''' || coalesce(top_cause, 'N/A')
  || ''' (' || CAST(coalesce(top_cause_n, 0) AS VARCHAR) || ' cases). The most common flight phase is ''' || coalesce(top_phase, 'N/A')
  || ''' (' || CAST(coalesce(top_phase_n, 0) AS VARCHAR) || ' cases). Risk score distribution: ' || coalesce(by_risk, 'N/A')
  || '. Representative reports: ' || array_to_string(ex_reports, ', ') || '.' END AS summary,
  CASE WHEN count = 0 THEN 0 ELSE 4 END AS n_claims,
  CASE WHEN count = 0 THEN '' ELSE
  'Most common cause category is ''' || coalesce(top_cause, 'N/A') || ''' (' || CAST(coalesce(top_cause_n, 0) AS VARCHAR) || '/' || CAST(count AS VARCHAR) || ' incidents).'
  || chr(10) || 'Most common flight phase is ''' || coalesce(top_phase, 'N/A') || ''' (' || CAST(coalesce(top_phase_n, 0) AS VARCHAR) || '/' || CAST(count AS VARCHAR) || ' incidents).'
  || chr(10) || 'Risk score distribution for this subset is: ' || coalesce(by_risk, 'N/A') || '.'
  || chr(10) || 'Smallest recorded miss_distance values in this subset indicate notable proximity events: ' || near_text END AS claims,
  CASE WHEN count = 0 THEN '' ELSE array_to_string(ex_reports, ',') || ' | ' || array_to_string(near_cites, ',') END AS citations
FROM a"""


def flat_answers(a):
    cites = F.when(F.size("claims") == 0, F.lit("")).otherwise(F.concat(
        F.array_join(F.try_element_at("claims", F.lit(1))["citations"], ","), F.lit(" | "),
        F.array_join(F.try_element_at("claims", F.lit(4))["citations"], ",")))
    return a.select("question_id", "count", "summary", F.size("claims").alias("n_claims"),
                    F.array_join(F.transform("claims", lambda c: c["text"]), "\n").alias("claims"),
                    cites.alias("citations"))


@register("ask_answer", ANSWER_SQL)
def q_answer(spark, sf_dir):
    """Summary, claims and citations for every question (no rows: the fixed text)."""
    qs = fixtures.label_questions(spark, sf_dir).select("question_id")
    return flat_answers(narrative.compose_answer(relaxed_rows(spark, sf_dir), qs, "question_id", "rank"))


# ------------------------------------------------------------------ sweep

PROBES_SQL = """probes AS (SELECT label AS probe, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label)"""


def label_probes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(
        F.col("label").cast("int").alias("probe"), "embedding")


@register("sweep_sample", f"""WITH {S.VEC}, {PROBES_SQL},
  c AS (SELECT p.probe, v.id, v.report_number,
    list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS raw
    FROM incident_vectors v, probes p),
  r AS (SELECT * EXCLUDE (raw), round(raw, 6) AS score, row_number() OVER (PARTITION BY probe ORDER BY round(raw, 12) DESC, id) AS rank FROM c QUALIFY rank <= 200),
  f AS (SELECT *, row_number() OVER (PARTITION BY coalesce(report_number, id) ORDER BY probe, rank) AS rn FROM r QUALIFY rn = 1)
SELECT CAST(probe AS BIGINT) AS probe, CAST(rank AS BIGINT) AS rank, score, id, report_number FROM f ORDER BY probe, rank LIMIT 3000""")
def q_sweep(spark, sf_dir):
    """T3 with data-derived probes (each label's first vector), 200 per probe, cap 3000."""
    inc = fixtures.incident_vectors(spark, sf_dir).select("id", "report_number", "embedding")
    return similarity.sweep(inc, label_probes(spark, sf_dir)).select("probe", "rank", "score", "id", "report_number")


@register("dedupe_reports", f"""WITH {S.VEC} SELECT report_number, arg_min(vec_id, vec_id) AS vec_id,
  arg_min(id, vec_id) AS id FROM incident_vectors GROUP BY report_number""")
def q_dedupe(spark, sf_dir):
    """The first vector of every report number."""
    inc = fixtures.incident_vectors(spark, sf_dir).select("report_number", "vec_id", "id")
    return similarity.dedupe_first(inc, "report_number", ["vec_id"])


_DRAW = "((('0x' || substr(md5('{seed}:' || p || ':' || d), {at}, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"
_U1, _U2 = (_DRAW.format(seed=DEFAULT.seed, at=at) for at in (1, 14))
RANDOM_SQL = f"""dim AS (SELECT max(len(embedding)) AS w FROM embeddings),
  g AS (SELECT p, d, sqrt(-2.0::DOUBLE * ln({_U1})) * cos(2.0::DOUBLE * pi() * {_U2}) AS z FROM range({DEFAULT.sweep_probes}) AS a(p), dim, range(w) AS b(d)),
  probes AS (SELECT p AS probe, list(CAST(z / norm AS FLOAT) ORDER BY d) AS embedding FROM (SELECT *, sqrt(sum(z * z) OVER (PARTITION BY p)) + 1e-12 AS norm FROM g) GROUP BY p)"""


@register("random_probes", f"""WITH {RANDOM_SQL} SELECT probe::INT AS probe, len(embedding) AS width,
  round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS norm, round(embedding[1]::DOUBLE, 4) AS first, round(embedding[-1]::DOUBLE, 4) AS last FROM probes""")
def q_random_probes(spark, sf_dir):
    """40 seeded unit vectors of the corpus width: their width, norm, first and last component."""
    dim = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max(F.size("embedding"))).first()[0]
    v = F.col("embedding").cast("array<double>")
    return similarity.random_probes(spark, DEFAULT.sweep_probes, dim, DEFAULT.seed).select(
        "probe", F.size(v).cast("bigint").alias("width"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 5).alias("norm"),
        F.round(F.element_at(v, 1), 4).alias("first"), F.round(F.element_at(v, -1), 4).alias("last"))


@register("random_sweep", f"""WITH {S.VEC}, {RANDOM_SQL},
  c AS (SELECT p.probe, v.id, v.report_number, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS raw FROM incident_vectors v, probes p),
  r AS (SELECT * EXCLUDE (raw), round(raw, 6) AS score, row_number() OVER (PARTITION BY probe ORDER BY round(raw, 12) DESC, id) AS rank FROM c QUALIFY rank <= 200),
  f AS (SELECT *, row_number() OVER (PARTITION BY coalesce(report_number, id) ORDER BY probe, rank) AS rn FROM r QUALIFY rn = 1)
SELECT probe::INT AS probe, CAST(rank AS BIGINT) AS rank, id, report_number FROM f ORDER BY probe, rank LIMIT 3000""")
def q_random_sweep(spark, sf_dir):
    """The sweep of the corpus by the 40 seeded vectors."""
    inc = fixtures.incident_vectors(spark, sf_dir).select("id", "report_number", "embedding")
    dim = inc.agg(F.max(F.size("embedding"))).first()[0]
    probes = similarity.random_probes(spark, DEFAULT.sweep_probes, dim, DEFAULT.seed)
    return similarity.sweep(inc, probes).select("probe", "rank", "id", "report_number")


# ------------------------------------------------------------------ questions

CQ = f"WITH {S.CONVQ}"
AUG_SQL = f"""{S.strip('question')} || CASE WHEN coalesce(date_from, '') <> '' AND coalesce(date_to, '') <> '' THEN ' ' || date_from || ' to ' || date_to
  WHEN coalesce(date_from, '') <> '' THEN ' from ' || date_from WHEN coalesce(date_to, '') <> '' THEN ' to ' || date_to ELSE '' END
  || CASE WHEN coalesce(phase, '') <> '' AND phase <> '(any)' THEN ' during ' || phase ELSE '' END"""


def conv(spark, sf_dir):
    q = fixtures.conversation_questions(spark, sf_dir)
    return q.withColumn("query", fq.augment_question("question", "date_from", "date_to", "phase"))


@register("augment_question", f"{CQ} SELECT question_id, {AUG_SQL} AS query FROM questions")
def q_augment(spark, sf_dir):
    """Q5 over the user turns of ``conversations`` with derived bounds and phase."""
    return conv(spark, sf_dir).select("question_id", "query")


TRIGGERS_SQL = " OR ".join(f"contains(lower(query), '{t}')" for t in fq.DISCOVER_TRIGGERS)


@register("route_mode", f"""{CQ}, a AS (SELECT question_id, {AUG_SQL} AS query FROM questions)
SELECT question_id, CASE WHEN coalesce({TRIGGERS_SQL}, false) THEN 'discover' ELSE 'ask' END AS mode FROM a""")
def q_route(spark, sf_dir):
    """Q1 on the augmented questions."""
    return conv(spark, sf_dir).select("question_id", fq.route_mode("query").alias("mode"))


@register("extract_dates", f"""{CQ}, a AS (SELECT question_id, lower({AUG_SQL}) AS ql FROM questions),
  b AS (SELECT question_id, nullif(regexp_extract(ql, '{fq.DATE_RANGE_RE}', 1), '') AS r1,
    nullif(regexp_extract(ql, '{fq.DATE_RANGE_RE}', 2), '') AS r2, nullif(regexp_extract(ql, '{fq.ONE_DATE_RE}', 1), '') AS one FROM a)
SELECT question_id, CASE WHEN r1 IS NOT NULL THEN r1 ELSE one END AS date_from,
  CASE WHEN r1 IS NOT NULL THEN r2 ELSE one END AS date_to FROM b""")
def q_dates(spark, sf_dir):
    """Q2 on the augmented questions."""
    d_from, d_to = fq.extract_dates("query")
    return conv(spark, sf_dir).select("question_id", d_from.alias("date_from"), d_to.alias("date_to"))


def _phase_sql(q: str) -> str:
    items = []
    for order, (needle, phase) in enumerate(fq.PHASE_WORDS):
        rev = needle[::-1].replace("'", "''")
        idx = (f"CASE WHEN strpos(reverse({q}), '{rev}') > 0 THEN length({q}) - strpos(reverse({q}), '{rev}') - {len(needle)} + 1 "
               f"ELSE -1 END")
        items.append(f"{{'k': {idx}, 'o': {order}, 'p': '{phase}'}}")
    lst = f"list_filter([{', '.join(items)}], lambda x: x.k >= 0)"
    return f"(CASE WHEN len({lst}) > 0 THEN list_max({lst}).p END)"


@register("extract_phase", f"""{CQ}, a AS (SELECT question_id, lower({AUG_SQL}) AS ql FROM questions)
SELECT question_id, {_phase_sql('ql')} AS phase FROM a""")
def q_phase(spark, sf_dir):
    """Q3 on the augmented questions (the last-mentioned phase word)."""
    return conv(spark, sf_dir).select("question_id", fq.extract_phase("query").alias("phase"))


CLEAN_SQL = S.strip(f"regexp_replace(regexp_replace({S.strip('question')}, '\\b(last week|yesterday|today|tonight|recent|recently|this (morning|afternoon|evening))\\b', '', 'gi'), '\\s+', ' ', 'g')")


@register("clean_question", f"{CQ} SELECT question_id, {CLEAN_SQL} AS clean_question FROM questions")
def q_clean(spark, sf_dir):
    """Q4 on the raw question text."""
    return fixtures.conversation_questions(spark, sf_dir).select(
        "question_id", fq.clean_question("question").alias("clean_question"))


#: Width of the registered text vectors.
TEXT_DIM = 64
#: The same model in SQL: ``vec`` holds the vector of every document ('d') and cleaned question ('q').
EMBED_SQL = f"""WITH {S.TXT}, {S.CONVQ},
  src AS (SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, full_narrative AS txt FROM incident_texts
    UNION ALL SELECT 'q', question_id, {CLEAN_SQL} FROM questions),
  tk AS (SELECT kind, id, unnest(regexp_extract_all(lower(coalesce(txt, '')), '{TOKEN_RE}')) AS t FROM src),
  tf AS MATERIALIZED (SELECT kind, id, ('0x' || substr(md5(t), 1, 13))::BIGINT % {TEXT_DIM} AS b, count(*) AS tf FROM tk GROUP BY ALL),
  idf AS (SELECT b, ln((1.0::DOUBLE + (SELECT count(*) FROM incident_texts)) / (1.0::DOUBLE + count(id))) AS idf
    FROM range({TEXT_DIM}) AS g(b) LEFT JOIN (SELECT b, id FROM tf WHERE kind = 'd') USING (b) GROUP BY b),
  w AS (SELECT kind, id, b, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY kind, id)) AS norm FROM tf JOIN idf USING (b)),
  vec AS MATERIALIZED (SELECT src.kind, src.id, list(CAST(CASE WHEN norm > 0 THEN w / norm ELSE 0 END AS FLOAT) ORDER BY g.b) AS embedding
    FROM src CROSS JOIN range({TEXT_DIM}) AS g(b) LEFT JOIN w ON w.kind = src.kind AND w.id = src.id AND w.b = g.b GROUP BY src.kind, src.id)"""


def text_model(spark, sf_dir):
    """The documents as incidents with the vectors of their narratives, and the model that embedded them. The narratives
    themselves are read once and left behind: matches would repeat them for every question."""
    corpus = similarity.count_terms(fixtures.incident_texts(spark, sf_dir), "full_narrative", TEXT_DIM)
    model = similarity.fit_embedder(corpus, "full_narrative", TEXT_DIM)
    return similarity.embed(corpus, "full_narrative", model=model), model


@register("embed_texts", f"""{EMBED_SQL} SELECT id AS question_id, CAST(len(embedding) AS BIGINT) AS dim,
  round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm,
  array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), ',') AS millionths
  FROM vec WHERE kind = 'q'""")
def q_embed(spark, sf_dir):
    """The cleaned questions embedded by the corpus's model: id, width, norm and all components in millionths."""
    q = fixtures.conversation_questions(spark, sf_dir).withColumn("clean", fq.clean_question("question"))
    e = similarity.embed(q, "clean", model=text_model(spark, sf_dir)[1])
    v = F.col("embedding").cast("array<double>")
    return e.select("question_id", F.size(v).cast("long").alias("dim"), F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), 5).alias("norm"),
                    F.array_join(F.transform(v, lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("millionths"))


@register("ask", ANSWER_SQL)
def q_ask(spark, sf_dir):
    """Ask as a whole for the label questions and their vectors over the vector incidents."""
    from .plans.ask import ask

    inc = fixtures.incident_vectors(spark, sf_dir)
    return flat_answers(ask(inc, fixtures.label_questions(spark, sf_dir))["answers"])


ASK_TEXTS_SQL = f"""{EMBED_SQL},
  aq AS (SELECT question_id, {AUG_SQL} AS query FROM questions),
  asked AS MATERIALIZED (SELECT question_id, {_phase_sql('lower(query)')} AS phase FROM aq WHERE NOT coalesce({TRIGGERS_SQL}, false)),
  s AS (SELECT question_id, CAST(d.id AS BIGINT) AS id, round(list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12) AS raw
    FROM asked JOIN vec q ON q.kind = 'q' AND q.id = asked.question_id, vec d
    WHERE d.kind = 'd' AND phase IS NULL AND list_max(d.embedding) > 0 AND list_max(q.embedding) > 0),
  top AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY raw DESC, id) AS rank FROM s QUALIFY rank <= {DEFAULT.top_k}),
  st AS (SELECT question_id, count(*) AS n, CAST(count(*) AS VARCHAR) AS t, string_agg('D' || CAST(id AS VARCHAR), ', ' ORDER BY rank) FILTER (rank <= 5) AS reports FROM top GROUP BY question_id)
SELECT question_id, coalesce(n, 0) AS count, CASE WHEN n IS NULL THEN 'No matching incidents were found for the specified criteria.' ELSE
  'This subset includes ' || t || ' incident(s). The most frequent cause category is \'\'NA\'\' (' || t || ' cases). The most common flight phase is \'\'NA\'\' ('
  || t || ' cases). Risk score distribution: NA:' || t || '. Representative reports: ' || reports || '.' END AS summary,
  CASE WHEN n IS NULL THEN 0 ELSE 3 END AS n_claims FROM asked LEFT JOIN st USING (question_id)"""


@register("ask_texts", ASK_TEXTS_SQL)
def q_ask_texts(spark, sf_dir):
    """P1 from text: every user turn of ``conversations`` routed to ask, over the documents, one
    model embedding both. The documents have neither dates nor phases: bounds on dates are
    relaxed, and a question that names a phase finds nothing."""
    from .plans.ask import ask

    corpus, model = text_model(spark, sf_dir)
    corpus = corpus.withColumnRenamed("doc_id", "id")
    out = ask(corpus, fixtures.conversation_questions(spark, sf_dir), model=model)
    return out["answers"].select("question_id", "count", "summary", F.size("claims").alias("n_claims"))


@register("probe_cross_join", f"""WITH {S.VEC}, {PROBES_SQL},
  c AS (SELECT p.probe, v.id, v.report_number,
    list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS raw
    FROM incident_vectors v, probes p)
SELECT CAST(probe AS VARCHAR) AS question_id, id, report_number, round(raw, 6) AS score,
  CAST(row_number() OVER (PARTITION BY probe ORDER BY round(raw, 12) DESC, id) AS BIGINT) AS rank FROM c QUALIFY rank <= 200""")
def q_probe_join(spark, sf_dir):
    """Every probe's 200 best vectors, by a join of probes with the groups of a
    stored vector index; the full probe x vector product is never materialised."""
    inc = fixtures.incident_vectors(spark, sf_dir).select("id", "report_number", "embedding")
    p = label_probes(spark, sf_dir).withColumn("question_id", F.col("probe").cast("string"))
    top = similarity.similarity_topk(inc, p, DEFAULT.sweep_probe_k, index=vector_index.build_index(inc))
    return top.select("question_id", "id", "report_number", "score", "rank")


@register("topk_every_vector", f"""WITH {S.VEC},
  c AS (SELECT q.id AS question_id, v.id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12) AS raw
    FROM incident_vectors v, incident_vectors q)
SELECT question_id, id, round(raw, 6) AS score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY raw DESC, id) AS BIGINT) AS rank
  FROM c QUALIFY rank <= 40""")
def q_every_vector(spark, sf_dir):
    """T1 with every incident's vector as a question: many questions, one join with the vector groups."""
    inc = fixtures.incident_vectors(spark, sf_dir).select("id", "embedding")
    asked = inc.select(F.col("id").alias("question_id"), "embedding")
    top = similarity.similarity_topk(inc, asked, DEFAULT.top_k, index=vector_index.build_index(inc))
    return top.select("question_id", "id", "score", "rank")
