"""Incident views built by Spark from the shared test tables (FIXTURES.md).

Each function reads the given parquet tables, so the work grows with them.
``*_SQL`` holds the same view as SQL text for the DuckDB oracle, which only has
the base tables registered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SRC_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

PHASE_BY_PART = ["Parked", "Taxi", "Initial Climb", "Climb", "Cruise", "Descent",
                 "Initial Approach", "Final Approach", "Landing"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-A: structured incidents with planted signal, nulls, dirt and repeated report numbers."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_quantity", "l_returnflag", "l_shipdate")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # Customers meet the orders first, so that the largest table is shuffled once.
    j = li.join(o.join(c, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey)
    ok, pk, q = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity")
    rf, seg = F.col("l_returnflag"), F.col("c_mktsegment")
    pmod = (pk % 10).cast("int")
    phase = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(PHASE_BY_PART))):
        phase = F.when(pmod == i, F.lit(name)).otherwise(phase)
    return j.select(
        F.concat(F.lit("R"), ok.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("report_number"),
        F.when(ok % 23 == 0, F.lit(None).cast("string")).when(ok % 29 == 0, F.lit("unknown"))
        .otherwise(F.col("l_shipdate").cast("string")).alias("datetime"),
        phase.alias("flight_phase"),
        F.when(rf == "A", "Daylight").when(rf == "N", "Night").otherwise(" not_available ").alias("light"),
        F.when(F.col("o_orderstatus") == "F", "Traffic alert").when(F.col("o_orderstatus") == "P", "Clearance")
        .alias("atc_advisory"),
        seg.alias("cause_category"),
        F.when((pk % 10 == 7) & (rf == "N") & (q <= 35), "5.0")
        .when((pk % 10 == 0) & (seg == "MACHINERY") & (q <= 30), "4.0")
        .when(q <= 4, "4.0").when(q <= 8, "High").when(q <= 16, "Medium").when(q <= 24, "Low")
        .when(q <= 26, F.lit(None).cast("string")).otherwise("2.0").alias("risk_level"),
        F.when(ok % 17 == 0, "").when(ok % 19 == 0, "n/a")
        .otherwise(F.floor("l_extendedprice").cast("int").cast("string")).alias("miss_distance"),
        F.when(ok % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.floor(F.col("o_totalprice") / 10).cast("int").cast("string")).alias("altitude"),
        *SRC_KEY,
    )


INCIDENTS_SQL = """SELECT concat('R', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS report_number,
  CASE WHEN l_orderkey % 23 = 0 THEN NULL WHEN l_orderkey % 29 = 0 THEN 'unknown'
       ELSE CAST(l_shipdate AS STRING) END AS datetime,
  CASE CAST(l_partkey % 10 AS INT) WHEN 0 THEN 'Parked' WHEN 1 THEN 'Taxi' WHEN 2 THEN 'Initial Climb'
       WHEN 3 THEN 'Climb' WHEN 4 THEN 'Cruise' WHEN 5 THEN 'Descent' WHEN 6 THEN 'Initial Approach'
       WHEN 7 THEN 'Final Approach' WHEN 8 THEN 'Landing' ELSE NULL END AS flight_phase,
  CASE l_returnflag WHEN 'A' THEN 'Daylight' WHEN 'N' THEN 'Night' ELSE ' not_available ' END AS light,
  CASE o_orderstatus WHEN 'F' THEN 'Traffic alert' WHEN 'P' THEN 'Clearance' ELSE NULL END AS atc_advisory,
  c_mktsegment AS cause_category,
  CASE WHEN l_partkey % 10 = 7 AND l_returnflag = 'N' AND l_quantity <= 35 THEN '5.0'
       WHEN l_partkey % 10 = 0 AND c_mktsegment = 'MACHINERY' AND l_quantity <= 30 THEN '4.0'
       WHEN l_quantity <= 4 THEN '4.0' WHEN l_quantity <= 8 THEN 'High' WHEN l_quantity <= 16 THEN 'Medium'
       WHEN l_quantity <= 24 THEN 'Low' WHEN l_quantity <= 26 THEN NULL ELSE '2.0' END AS risk_level,
  CASE WHEN l_orderkey % 17 = 0 THEN '' WHEN l_orderkey % 19 = 0 THEN 'n/a'
       ELSE CAST(CAST(floor(l_extendedprice) AS INT) AS STRING) END AS miss_distance,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL
       ELSE CAST(CAST(floor(o_totalprice / 10) AS INT) AS STRING) END AS altitude,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""


def incident_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-B: incidents that carry a vector; report numbers repeat (``vec_id % 400``).

    Metadata beyond FIXTURES.md (cause, risk, miss distance) is derived from the
    row's own columns so Ask statistics have something to count.
    """
    e = _read(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    lab = F.col("label")
    return e.select(
        v.cast("string").alias("id"),
        v,
        F.concat(F.lit("V"), (v % 400).cast("string")).alias("report_number"),
        F.date_add(F.lit("2024-01-01").cast("date"), (v % 60).cast("int")).cast("string").alias("datetime"),
        F.when(v % 3 == 0, "Descent").when(v % 3 == 1, "Cruise").otherwise("Final Approach").alias("flight_phase"),
        F.when(lab % 4 == 0, "Weather").when(lab % 4 == 1, "ATC").when(lab % 4 == 2, "Equipment failure")
        .alias("cause_category"),
        F.when(v % 5 == 0, "High").when(v % 5 == 1, "Low").when(v % 5 == 2, "Medium").when(v % 5 == 3, "4.0")
        .alias("risk_level"),
        F.when(v % 7 == 0, F.lit(None).cast("string")).otherwise(((v * 37) % 1000).cast("string")).alias("miss_distance"),
        "embedding", "label",
    )


INCIDENT_VECTORS_SQL = """SELECT CAST(vec_id AS VARCHAR) AS id, vec_id,
  concat('V', CAST(vec_id % 400 AS VARCHAR)) AS report_number,
  CAST(DATE '2024-01-01' + CAST(vec_id % 60 AS INT) AS VARCHAR) AS datetime,
  CASE vec_id % 3 WHEN 0 THEN 'Descent' WHEN 1 THEN 'Cruise' ELSE 'Final Approach' END AS flight_phase,
  CASE label % 4 WHEN 0 THEN 'Weather' WHEN 1 THEN 'ATC' WHEN 2 THEN 'Equipment failure' ELSE NULL END AS cause_category,
  CASE vec_id % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN '4.0' ELSE NULL END AS risk_level,
  CASE WHEN vec_id % 7 = 0 THEN NULL ELSE CAST((vec_id * 37) % 1000 AS VARCHAR) END AS miss_distance,
  embedding, label
FROM embeddings"""


def label_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions derived from the vectors: one per label, the label's first vector.

    Date bounds and phase come from the label: no bounds, an empty 2023 range
    (exercises F3's relaxation), or a 12-day window; phase none/descent/approach.
    """
    e = _read(spark, sf_dir, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    lab = F.col("label")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (lab * 5).cast("int"))
    return q.select(
        lab.cast("string").alias("question_id"),
        F.concat(F.lit("incidents like label "), lab.cast("string")).alias("question"),
        F.when(lab % 5 == 0, F.lit(None).cast("string")).when(lab % 5 == 1, F.lit("2023-03-01"))
        .otherwise(start.cast("string")).alias("date_from"),
        F.when(lab % 5 == 0, F.lit(None).cast("string")).when(lab % 5 == 1, F.lit("2023-03-31"))
        .otherwise(F.date_add(start, 12).cast("string")).alias("date_to"),
        F.when(lab % 3 == 1, "descent").when(lab % 3 == 2, "approach").alias("phase"),
        "embedding",
    )


LABEL_QUESTIONS_SQL = """SELECT CAST(label AS VARCHAR) AS question_id,
  concat('incidents like label ', CAST(label AS VARCHAR)) AS question,
  CASE WHEN label % 5 = 0 THEN NULL WHEN label % 5 = 1 THEN '2023-03-01'
       ELSE CAST(DATE '2024-01-01' + CAST(label * 5 AS INT) AS VARCHAR) END AS date_from,
  CASE WHEN label % 5 = 0 THEN NULL WHEN label % 5 = 1 THEN '2023-03-31'
       ELSE CAST(DATE '2024-01-01' + CAST(label * 5 + 12 AS INT) AS VARCHAR) END AS date_to,
  CASE label % 3 WHEN 1 THEN 'descent' WHEN 2 THEN 'approach' ELSE NULL END AS phase,
  arg_min(embedding, vec_id) AS embedding
FROM embeddings GROUP BY label"""


def incident_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-C: narratives from ``documents``: full text, source as problem, language as synopsis."""
    d = _read(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    return d.select(
        doc, F.concat(F.lit("D"), doc.cast("string")).alias("report_number"),
        F.when(doc % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("lang")).alias("synopsis"),
        F.col("source").alias("primary_problem"),
        F.col("text").alias("full_narrative"),
        "lang",
    )


INCIDENT_TEXTS_SQL = """SELECT doc_id, concat('D', CAST(doc_id AS VARCHAR)) AS report_number,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS synopsis,
  source AS primary_problem, text AS full_narrative, lang
FROM documents"""


def conversation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from the user turns of ``conversations`` (the F-D volume test).

    Date bounds and a phase are derived from the conversation and turn numbers
    so that every branch of the question parser is exercised.
    """
    c = _read(spark, sf_dir, "conversations").where(F.col("role") == "user")
    cid, turn = F.col("conv_id"), F.col("turn")
    day0 = F.lit("2024-01-01").cast("date")
    return c.select(
        (cid * 1000 + turn).cast("string").alias("question_id"),
        F.col("text").alias("question"),
        F.when((cid % 4 == 1) | (cid % 4 == 2), F.date_add(day0, (cid % 28).cast("int")).cast("string"))
        .alias("date_from"),
        F.when((cid % 4 == 1) | (cid % 4 == 3), F.date_add(F.lit("2024-02-01").cast("date"), turn.cast("int"))
               .cast("string")).alias("date_to"),
        F.when(cid % 5 == 1, "(any)").when(cid % 5 == 2, "Parked").when(cid % 5 == 3, "Final Approach")
        .when(cid % 5 == 4, "Taxi").alias("phase"),
    )


CONVERSATION_QUESTIONS_SQL = """SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS question_id, text AS question,
  CASE WHEN conv_id % 4 IN (1, 2) THEN CAST(DATE '2024-01-01' + CAST(conv_id % 28 AS INT) AS VARCHAR) END AS date_from,
  CASE WHEN conv_id % 4 IN (1, 3) THEN CAST(DATE '2024-02-01' + CAST(turn AS INT) AS VARCHAR) END AS date_to,
  CASE conv_id % 5 WHEN 1 THEN '(any)' WHEN 2 THEN 'Parked' WHEN 3 THEN 'Final Approach' WHEN 4 THEN 'Taxi' END AS phase
FROM conversations WHERE role = 'user'"""


def vectors_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-B joined to the narratives of ``documents`` on ``vec_id = doc_id`` (Discover by sweep)."""
    t = incident_texts(spark, sf_dir).select("doc_id", "synopsis", "primary_problem", "full_narrative")
    return incident_vectors(spark, sf_dir).join(t, F.col("vec_id") == F.col("doc_id"), "left").drop("doc_id")


def incidents_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-A joined to the narratives of ``documents`` on ``l_partkey = doc_id`` (Discover input)."""
    t = incident_texts(spark, sf_dir).select("doc_id", "synopsis", "primary_problem", "full_narrative")
    return incidents(spark, sf_dir).join(t, F.col("l_partkey") == F.col("doc_id"), "left").drop("doc_id")
