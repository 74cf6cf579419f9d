"""End-to-end runs of the two pipelines, the stream and the sink."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from aerolens.operators import similarity
from aerolens.plans.ask import ask
from aerolens.plans.discover import discover
from aerolens.settings import DEFAULT
from aerolens.sources import fixtures
from aerolens.sources.incidents import read_incident_csv
from aerolens.sources.sinks import write_bundle
from aerolens.streaming.ask_stream import start_ask_stream

from .conftest import SF001


def test_ask_pipeline(spark):
    inc = fixtures.incident_vectors(spark, SF001)
    q = fixtures.label_questions(spark, SF001)
    out = ask(inc, q)
    answers = out["answers"].collect()
    assert len(answers) == q.count()
    assert all(a.summary for a in answers)
    ranked = out["ranked"].groupBy("question_id").count().collect()
    assert all(r["count"] == DEFAULT.top_k for r in ranked)


def test_discover_sweep_and_empty(spark):
    inc = fixtures.vectors_with_text(spark, SF001)
    s = DEFAULT.with_(sweep_probes=4, kmeans_restarts=2, iforest_trees=20, analysis_date="2026-01-01")
    out = discover(inc, s, sample="sweep")
    b = json.loads(out["bundle"].select(F.to_json(F.struct("*"))).first()[0])
    assert b["sample"]["total_incidents"] == out["sample"].count() > 0
    assert b["temporal_confidence"] in ("HIGH", "MEDIUM", "LOW")
    empty = discover(inc.where(F.lit(False)), s, sample="all")
    assert empty["bundle"].first().temporal_confidence == "UNKNOWN"


def test_csv_source_and_bundle_sink(spark):
    tmp = tempfile.mkdtemp(prefix="aerolens-io-")
    src = os.path.join(tmp, "dump.csv")
    with open(src, "w") as f:
        f.write("report_number,datetime,flight_phase,risk_level,miss_distance\n")
        f.write('R1,2024-01-05 10:00:00,Taxi,4.0,120\nR2,unknown," Night ",High,\n')
    df = read_incident_csv(spark, src)
    assert df.count() == 2 and "altitude" in df.columns and "embedding" in df.columns
    paths = write_bundle({"t": df.drop("embedding")}, os.path.join(tmp, "out"), fmt="csv")
    assert spark.read.option("header", "true").csv(paths["t"]).count() == 2


def text_corpus(spark):
    rows = [("1", "R1", "engine fire near the runway during climb"), ("2", "R2", "bird strike on final approach"),
            ("3", "R3", "loss of separation in cruise"), ("4", "R4", "smoke in the cabin, engine shut down")]
    corpus = spark.createDataFrame(rows, "id string, report_number string, full_narrative string")
    model = similarity.fit_embedder(corpus, "full_narrative", 256)
    return similarity.embed(corpus, "full_narrative", model=model), model


def test_one_text_question_finds_the_same_alone_and_in_a_batch(spark):
    corpus, model = text_corpus(spark)
    one = [("q1", "engine fire near runway")]
    many = one + [("q2", "bird strike"), ("q3", "cabin smoke")]
    schema = "question_id string, question string"
    alone = {r.id: r["rank"] for r in ask(corpus, spark.createDataFrame(one, schema), model=model)["ranked"].collect()}
    batch = {r.id: r["rank"] for r in ask(corpus, spark.createDataFrame(many, schema), model=model)["ranked"].where("question_id = 'q1'").collect()}
    assert alone == batch and alone["1"] == 1
    with pytest.raises(ValueError, match="model"):
        ask(corpus, spark.createDataFrame(one, schema))


def test_no_claim_about_distances_that_do_not_exist(spark):
    corpus, model = text_corpus(spark)
    q = spark.createDataFrame([("q1", "engine fire near runway")], "question_id string, question string")
    assert len(ask(corpus, q, model=model)["answers"].first().claims) == 3


def test_empty_bundle_has_the_full_schema(spark):
    inc = fixtures.vectors_with_text(spark, SF001)
    s = DEFAULT.with_(kmeans_restarts=1, iforest_trees=10, analysis_date="2026-01-01")
    full, empty = discover(inc, s)["bundle"], discover(inc.where(F.lit(False)), s)["bundle"]
    assert empty.columns == full.columns
    row = empty.first()
    assert row["sample"].total_incidents == 0 and row.clusters_table == [] and row.rules_struct == [] and row.watchlist == []


def test_ask_stream(spark):
    tmp = tempfile.mkdtemp(prefix="aerolens-stream-")
    qdir = os.path.join(tmp, "q")
    os.makedirs(qdir)
    with open(os.path.join(qdir, "a.json"), "w") as f:
        f.write(json.dumps({"question_id": "1", "question": "engine fire near the runway"}) + "\n")
        f.write(json.dumps({"question_id": "2", "question": "bird strike"}) + "\n")
    corpus, model = text_corpus(spark)
    q = start_ask_stream(spark, corpus, qdir, os.path.join(tmp, "out"), os.path.join(tmp, "ckpt"), model=model)
    q.awaitTermination(300)
    got = {r.question_id: r for r in spark.read.parquet(os.path.join(tmp, "out")).collect()}
    assert sorted(got) == ["1", "2"]
    assert all(r["count"] > 0 and r.claims for r in got.values())
    assert "R1" in got["1"].claims[0].citations and "R2" in got["2"].claims[0].citations


def test_registered_narratives_are_tokenised_once(spark):
    from aerolens import queries_search as qs

    corpus, model = qs.text_model(spark, SF001)
    plan = corpus._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "full_narrative" not in plan
    texts = fixtures.incident_texts(spark, SF001)
    again = similarity.embed(texts, "full_narrative", model=similarity.fit_embedder(texts, "full_narrative", qs.TEXT_DIM))
    pair = again.select("doc_id", F.col("embedding").alias("e")).join(corpus, "doc_id")
    assert pair.where("e = embedding").count() == texts.count()
