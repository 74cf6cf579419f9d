"""Plan shape: partition pruning, column pruning, bounded per-group limits."""

import os
import tempfile

from pyspark.sql import functions as F

from aerolens.operators import normalise, rules, stats
from aerolens.sources import fixtures
from aerolens.sources.incidents import load_incidents

from .conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_namespace_prunes_partitions(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="aerolens-ns-"), "inc")
    (fixtures.incidents(spark, SF001).withColumn("namespace", F.when(F.col("l_orderkey") % 2 == 0, "a").otherwise("b"))
     .write.partitionBy("namespace").parquet(path))
    df = load_incidents(spark, path, namespace="a")
    assert "PartitionFilters: [isnotnull(namespace" in _plan(df) or "namespace" in _plan(df).split("PartitionFilters")[1]
    assert df.where(F.col("l_orderkey") % 2 == 1).count() == 0


def test_rule_cube_reads_only_needed_columns(spark, monkeypatch):
    plans = []  # the cells are written before the rules are read from them
    written = rules.materialise
    monkeypatch.setattr(rules, "materialise", lambda df, name: plans.append(_plan(df)) or written(df, name))
    rules.mine_risk_rules(normalise.normalise_incidents(fixtures.incidents(spark, SF001)))
    plan = plans[0]
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_returnflag:string>" in plan
    assert "l_extendedprice" not in plan.split("ReadSchema: struct<l_orderkey")[1].split(">")[0]
    assert "Expand" in plan and "partial_count" in plan


def test_first_n_per_group_limits_before_shuffle(spark):
    df = normalise.normalise_incidents(fixtures.incidents(spark, SF001)).withColumn("cluster", F.col("l_orderkey") % 6)
    plan = _plan(stats.examples(df, "cluster", list(fixtures.SRC_KEY)))
    before_exchange = plan.split("Exchange hashpartitioning(cluster")[1]
    assert "WindowGroupLimit" in before_exchange


def test_answers_do_not_score_the_corpus_again(spark):
    from aerolens.queries_search import q_answer

    assert "Arrow" not in _plan(q_answer(spark, SF001)) and "Pandas" not in _plan(q_answer(spark, SF001))


def test_crosstab_scans_once(spark, monkeypatch):
    plans = []
    written = stats.materialise
    monkeypatch.setattr(stats, "materialise", lambda df, name: plans.append(_plan(df)) or written(df, name))
    out = _plan(stats.crosstab(normalise.normalise_incidents(fixtures.incidents(spark, SF001))))
    assert sum(p.count("lineitem.parquet") for p in plans) == 1 and "lineitem.parquet" not in out
