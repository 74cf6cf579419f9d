"""Trap tests for the Column expressions (FIXTURES F-E, SURVEY D1-D16 and 4.4)."""

import math

from pyspark.sql import functions as F

from aerolens.functions import dates, numeric, questions as fq, risk


def one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_to_number_accepts_plain_numbers(spark):
    assert one_col(spark, [" 4.5 ", "1e3", "-2", ".5"], numeric.to_number) == [4.5, 1000.0, -2.0, 0.5]


def test_to_number_refuses_junk(spark):
    junk = ["4.0d", "1_0", "nan", "", "1,000", "0x10", "-", None, "inf"]
    assert one_col(spark, junk, numeric.to_number) == [None] * len(junk)


def test_elevated_flag(spark):
    vals = ["4.0", "3.9", "High", "nan", None, " 5 ", "4"]
    assert one_col(spark, vals, risk.elevated) == [True, False, False, False, False, True, True]


def test_risk_numeric_words_only(spark):
    assert one_col(spark, [" HIGH ", "medium", "Low", "4.0", None], risk.risk_numeric) == [3.0, 2.0, 1.0, None, None]


def test_high_text(spark):
    assert one_col(spark, ["High", "very HIGH", "Low", None], risk.high_text) == [True, True, False, False]


def test_canonical_driver_fills_then_strips(spark):
    assert one_col(spark, [None, " not_available ", "  ", "Night"], risk.canonical_driver) == \
        ["NA", "not_available", "", "Night"]


def test_to_utc_parses_iso_and_refuses_fragments(spark):
    vals = ["2025-08-04", "2025-08-04T10:00:00Z", "2025-08-04 10:00:00", "12:30", "2025", "unknown", ""]
    got = one_col(spark, vals, lambda c: F.date_format(dates.to_utc(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2025-08-04 00:00:00", "2025-08-04 10:00:00", "2025-08-04 10:00:00", None, None, None, None]


def test_month_is_null_for_bad_time(spark):
    df = spark.createDataFrame([("2024-03-05",), ("unknown",), (None,)], "datetime string")
    df = dates.normalise_month(df.withColumn("ts", dates.to_utc("datetime")), "ts")
    assert [r.month for r in df.collect()] == ["2024-03", None, None]  # D1: never 'NaT'


def test_py_round_matches_python(spark):
    vals = [0.15, 0.25, 0.35, 2.675, 1.005, 6.183858, 12.5, 13.5, 0.125, 53052.0, -0.15, 2.5, 0.045]
    for d in (0, 1, 2):
        got = one_col(spark, vals, lambda c: numeric.py_round(c, d), "double")
        assert got == [round(v, d) for v in vals], d


def test_fmt_fixed_matches_python(spark):
    vals = [0.15, 0.25, 2.675, 6.183858, 0.125, 1.0, 1234567.25]
    got = one_col(spark, vals, lambda c: numeric.fmt_fixed(c, 1), "double")
    assert got == [f"{v:.1f}" for v in vals]


def test_py_float_str(spark):
    vals = [53052.0, float("nan"), 1e7, 0.5, 370.0]
    assert one_col(spark, vals, numeric.py_float_str, "double") == [str(v) for v in vals]


def test_pretty_token(spark):
    toks = ["light_not_available", "risk_level_High", "risk_level_", "flight_phase_Final Approach",
            "atc_advisory_Traffic alert", "cause_category_'x'", "some_other_token"]
    assert one_col(spark, toks, risk.pretty_token) == [
        "lighting = not available", "High risk", "High risk", "flight phase = Final Approach",
        "ATC advisory = Traffic alert", "cause category = x", "some other token"]


def test_risk_phrase(spark):
    df = spark.createDataFrame([(["risk_level_High", "risk_level_3.0"],), (["risk_level_Medium"],),
                                (["risk_level_5.0"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(risk.risk_phrase("t")).collect()] == \
        ["High risk", "Medium risk", "elevated risk", "elevated risk"]


def test_context_key(spark):
    df = spark.createDataFrame([({"flight_phase": "Parked", "light": "Night"},)], "c map<string,string>")
    assert df.select(risk.context_key("c")).first()[0] == "phase:parked|light:night|cause:"


QUESTIONS = [
    ("1", "ATC confusion on Descent last week", None, None, None),
    ("2", "runway incursion 2025-01-01 to 2025-02-01 during Final Approach", None, None, None),
    ("3", "bird strike from 2025-03-05", None, None, None),
    ("4", "climb then descent", None, None, None),
    ("5", "identify unique risk patterns, trends, spikes, high risk and critical events across the entire dataset",
     None, None, None),
    ("6", "smoke in cabin", "2024-01-10", "2024-01-20", "Parked"),
]


def test_question_parsing_fixture_f_d(spark):
    df = spark.createDataFrame(QUESTIONS, "question_id string, question string, date_from string, date_to string, "
                                          "phase string")
    df = df.withColumn("query", fq.augment_question("question", "date_from", "date_to", "phase"))
    d_from, d_to = fq.extract_dates("query")
    out = df.select("question_id", "query", fq.route_mode("query").alias("mode"), d_from.alias("f"), d_to.alias("t"),
                    fq.extract_phase("query").alias("phase"), fq.clean_question("question").alias("clean"))
    rows = {r.question_id: r for r in out.collect()}
    assert [rows[str(i)].mode for i in range(1, 7)] == ["ask"] * 4 + ["discover", "ask"]
    assert rows["1"].phase == "Descent" and rows["1"].clean == "ATC confusion on Descent"
    assert (rows["2"].f, rows["2"].t, rows["2"].phase) == ("2025-01-01", "2025-02-01", "Approach")  # D3
    assert (rows["3"].f, rows["3"].t, rows["3"].phase) == ("2025-03-05", "2025-03-05", None)  # D4
    assert rows["4"].phase == "Descent"
    assert rows["6"].query == "smoke in cabin 2024-01-10 to 2024-01-20 during Parked"
    assert rows["6"].phase == "Parked"


def test_longest_match_option(spark):
    df = spark.createDataFrame([("go-around during final approach",)], "q string")
    assert df.select(fq.extract_phase("q", longest_match=True)).first()[0] == "Final Approach"
    assert df.select(fq.extract_phase("q")).first()[0] == "Approach"


def test_cosine_rounding_helper_is_finite():
    assert math.isfinite(numeric._SPLIT)
