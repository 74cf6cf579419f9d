"""P1 Ask: a table of questions -> ranked, filtered incidents, statistics and answers.

Q5 -> Q1/Q2/Q3 on the augmented text, Q4 on the raw text -> U1 (or given
vectors) -> T1 top-k -> N-ops -> F1/F2 with the F3 relaxation -> G3 -> W5.
Everything is keyed by ``question_id``; no question is answered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import questions as fq
from ..operators import filters, narrative, normalise, similarity, stats
from ..session import materialise
from ..settings import DEFAULT, Settings
from ..sources.incidents import load_questions


def plan_questions(questions: DataFrame) -> DataFrame:
    """Q1-Q5 for every question: mode, bounds, phase and the cleaned text.

    Explicit ``date_from`` / ``date_to`` columns are honoured as given; otherwise
    the bounds come from the augmented text (one date sets both, D4). The phase
    is the one mentioned last in the augmented text (D3)."""
    q = load_questions(questions)
    full = fq.augment_question("question", "date_from", "date_to", "phase")
    q = q.withColumn("query", full)
    parsed_from, parsed_to = fq.extract_dates("query")
    explicit = F.col("date_from").isNotNull() | F.col("date_to").isNotNull()
    return q.withColumns({
        "mode": fq.route_mode("query"),
        "bound_from": F.when(explicit, F.col("date_from")).otherwise(parsed_from),
        "bound_to": F.when(explicit, F.col("date_to")).otherwise(parsed_to),
        "phase_filter": fq.extract_phase("query"),
        "clean_question": fq.clean_question("question"),
    })


def ask(incidents: DataFrame, questions: DataFrame, settings: Settings = DEFAULT, id_col: str = "id",
        vec_col: str = "embedding", model=None) -> dict[str, DataFrame]:
    """Run Ask for every question routed to ``ask``.

    ``questions`` may carry an ``embedding``; otherwise the cleaned text is
    embedded with ``model``, which must be the one that embedded the corpus (U1):
    other vectors would not be comparable, so text without it is refused.
    Returns ``plan``, ``ranked`` (top-k before filters), ``rows`` (filtered,
    relaxed when empty), ``stats``, ``answers`` and ``evidence``.
    """
    plan = materialise(plan_questions(questions), "questions")  # written once: five plans read its long expressions
    asked = plan.where(F.col("mode") == "ask")
    if "embedding" in questions.columns:
        qv = asked.select("question_id", "embedding")
    else:
        if model is None:
            raise ValueError("questions without vectors need the model that embedded the corpus (similarity.fit_embedder)")
        qv = similarity.embed(asked.select("question_id", "clean_question"), "clean_question", model=model) \
            .select("question_id", "embedding")
    ranked = similarity.similarity_topk(incidents, qv, settings.top_k, id_col=id_col, vec_col=vec_col,
                                        settings=settings)
    ranked = normalise.normalise_incidents(ranked)
    bounds = asked.select("question_id", F.col("bound_from").alias("date_from"), F.col("bound_to").alias("date_to"),
                          F.col("phase_filter").alias("phase"))
    rows = filters.relax_if_empty(ranked.join(bounds, "question_id"), "question_id")
    st = stats.ask_stats(rows, "question_id")
    answers = narrative.compose_answer(rows, asked, "question_id", "rank", "miss_distance" in incidents.columns)
    ev = normalise.evidence(rows, ["rank"], 50, group_col="question_id")
    return {"plan": plan, "ranked": ranked, "rows": rows, "stats": st, "answers": answers, "evidence": ev}
