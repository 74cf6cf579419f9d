"""Question routing Column expressions (Q1-Q5), applied to a column of questions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Phrases that route a question to the Discover analysis.
DISCOVER_TRIGGERS = (
    "unique pattern", "unique patterns", "patterns", "insight", "insights",
    "whole dataset", "entire dataset", "identify unique", "trend", "trends",
    "unknown pattern", "clusters", "rules", "spike", "risk radar", "risk patterns",
    "early warning", "high risk", "critical events",
)

# Phase words in the question and the phase they stand for, in
# this order (a later entry wins when two start at the same place).
PHASE_WORDS = (
    ("final approach", "Final Approach"),
    ("initial approach", "Initial Approach"),
    ("initial climb", "Initial Climb"),
    ("take-off", "Takeoff"),
    ("takeoff", "Takeoff"),
    ("parked", "Parked"),
    ("taxi", "Taxi"),
    ("landing", "Landing"),
    ("descent", "Descent"),
    ("climb", "Climb"),
    ("cruise", "Cruise"),
    ("approach", "Approach"),
)

# Date patterns and vague time words.
DATE_RANGE_RE = r"(\d{4}-\d{2}-\d{2})\s*(?:to|–|\.{2,})\s*(\d{4}-\d{2}-\d{2})"
ONE_DATE_RE = r"(\d{4}-\d{2}-\d{2})"
VAGUE_TIME_RE = r"(?i)\b(last week|yesterday|today|tonight|recent|recently|this (morning|afternoon|evening))\b"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def route_mode(q: Column | str) -> Column:
    """Q1: 'discover' when any trigger phrase occurs (any case), else 'ask'."""
    ql = F.lower(_c(q))
    hit = F.lit(False)
    for t in DISCOVER_TRIGGERS:
        hit = hit | ql.contains(t)
    return F.when(F.coalesce(hit, F.lit(False)), F.lit("discover")).otherwise(F.lit("ask"))


def extract_dates(q: Column | str) -> tuple[Column, Column]:
    """Q2: ``D1 to D2`` (or ``–``/``..``) gives both bounds, else one date sets both."""
    ql = F.lower(_c(q))
    r1 = F.nullif(F.regexp_extract(ql, DATE_RANGE_RE, 1), F.lit(""))
    r2 = F.nullif(F.regexp_extract(ql, DATE_RANGE_RE, 2), F.lit(""))
    one = F.nullif(F.regexp_extract(ql, ONE_DATE_RE, 1), F.lit(""))
    date_from = F.when(r1.isNotNull(), r1).otherwise(one)
    date_to = F.when(r1.isNotNull(), r2).otherwise(one)
    return date_from, date_to


def last_index(haystack: Column, needle: str) -> Column:
    """0-based start of the last occurrence of ``needle``, or -1."""
    pos = F.locate(needle[::-1], F.reverse(haystack))
    return F.when(pos > 0, F.length(haystack) - pos - F.lit(len(needle)) + 1).otherwise(F.lit(-1))


def extract_phase(q: Column | str, longest_match: bool = False) -> Column:
    """Q3: the phase word mentioned last wins (D3: 'final approach' reads as 'Approach').

    ``longest_match=True`` prefers the longest word among those that end last.
    """
    ql = F.lower(_c(q))
    cands = []
    for order, (needle, phase) in enumerate(PHASE_WORDS):
        idx = last_index(ql, needle)
        key = idx + F.lit(len(needle)) if longest_match else idx
        cands.append(F.struct(key.alias("k"), (F.lit(len(needle)) if longest_match else F.lit(order)).alias("o"),
                              F.when(idx >= 0, F.lit(phase)).alias("phase"), (idx >= 0).alias("found")))
    found = F.filter(F.array(*cands), lambda s: s["found"])
    return F.when(F.size(found) > 0, F.array_max(found)["phase"])


def clean_question(q: Column | str) -> Column:
    """Q4: strip, drop vague time words, collapse whitespace."""
    t = F.regexp_replace(F.regexp_replace(_c(q), r"^\s+|\s+$", ""), VAGUE_TIME_RE, "")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^\s+|\s+$", "")


def augment_question(q: Column | str, date_from: Column | str, date_to: Column | str,
                     phase: Column | str) -> Column:
    """Q5: append ``D1 to D2`` / ``from D`` / ``to D`` and ``during <phase>``."""
    base = F.regexp_replace(_c(q), r"^\s+|\s+$", "")
    df_, dt_, ph = _c(date_from).cast("string"), _c(date_to).cast("string"), _c(phase)
    has_f = df_.isNotNull() & (df_ != "")
    has_t = dt_.isNotNull() & (dt_ != "")
    dates = (
        F.when(has_f & has_t, F.concat(F.lit(" "), df_, F.lit(" to "), dt_))
        .when(has_f, F.concat(F.lit(" from "), df_))
        .when(has_t, F.concat(F.lit(" to "), dt_))
        .otherwise(F.lit(""))
    )
    during = F.when(ph.isNotNull() & (ph != "") & (ph != "(any)"), F.concat(F.lit(" during "), ph)).otherwise(F.lit(""))
    return F.concat(base, dates, during)
