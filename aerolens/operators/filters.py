"""Row filters (F1-F3, F7). F4 lives with the counts in ``stats.keep_top_values``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import date_bound
from ..functions.risk import strip_ws


def _bound(b) -> Column:
    if b is None:
        return F.lit(None).cast("date")
    if isinstance(b, Column):
        return date_bound(b)
    return date_bound(F.lit(str(b)))


def date_predicate(date_col: str, date_from=None, date_to=None) -> Column:
    """F1 as a predicate: inclusive bounds; a given bound drops null dates; an
    unparseable bound is ignored. Bounds may be literals or columns."""
    d = F.col(date_col)
    lo, hi = _bound(date_from), _bound(date_to)
    return (lo.isNull() | (d >= lo)) & (hi.isNull() | (d <= hi))


def filter_dates(df: DataFrame, date_from=None, date_to=None, date_col: str = "date") -> DataFrame:
    """keep rows whose date is inside ``[date_from, date_to]``."""
    return df.where(F.coalesce(date_predicate(date_col, date_from, date_to), F.lit(False)))


def phase_predicate(phase, col: str = "flight_phase") -> Column:
    """F2 as a predicate: the phase text (stripped, any case) contains the wanted
    text; no wanted phase keeps every row."""
    want = phase if isinstance(phase, Column) else F.lit(phase)
    want = F.lower(strip_ws(want.cast("string")))
    have = F.lower(strip_ws(F.col(col).cast("string")))
    return want.isNull() | (want == "") | F.coalesce(have.contains(want), F.lit(False))


def filter_phase(df: DataFrame, phase, col: str = "flight_phase") -> DataFrame:
    """keep rows of the wanted flight phase (skipped when none is given)."""
    return df.where(phase_predicate(phase, col))


def relax_if_empty(ranked: DataFrame, group_col: str = "question_id", date_col: str = "date",
                   from_col: str = "date_from", to_col: str = "date_to", phase_col: str = "phase") -> DataFrame:
    """per question keep the rows passing dates and phase; when none pass,
    keep the rows passing the phase alone. One pass over the ranked rows (a
    window over each question's top-k), no second retrieval."""
    strict = F.coalesce(date_predicate(date_col, F.col(from_col), F.col(to_col)), F.lit(False)) \
        & phase_predicate(F.col(phase_col))
    relaxed = phase_predicate(F.col(phase_col))
    w = Window.partitionBy(group_col)
    return (ranked.withColumn("_strict", strict).withColumn("_relaxed", relaxed)
            .withColumn("_any", F.max(F.col("_strict").cast("int")).over(w))
            .where(F.col("_strict") | ((F.col("_any") == 0) & F.col("_relaxed")))
            .withColumn("relaxed", F.col("_any") == 0)
            .drop("_strict", "_relaxed", "_any"))


OUTLIER_COLUMNS = ("report_number", "miss_distance", "altitude", "flight_phase", "cause_category", "risk_level")


def outliers(df: DataFrame, order_cols: list, n: int = 20, flag: str = "anomaly") -> DataFrame:
    """rows flagged anomalous, the six display columns that exist, first n."""
    keep = [c for c in OUTLIER_COLUMNS if c in df.columns]
    return df.where(F.col(flag)).orderBy(*order_cols).limit(n).select(*keep)
