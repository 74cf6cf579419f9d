"""Date and time Column expressions (N2, N3, N4, F1 bounds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

# A value must start with an ISO date to be read as a time. Without the guard
# Spark would read '12:30' as today 12:30 and '2025' as 2025-01-01.
DATE_PREFIX_RE = r"^\s*\d{4}-\d{2}-\d{2}"


def to_utc(c: Column | str, dtype=None) -> Column:
    """Dirty text (or a timestamp) to a UTC timestamp; bad values are null.

    Accepts ``yyyy-MM-dd``, ``yyyy-MM-dd HH:mm:ss[.f]``, the ``T`` form and a
    ``Z`` or ``+hh:mm`` suffix. Zone-less text is read in the session zone,
    which ``build_session`` pins to UTC. Each row is parsed on its own, so the
    result never depends on row order (D12).
    """
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, (TimestampType, TimestampNTZType, DateType)):
        return c.cast("timestamp")
    s = c.cast("string")
    return F.when(s.rlike(DATE_PREFIX_RE), F.trim(s).try_cast("timestamp"))


def with_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Date, ISO week, month text (yyyy-MM) and hour from a timestamp column."""
    t = F.col(ts)
    return df.withColumns({
        "date": F.to_date(t),
        "week": F.weekofyear(t),
        "month": F.date_format(t, "yyyy-MM"),
        "hour_of_day": F.hour(t),
    })


def normalise_month(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Month only where a real timestamp exists; otherwise null."""
    t = F.col(ts)
    return df.withColumn("month", F.when(t.isNotNull(), F.date_format(t, "yyyy-MM")))


def date_bound(c: Column | str) -> Column:
    """F1 bound: an ISO date string to a date; an invalid bound is null (ignored)."""
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    return F.when(s.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.to_date(F.trim(s).try_cast("timestamp")))
