"""Normalisation operators: the derived incident columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import normalise_month, to_utc, with_calendar
from ..functions.numeric import to_number
from ..functions.risk import canonical_driver, elevated, high_text, risk_numeric
from ..settings import DEFAULT, Settings
from ..sources.incidents import conform

DISPLAY_NULL = "—"


def normalise_incidents(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One projection with every derived column the analyses read.

    ``ts`` (UTC), ``date``, ``week``, ``month`` (null for a bad time, D1),
    ``hour_of_day``, ``risk_numeric`` (words, N5), ``risk_high`` (numbers >=
    threshold, N6), ``risk_text_high`` (N7), ``miss_distance_num`` and
    ``altitude_num`` (N1). Text columns are left as they are (D2).
    """
    df = conform(df)
    df = df.withColumn("ts", to_utc("datetime", df.schema["datetime"].dataType))
    df = normalise_month(with_calendar(df, "ts"), "ts")
    return df.withColumns({
        "risk_numeric": risk_numeric("risk_level"),
        "risk_high": elevated("risk_level", settings.elevated_threshold),
        "risk_text_high": high_text("risk_level"),
        "miss_distance_num": to_number("miss_distance"),
        "altitude_num": to_number("altitude"),
    })


def canonical_drivers(df: DataFrame, cols=DEFAULT.drivers, fill: str = "NA", suffix: str = "") -> DataFrame:
    """Each driver null -> ``fill``, to text, stripped; a missing column is all ``fill``."""
    out = {}
    for c in cols:
        src = F.col(c) if c in df.columns else F.lit(None).cast("string")
        out[c + suffix] = canonical_driver(src, fill)
    return df.withColumns(out)


def enrich_incidents(df: DataFrame) -> DataFrame:
    """The one-pass cleaner: UTC time, month (null when bad), numeric risk value,
    "—" for null conditions, numeric distances."""
    df = conform(df)
    ts = to_utc("datetime", df.schema["datetime"].dataType)
    return df.withColumns({
        "ts": ts,
        "month": F.when(ts.isNotNull(), F.date_format(ts, "yyyy-MM")),
        "risk_value": to_number("risk_level"),
        "flight_phase": F.coalesce("flight_phase", F.lit(DISPLAY_NULL)),
        "cause_category": F.coalesce("cause_category", F.lit(DISPLAY_NULL)),
        "light": F.coalesce("light", F.lit(DISPLAY_NULL)),
        "atc_advisory": F.coalesce("atc_advisory", F.lit(DISPLAY_NULL)),
        "miss_distance_num": to_number("miss_distance"),
        "altitude_num": to_number("altitude"),
    })


def onehot(df: DataFrame, key_cols: list[str], cols=DEFAULT.drivers, target: str | None = "risk_high",
           settings: Settings = DEFAULT) -> DataFrame:
    """The indicator matrix in long form ``(key..., token)``.

    One token ``<column>_<value>`` per driver and row, plus ``risk_high`` where
    the row is elevated. The wide boolean matrix is never built.
    """
    d = canonical_drivers(df, cols)
    toks = [F.concat(F.lit(c + "_"), F.col(c)) for c in cols]
    if target:
        flag = elevated("risk_level", settings.elevated_threshold) if target not in d.columns else F.col(target)
        toks.append(F.when(flag, F.lit(target)))
    return d.select(*key_cols, F.explode(F.array_compact(F.array(*toks))).alias("token"))


EVIDENCE_COLUMNS = ("report_number", "datetime", "flight_phase", "cause_category", "risk_level",
                    "miss_distance", "score")


def evidence(df: DataFrame, order_cols: list, n: int = 50, group_col: str | None = None) -> DataFrame:
    """The seven display columns that exist, first ``n`` rows in the given order
    (per ``group_col`` when given: a per-question top-n by window, never a global sort)."""
    from pyspark.sql import Window

    keep = [c for c in EVIDENCE_COLUMNS if c in df.columns]
    if group_col is None:
        return df.orderBy(*order_cols).limit(n).select(*keep)
    w = Window.partitionBy(group_col).orderBy(*order_cols)
    return (df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
            .select(group_col, F.col("_rn").alias("row_no"), *keep))


def display(df: DataFrame, cols: list[str], null_text: str = DISPLAY_NULL) -> DataFrame:
    """Ordered column subset as text, null shown as "—"."""
    keep = [c for c in cols if c in df.columns]
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(null_text)).alias(c) for c in keep])
