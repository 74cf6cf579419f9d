"""SQL text shared by the DuckDB oracle queries (reference semantics in plain SQL).

DuckDB only has the base tables, so each oracle starts from the fixture views
as CTEs. The fragments below are the SQL twins of the Column expressions in
``aerolens.functions``.
"""

from __future__ import annotations

from .functions.numeric import NUMERIC_RE
from .sources.fixtures import (CONVERSATION_QUESTIONS_SQL, INCIDENT_TEXTS_SQL, INCIDENT_VECTORS_SQL,
                               INCIDENTS_SQL, LABEL_QUESTIONS_SQL)

SRC_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def num(c: str) -> str:
    return f"(CASE WHEN regexp_matches({c}, '{NUMERIC_RE}') THEN TRY_CAST(trim({c}) AS DOUBLE) END)"


WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def strip(c: str) -> str:
    """Twin of ``strip_ws``: trim the same whitespace characters from both ends."""
    return f"trim({c}, {WS})"


def ts(c: str) -> str:
    return f"(CASE WHEN regexp_matches({c}, '^\\s*\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(trim({c}) AS TIMESTAMP) END)"


def driver(c: str) -> str:
    return strip(f"coalesce(CAST({c} AS VARCHAR), 'NA')")


def norm_cte(src: str = "incidents", name: str = "norm") -> str:
    """The derived incident columns (twin of ``normalise_incidents``)."""
    return f"""{name}_t AS (SELECT *, {ts('datetime')} AS ts FROM {src}),
{name} AS (SELECT *, CAST(ts AS DATE) AS date, CAST(weekofyear(ts) AS BIGINT) AS week,
  strftime(ts, '%Y-%m') AS month, CAST(hour(ts) AS BIGINT) AS hour_of_day,
  CASE lower({strip('risk_level')}) WHEN 'low' THEN CAST(1 AS DOUBLE) WHEN 'medium' THEN CAST(2 AS DOUBLE)
       WHEN 'high' THEN CAST(3 AS DOUBLE) END AS risk_numeric,
  coalesce({num('risk_level')} >= 4.0 AND NOT isnan({num('risk_level')}), false) AS risk_high,
  coalesce(contains(lower(risk_level), 'high'), false) AS risk_text_high,
  {num('miss_distance')} AS miss_distance_num, {num('altitude')} AS altitude_num
FROM {name}_t)"""


INC = f"incidents AS ({INCIDENTS_SQL})"
VEC = f"incident_vectors AS ({INCIDENT_VECTORS_SQL})"
LQ = f"label_questions AS ({LABEL_QUESTIONS_SQL})"
TXT = f"incident_texts AS ({INCIDENT_TEXTS_SQL})"
CONVQ = f"questions AS ({CONVERSATION_QUESTIONS_SQL})"


def py_fixed(c: str, d: int) -> str:
    """Python's f"{x:.{d}f}" (exact binary value, half to even)."""
    return f"printf('%.{d}f', {c})"


def py_round(c: str, d: int) -> str:
    """Python's round(x, d) as a double."""
    return f"CAST(printf('%.{d}f', {c}) AS DOUBLE)"
