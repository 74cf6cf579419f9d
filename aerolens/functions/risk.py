"""Risk and condition Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import to_number

# Risk words and their numeric levels.
RISK_WORDS = {"low": 1.0, "medium": 2.0, "high": 3.0}

# Token prefixes and their readable names, in match order.
TOKEN_NAMES = [
    ("flight_phase", "flight phase"),
    ("cause_category", "cause category"),
    ("atc_advisory", "ATC advisory"),
    ("risk_level", "risk level"),
    ("light", "lighting"),
]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed value: the whitespace characters stripped from both ends of a value.
WHITESPACE = " \t\n\r\f\v"


def strip_ws(c: Column | str) -> Column:
    """Python's ``str.strip()`` for ASCII whitespace (space, tab, newlines, form
    feed, vertical tab); a plain character trim, no regular expression."""
    return F.trim(_c(c), F.lit(WHITESPACE))


def risk_numeric(c: Column | str) -> Column:
    """Low/Medium/High (trimmed, any case) to 1/2/3; anything else null."""
    v = F.lower(strip_ws(_c(c).cast("string")))
    out = F.lit(None).cast("double")
    for word, num in RISK_WORDS.items():
        out = F.when(v == word, F.lit(num)).otherwise(out)
    return out


def elevated(c: Column | str, threshold: float = 4.0) -> Column:
    """Numeric risk >= threshold. Words, NaN, null and junk are never elevated."""
    n = to_number(c)
    return F.coalesce((n >= F.lit(float(threshold))) & ~F.isnan(n), F.lit(False))


def high_text(c: Column | str) -> Column:
    """The risk text mentions 'high' in any case; null is false."""
    return F.coalesce(F.lower(_c(c).cast("string")).contains("high"), F.lit(False))


def canonical_driver(c: Column | str, fill: str = "NA") -> Column:
    """Null to ``fill``, then text, then stripped (a blank value stays blank)."""
    return strip_ws(F.coalesce(_c(c).cast("string"), F.lit(fill)))


def _clean_token_value(v: Column) -> Column:
    v = strip_ws(F.translate(v, "_", " "))
    v = F.regexp_replace(v, r"^'+|'+$", "")
    return F.regexp_replace(v, r'^"+|"+$', "")


def pretty_token(c: Column | str) -> Column:
    """``light_not_available`` -> ``lighting = not available``;
    ``risk_level_High`` -> ``High risk``; unknown tokens: underscores to spaces."""
    tok = _c(c)
    out = _clean_token_value(tok)
    for prefix, nice in reversed(TOKEN_NAMES):
        value = _clean_token_value(tok.substr(len(prefix) + 2, 1 << 30))
        if prefix == "risk_level":
            phrase = F.when(value != "", F.concat(value, F.lit(" risk"))).otherwise(F.lit("High risk"))
        else:
            phrase = strip_ws(F.concat(F.lit(f"{nice} = "), value))
        out = F.when(tok.startswith(prefix + "_"), phrase).otherwise(out)
    return out


def risk_phrase(tokens: Column | str) -> Column:
    """A token list to High / Medium / Low / elevated risk (first word found)."""
    arr = _c(tokens)
    joined = F.lower(F.array_join(arr, " "))
    return (
        F.when(F.coalesce(F.size(arr), F.lit(0)) <= 0, F.lit("elevated risk"))
        .when(joined.contains("high"), F.lit("High risk"))
        .when(joined.contains("med"), F.lit("Medium risk"))
        .when(joined.contains("low"), F.lit("Low risk"))
        .otherwise(F.lit("elevated risk"))
    )


def context_key(ctx: Column | str) -> Column:
    """``phase:..|light:..|cause:..`` in lower case; a missing part is empty."""
    m = _c(ctx)

    def part(k):
        return F.lower(F.coalesce(m.getItem(k), F.lit("")))

    return F.concat(F.lit("phase:"), part("flight_phase"), F.lit("|light:"), part("light"),
                    F.lit("|cause:"), part("cause_category"))
