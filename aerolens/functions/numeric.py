"""Numeric Column expressions (N1 and the display-rounding helpers).

All are plain Column expressions so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the text a number may have. Anything else (``4.0d``, ``1_0``,
# ``nan``, ``inf``, ``1,000``, ``0x10``) is not a number here, although Spark's
# own cast would accept some of them.
NUMERIC_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp splitting constant


def to_number(c: Column | str) -> Column:
    """Text to double; anything that is not plainly a number becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    return F.when(s.rlike(NUMERIC_RE), F.trim(s).try_cast("double"))


def _split(a: Column):
    t = a * F.lit(_SPLIT)
    hi = t - (t - a)
    return hi, a - hi


def _split_py(a: float):
    t = a * _SPLIT
    hi = t - (t - a)
    return hi, a - hi


def py_round(c: Column | str, digits: int) -> Column:
    """Round half to even on the exact binary value, as Python's ``round(x, d)``.

    Spark's ``round``/``bround`` work on the shortest decimal string of the
    double, which differs when that string ends exactly on a midpoint
    (``0.15``, ``2.675``). Only then is the exact binary value consulted, with
    an error-free product ``x * 10^(d+1) = p + err``.
    """
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    # The argument is bound once: it is mentioned some twenty times, and nested
    # copies of it would exceed the size of a generated method.
    return F.element_at(F.transform(F.array(x), lambda v: _py_round(v, digits)), 1)


def _py_round(x: Column, digits: int) -> Column:
    ax = F.abs(x)
    text = ax.cast("string")
    frac = F.substring_index(text, ".", -1)
    is_mid = (~text.contains("E")) & (F.length(frac) == digits + 1) & frac.endswith("5")
    scale = float(10 ** (digits + 1))
    p = ax * F.lit(scale)
    ah, al = _split(ax)
    bh, bl = _split_py(scale)
    err = ((ah * F.lit(bh) - p) + ah * F.lit(bl) + al * F.lit(bh)) + al * F.lit(bl)
    n = F.rint(p)
    direction = F.signum((p - n) + err)
    unit = float(10 ** digits)
    up = ((n + F.lit(5.0)) / F.lit(10.0)) / F.lit(unit)
    down = ((n - F.lit(5.0)) / F.lit(10.0)) / F.lit(unit)
    rounded = (
        F.when(is_mid & (direction > 0), up)
        .when(is_mid & (direction < 0), down)
        .otherwise(F.bround(ax, digits))
    )
    return F.when(x.isNull(), F.lit(None).cast("double")).when(
        F.isnan(x), x).otherwise(F.when(x < 0, -rounded).otherwise(rounded))


def fmt_fixed(c: Column | str, digits: int) -> Column:
    """Python's ``f"{x:.{d}f}"``: exact rounding, then fixed notation."""
    return F.format_string(f"%.{digits}f", py_round(c, digits))


def py_float_str(c: Column | str) -> Column:
    """Python's ``str(float)`` for the ranges that occur: ``53052.0``, ``nan``."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    integral_big = (F.abs(x) >= 1e7) & (F.abs(x) < 1e16) & (x == F.floor(x))
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .when(integral_big, F.concat(x.cast("bigint").cast("string"), F.lit(".0")))
        .otherwise(x.cast("string"))
    )
