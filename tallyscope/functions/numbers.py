"""Numeric column expressions: half-up rounding, amount parsing, finiteness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of
from .sqlfns import rhu_sql  # noqa: F401  (rhu_sql re-exported)

INF = float("inf")

# Characters removed before a number is read: currency signs, thousands commas,
# parentheses and every whitespace a browser engine's \s covers.
_STRIP_CLASS = "[₹$€£¥,()\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
_NULL_TOKENS = "(?i)^(null|na|n/a|nan|undefined|-)$"
# Longest leading decimal literal (sign, digits, optional fraction, optional exponent).
_NUM_PREFIX = "^([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)"


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def finite_or_null(c) -> Column:
    c = col_of(c).cast("double")
    return F.when(is_finite(c), c)


def round_half_up(c, digits: int = 2) -> Column:
    """Round half toward +infinity (``floor(v*10^d + 0.5) / 10^d``); non-finite -> 0.

    ``F.round`` rounds half away from zero, which differs for negative halves.  A string
    is taken as SQL expression text (one ``F.expr``, cheap to plan).  A Column is composed
    in place rather than passed to a SQL function, because function arguments are
    evaluated eagerly and callers guard divisions with ``when``.
    """
    if isinstance(c, str):
        return F.expr(rhu_sql(c, digits))
    return _rhu_column(col_of(c), digits)


def _rhu_column(c: Column, digits: int) -> Column:
    c = c.cast("double")
    scale = float(10 ** digits)
    x = c * F.lit(scale) + F.lit(0.5)
    fl = F.when(F.abs(x) >= F.lit(9.0e15), x).otherwise(F.floor(x).cast("double"))
    return F.when(c.isNull(), F.lit(None).cast("double")) \
        .when(~is_finite(c), F.lit(0.0)) \
        .otherwise(fl / F.lit(scale))


def parse_amount(c) -> Column:
    """Read a money-like string: strip symbols, reject null tokens, take the numeric prefix.

    ``"₹1,23,456.50"`` -> 123456.5, ``"(100)"`` -> 100, ``"12abc"`` -> 12, ``"N/A"`` -> null,
    ``"1e400"`` -> null (non-finite).
    """
    s = F.regexp_replace(col_of(c).cast("string"), _STRIP_CLASS, "")
    prefix = F.regexp_extract(s, _NUM_PREFIX, 1)
    num = prefix.try_cast("double")
    return (F.when(s.isNull() | (s == "") | s.rlike(_NULL_TOKENS), F.lit(None).cast("double"))
            .when((prefix != "") & is_finite(num), num))


def with_parsed_amount(df, src: str, out: str):
    """DataFrame form of :func:`parse_amount` evaluating the stripped text and the numeric
    prefix once per row (separate projections instead of repeated sub-expressions)."""
    t_s, t_n = f"__{out}_s", f"__{out}_n"
    df = df.withColumn(t_s, F.regexp_replace(F.col(src).cast("string"), _STRIP_CLASS, ""))
    s = F.col(t_s)
    prefix = F.regexp_extract(s, _NUM_PREFIX, 1)
    df = df.withColumn(t_n, F.when(s.isNull() | (s == "") | s.rlike(_NULL_TOKENS), F.lit(None).cast("double"))
                       .otherwise(F.when(prefix != "", prefix.try_cast("double")))).drop(t_s)
    return df.withColumn(out, F.when(is_finite(F.col(t_n)), F.col(t_n))).drop(t_n)


def to_amount(c, dtype: str) -> Column:
    """Amount expression for a source column of Spark type ``dtype``."""
    if dtype in ("double", "float", "int", "bigint", "smallint", "tinyint") or dtype.startswith("decimal"):
        return finite_or_null(c)
    return parse_amount(c)
