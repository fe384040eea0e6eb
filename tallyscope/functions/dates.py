"""Timestamp parsing and UTC calendar keys."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of

# Formats tried after ISO, in order: month-first, textual month, day-first, year-first, whole months and years.
DATE_FORMATS = [
    "M/d/yyyy", "M-d-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy",
    "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy/M/d", "yyyy.M.d", "yyyy-M-d",
    "MMM yyyy", "MMMM yyyy", "yyyy-MM", "yyyy",
]
# Formats of texts with a time of day (a day-first date with a time is no date).
TIME_FORMATS = [
    "M/d/yyyy H:mm[:ss]", "M/d/yyyy h:mm[:ss] a", "M-d-yyyy H:mm[:ss]", "yyyy/M/d H:mm[:ss]", "yyyy-M-d H:mm[:ss]",
    "MMM d, yyyy H:mm[:ss]", "MMM d, yyyy h:mm[:ss] a", "MMMM d, yyyy H:mm[:ss]", "MMMM d, yyyy h:mm[:ss] a",
    "d MMM yyyy H:mm[:ss]", "d MMMM yyyy H:mm[:ss]",
]


def _shape(fmt: str) -> str:
    """The only shape of text a format can parse; a format is tried only where its shape matches, which
    saves failing parse attempts without changing any result."""
    parts = {"yyyy": "[0-9]{4}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}", "MM": "[0-9]{2}", "M": "[0-9]{1,2}",
             "d": "[0-9]{1,2}", "H": "[0-9]{1,2}", "h": "[0-9]{1,2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}", "a": "[AaPp][Mm]",
             "[": "(", "]": ")?", ".": "[.]"}
    return "^" + "".join(parts.get(t, t) for t in re.findall(r"yyyy|M+|mm|ss|[dHha]|.", fmt)) + "$"


_ISO_HEAD = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
_NULL_DATE = "(?i)^(null|na)?$"
_TRIM = "^[\\s\\u00A0\\uFEFF]+|[\\s\\u00A0\\uFEFF]+$"

_TIME_TYPES = ("timestamp", "timestamp_ntz", "date")


def as_of_col(as_of) -> Column:
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, (_dt.datetime, _dt.date)):
        as_of = as_of.isoformat()
    return F.lit(str(as_of)).cast("timestamp")


def in_range(ts: Column, as_of=None) -> Column:
    """Accept 1901..2099 and at most one year after ``as_of``."""
    limit = as_of_col(as_of) + F.expr("INTERVAL 365 DAYS")
    return (F.year(ts) > 1900) & (F.year(ts) < 2100) & (ts <= limit)


def _parsed(s: Column, formats=None) -> Column:
    """Value of a trimmed text: ISO, else the formats with or without a time of day."""
    def first(fmts):
        return F.coalesce(*[F.when(s.rlike(_shape(f)), F.try_to_timestamp(s, F.lit(f))) for f in fmts])
    other = first(formats) if formats is not None else F.when(s.contains(":"), first(TIME_FORMATS)).otherwise(first(DATE_FORMATS))
    return F.when(s.isNull() | s.rlike(_NULL_DATE), F.lit(None).cast("timestamp")).otherwise(
        F.coalesce(F.when(s.rlike(_ISO_HEAD), F.try_to_timestamp(s)), other))


def parse_timestamp(c, as_of=None, formats=None) -> Column:
    """Parse a date/time string: ISO first, then the listed formats, then the range check."""
    parsed = _parsed(F.regexp_replace(col_of(c).cast("string"), _TRIM, ""), formats)
    return F.when(in_range(parsed, as_of), parsed)


def with_parsed_timestamp(df, src: str, out: str, as_of=None, formats=None):
    """DataFrame form of :func:`parse_timestamp` that evaluates each stage once per row.

    The trimmed text and the parsed value are each referenced many times; as separate
    projections (which Catalyst keeps apart because they are expensive and reused)
    they are computed once instead of once per reference.
    """
    t_s, t_p = f"__{out}_s", f"__{out}_p"
    df = df.withColumn(t_s, F.regexp_replace(F.col(src).cast("string"), _TRIM, ""))
    df = df.withColumn(t_p, _parsed(F.col(t_s), formats)).drop(t_s)
    return df.withColumn(out, F.when(in_range(F.col(t_p), as_of), F.col(t_p))).drop(t_p)


def to_timestamp_col(c, dtype: str, as_of=None) -> Column:
    """Timestamp expression for a source column of Spark type ``dtype``."""
    if dtype in _TIME_TYPES:
        ts = col_of(c).cast("timestamp")
        return F.when(in_range(ts, as_of), ts)
    return parse_timestamp(c, as_of)


def day_key(ts) -> Column:
    return F.date_format(col_of(ts), "yyyy-MM-dd")


def month_key(ts) -> Column:
    return F.date_format(col_of(ts), "yyyy-MM")


def epoch_micros(ts) -> Column:
    return F.unix_micros(col_of(ts))
