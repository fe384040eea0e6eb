"""Helpers shared by the training-data operators (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of blanks; a word is a run of anything else.
BLANKS = r"[\x20\x09-\x0D]+"
#: The same characters, for ``translate`` and ``trim``.
BLANK_CHARS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order (null text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), lambda w: w != "")


def shingle_hashes(items: Column, k: int) -> Column:
    """64-bit hash of every run of ``k`` consecutive items of an array, by position."""
    last = F.size(items) - k
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(items, i + 1, F.lit(k))))


def pack(docs: DataFrame) -> DataFrame:
    """One struct column ``row`` holding every input column, so that an operator's own
    working columns can never clash with a name the caller uses."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def text_id(text: Column) -> Column:
    """128-bit identity of a text as 16 bytes (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
