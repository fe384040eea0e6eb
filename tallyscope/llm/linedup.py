"""Line dedup: repeated windows of three consecutive lines, removed where they recur.

Lines with a word are numbered inside their document; every window of three consecutive
such lines is hashed (two 64-bit hashes of the blank-trimmed lines).  A window that occurs
more than once in the corpus keeps its first occurrence, by document id and position; the
lines covered by any later occurrence are removed (covered positions are merged, so
overlapping windows remove each line once).  Blank lines stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, pack

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _full_lines(text: Column) -> Column:
    """Trimmed lines that hold a word."""
    trimmed = F.transform(_lines(text), lambda x: F.btrim(x, F.lit(BLANK_CHARS)))
    return F.filter(trimmed, lambda x: x != "")


def _windows(docs: DataFrame) -> DataFrame:
    """(id, th, p, h1, h2): one row for every window of every document."""
    df = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"),
                     _full_lines(F.col("text")).alias("l"))
    starts = F.sequence(F.lit(0), F.size("l") - WINDOW)
    df = df.where(F.size("l") >= WINDOW).select("id", "th", "l", F.explode(F.transform(starts, lambda i: F.struct(
        i.alias("p"), F.xxhash64(F.slice("l", i + 1, F.lit(WINDOW))).alias("h1"),
        F.xxhash64(F.lit("second"), F.slice("l", i + 1, F.lit(WINDOW))).alias("h2")))).alias("w"))
    return df.select("id", "th", "w.p", "w.h1", "w.h2")


def covered_lines(docs: DataFrame) -> DataFrame:
    """(id, th, covered): for each document that loses lines, the numbers of the lines covered
    by later occurrences.  The repeated windows come from a map-side combined aggregate;
    a hot window's rows meet its one first occurrence in a sort-merge join that adaptive
    execution splits."""
    win = _windows(docs)
    first = (win.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "p")).alias("f"))
             .where("n > 1").select("h1", "h2", "f"))
    later = win.join(first, ["h1", "h2"]).where(
        ~F.struct("id", "th", "p").eqNullSafe(F.col("f"))).select("id", "th", "p")
    return later.groupBy("id", "th").agg(F.collect_set("p").alias("starts")).select("id", "th", F.array_distinct(
        F.flatten(F.transform("starts", lambda p: F.sequence(p, p + WINDOW - 1)))).alias("covered"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """Every input row as struct ``row`` with ``new_text``, ``n_lines`` (lines with a word) and
    ``n_removed``.

    Rows with equal id and text count as one document: they share first occurrences and
    lose the same lines.  Documents with equal ids and different texts are told apart by the
    text's hash, which also breaks ties of order; null ids come first.  Null texts stay null;
    documents of fewer than three lines with a word have no window and stay as they are.  A
    line goes with its line break; a document all of whose lines go ends as empty text.
    """
    cov = covered_lines(docs)
    df = pack(docs).withColumn("th", F.xxhash64("row.text"))
    df = df.join(cov, F.col("row.doc_id").eqNullSafe(cov["id"]) & (df["th"] == cov["th"]), "left").select(
        "row", "covered")
    df = df.withColumn("_l", _lines(F.col("row.text")))
    number = F.array().cast("array<int>")
    full = F.filter(F.transform("_l", lambda x, i: F.when(F.btrim(x, F.lit(BLANK_CHARS)) != "", i)),
                    lambda i: i.isNotNull())
    df = df.withColumn("_f", full)
    gone = F.transform(F.coalesce("covered", number), lambda k: F.get(F.col("_f"), k))
    df = df.withColumn("_keep", F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), gone))
    left = F.array_join(F.transform("_keep", lambda i: F.get(F.col("_l"), i)), "\n")
    return df.select("row", F.when(F.col("covered").isNull(), F.col("row.text")).otherwise(left).alias("new_text"),
                     F.size("_f").cast("bigint").alias("n_lines"),
                     F.coalesce(F.size("covered"), F.lit(0)).cast("bigint").alias("n_removed"))
