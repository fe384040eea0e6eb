"""Quality rules: fixed text rules and a hashed n-gram log-likelihood ratio.

Method: every document is a bag of hashed n-grams.  Two multinomials are estimated over
the hash buckets, one on trusted documents (``labels.quality = 1``) and one on the whole
raw corpus; a document's score is the mean log ratio of its n-grams, and a document is
kept iff the score reaches a fixed threshold.  The n-grams are whole words and whole pairs of
neighbours; the trusted multinomial is smoothed towards the raw one by a large prior, so that
rare words and pairs, seen a few times or never in trusted text, weigh little.

Built-in functions only; the model is one row of ``buckets`` doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import land
from .common import BLANK_CHARS, pack, shingle_hashes, words

BUCKETS = 32_768
#: Kept iff the mean log ratio is at least this; 0 would mean "as trusted as the corpus
#: on average", the margin leaves room for rare but clean vocabulary.
THRESHOLD = -0.035
#: Weight, in n-grams, of the raw distribution as the prior of the trusted one.
PRIOR = 1_000_000.0
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8


def ngram_buckets(w: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of the n-grams of a word array: words, then pairs of neighbours."""
    uni = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)))
    pairs = F.when(F.size(w) >= 2, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(
        F.array().cast("array<int>"))
    bi = F.transform(pairs, lambda i: F.pmod(F.xxhash64(F.get(w, i), F.get(w, i + 1)), F.lit(buckets)))
    return F.concat(uni, bi)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row, one array column ``weights``: the log ratio of every hash bucket.

    The trusted multinomial is smoothed towards the raw one by ``prior`` n-grams, so a
    bucket unseen in trusted text gets a bounded penalty and, without any trusted row,
    every weight is 0.  Counts cover all documents and all trusted labels; a document
    labelled twice counts once.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select(
        F.col("doc_id").alias("id")).distinct().withColumn("trusted", F.lit(1))
    src = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    # the same join at every size: the labels have no bound that would let them be broadcast
    counts = (src.join(trusted.hint("merge"), "id", "left")
              .select("trusted", words(F.col("t")).alias("w"))
              .select("trusted", F.explode(ngram_buckets(F.col("w"), buckets)).alias("b"))
              .groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("good")))
    counts = land(counts, "quality-counts")
    total = counts.agg(F.sum("raw").alias("raws"), F.sum("good").alias("goods"))
    ratio = counts.join(F.broadcast(total)).select(
        "b", F.log((F.col("good") + prior * F.col("raw") / F.col("raws")) / (F.col("goods") + F.lit(prior))
                   / (F.col("raw") / F.col("raws"))).alias("weight"))
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("b")).join(ratio, "b", "left")
    return land(every.agg(F.sort_array(F.collect_list(F.struct(
        "b", F.coalesce("weight", F.lit(0.0)).alias("x")))).alias("a")).select(
        F.col("a.x").alias("weights")), "quality-weights")


def _repeat_words(df: DataFrame, w: str, out: str) -> DataFrame:
    """Words inside ``REPEAT_WINDOW``-word windows that occur twice or more in the text."""
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    df = df.withColumn("_wh", F.transform(F.col(w), lambda x: F.xxhash64(x)))
    df = df.withColumn("_g", shingle_hashes(F.col("_wh"), REPEAT_WINDOW))
    df = df.withColumn("_s", F.when(
        F.size(F.array_distinct("_g")) < F.size("_g"),
        F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).otherwise(none))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, i: (
        (F.get(F.col("_s"), i - 1)["h"] == x["h"]) | (F.get(F.col("_s"), i + 1)["h"] == x["h"]))),
        lambda x: x["p"])))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-REPEAT_WINDOW).alias("last"))
    df = df.withColumn(out, F.aggregate("_p", start, lambda a, p: F.struct(
        (a["n"] + F.least(F.lit(REPEAT_WINDOW), p - a["last"])).cast("bigint").alias("n"),
        p.alias("last")), lambda a: a["n"]))
    return df.drop("_wh", "_g", "_s", "_p")


def rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the rule columns to a frame with a text column.

    ``n_words``, ``word_chars`` (code points), ``n_symbols``, ``n_dup_lines`` (lines with a
    word that equal an earlier line), ``n_repeat_words`` and ``base_failed``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_w", words(F.col(text)))
    full = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, BLANK_CHARS, "") != "")
    df = (df.withColumn("_l", full)
          .withColumn("n_words", F.size("_w").cast("bigint"))
          .withColumn("word_chars", F.length(F.translate(t, BLANK_CHARS, "")).cast("bigint"))
          .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"))
          .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint")))
    df = _repeat_words(df, "_w", "n_repeat_words")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).drop("_l")


def score(docs: DataFrame, weights: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Every input row as struct ``row`` with its rule columns, ``score`` and ``kept``.

    Null and empty texts have no word and fail the base rule (score null).  Equal rows get
    equal results; rows are neither joined nor reordered, so ties and repeated ids need no
    rule.  An empty table gives an empty result.
    """
    df = pack(docs).withColumn("_t", F.col("row.text"))
    df = rules(df, "_t").withColumn("_b", ngram_buckets(F.col("_w"), buckets))
    df = df.join(F.broadcast(weights))  # one row of `buckets` doubles
    df = df.withColumn("score", F.when(F.size("_b") > 0, F.aggregate(
        "_b", F.lit(0.0), lambda a, b: a + F.get(F.col("weights"), b.cast("int"))) / F.size("_b")))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.coalesce("score", F.lit(0.0)) >= threshold))
    return df.drop("_w", "_t", "_b", "weights")


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
                  threshold: float = THRESHOLD) -> DataFrame:
    """Fit on ``docs`` and ``labels``, then judge every document of ``docs``."""
    return score(docs, fit(docs, labels, buckets), buckets, threshold)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs`` alone.

    The optimizer would move the filter below the rule columns and write their definitions
    into it once for each use, lambdas included, so that a text is split again for every
    window.  It moves no filter below a row number, so the filter reads one.
    """
    judged = quality_rules(docs, labels).select("row", "kept", F.monotonically_increasing_id().alias("number"))
    return judged.where(F.col("kept") & (F.col("number") >= 0)).select("row.*")
