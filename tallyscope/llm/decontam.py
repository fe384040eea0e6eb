"""Benchmark decontamination by SimHash of item-sized windows.

Texts are cut into normalised words (letters and digits, lower case).  For every benchmark
item of n words, windows of n words of a document are fingerprinted with a 64-bit SimHash
of their words, weighted by count.  Sixteen blocks of four bits index the fingerprints: two
fingerprints within ``RADIUS`` = 15 bits agree in at least one whole block, so joining on
(window size, block, value) finds every pair within the radius.  Candidates are verified by
the exact weighted (multiset) Jaccard similarity of their five-word shingles.

A window without any shingle of the benchmark has similarity 0 with every item, so only
windows in which a benchmark shingle stands where it stands in an item of that size are
fingerprinted.  This loses no window that verification could keep in that alignment.

Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import land
from .common import pack, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
BLOCKS = 16
#: BLOCKS - 1: with one more block than differing bits, some block agrees.
RADIUS = BLOCKS - 1
#: Rows of the shingle table up to which it is broadcast (24 bytes each, so 48 MB); above,
#: the join with the documents' shingles is by shuffle.
BROADCAST_ROWS = 2_000_000


def norm_words(text: Column) -> Column:
    """Lower-case runs of letters and digits (null text: none)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def simhash(w: Column) -> Column:
    """64-bit SimHash of a word array, each word as often as it occurs."""
    h = F.transform(w, lambda x: F.xxhash64(x))

    def bit(b):
        votes = F.aggregate(h, F.lit(0), lambda a, x: a + F.when(
            F.expr("1L") == F.call_function("getbit", x, b), 1).otherwise(-1))
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(
            F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(bit(b)))


def _blocks(fp: Column) -> Column:
    width = BITS // BLOCKS
    return F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(fp, k * width).bitwiseAND(
        F.lit(2 ** width - 1)).alias("x")) for k in range(BLOCKS)]))


def _shingles(w: Column) -> Column:
    """Five-word shingles as text; fewer words make one shingle of them all."""
    last = F.greatest(F.size(w) - SHINGLE, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i + 1, F.lit(SHINGLE)), " "))


def similarity(a: Column, b: Column) -> Column:
    """Multiset Jaccard of two shingle arrays: every copy of a shingle is numbered, so that set
    operations count copies."""
    def numbered(s):
        s = F.sort_array(s)
        return F.transform(s, lambda x, i: F.concat_ws("\n", x, (i - F.array_position(s, x)).cast("string")))
    x, y = numbered(a), numbered(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _items(benchmark: DataFrame) -> DataFrame:
    """Distinct item texts with a word: (w, n, fp); item ids are joined back by words."""
    w = benchmark.select(norm_words(F.col("text")).alias("w")).distinct().where(F.size("w") > 0)
    return land(w.select("w", F.size("w").alias("n"), simhash(F.col("w")).alias("fp")), "leak-items")


def _anchors(items: DataFrame, k: int) -> DataFrame:
    """(h, offset, n): where a shingle of k words stands in items of n words; without item
    identity, so a shingle that many items share gives few rows."""
    at = items.select("n", F.posexplode(shingle_hashes(F.col("w"), k)).alias("offset", "h"))
    return at.select("h", "offset", "n").distinct()


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, th, start, n): item-sized windows of documents that align a benchmark shingle."""
    # items shorter than a shingle are anchored by their whole length: at most five lengths
    lengths = [r[0] for r in items.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect()]
    src = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), norm_words(F.col("text")).alias("w"))
    parts = []
    for k in sorted(lengths):
        own = items.where(F.least("n", F.lit(SHINGLE)) == k)
        anchors = land(_anchors(own, k), "leak-anchors")
        if anchors.count() <= BROADCAST_ROWS:
            anchors = F.broadcast(anchors)
        at = src.select("id", "th", F.posexplode(shingle_hashes(F.col("w"), k)).alias("p", "h"))
        parts.append(at.join(anchors, "h").select("id", "th", F.greatest(
            F.col("p") - F.col("offset"), F.lit(0)).alias("start"), "n"))
    if not parts:
        return src.select("id", "th", F.lit(0).alias("start"), F.lit(0).alias("n")).where(F.lit(False))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, similarity_at_least: float = SIMILARITY) -> DataFrame:
    """(doc_id, th, item_id, similarity, start): for each document and benchmark item, the best
    window (smallest start on ties; ``start`` counts normalised words).

    ``th`` is the hash of the text, which tells rows with equal ids apart; equal rows (id and
    text) give one result.  Items with equal words each give a row.  Null and empty texts and
    items match nothing; null ids are kept as null.  A window cut short by the end of a
    document is compared as it is.  Empty tables give an empty result.
    """
    items = _items(benchmark)
    win = land(windows(docs, items), "leak-windows")
    per_doc = win.groupBy("id", "th").agg(F.collect_set(F.struct("start", "n")).alias("win"))
    src = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("dh"), F.col("text").alias("t"))
    cut = (src.join(per_doc, src["d"].eqNullSafe(per_doc["id"]) & (src["dh"] == per_doc["th"]))
           .select("id", "th", norm_words(F.col("t")).alias("w"), "win")
           .select("id", "th", "w", F.explode("win").alias("x"))
           .select("id", "th", "x.start", "x.n", F.slice("w", F.col("x.start") + 1, F.col("x.n")).alias("w"))
           .dropDuplicates(["id", "th", "start", "n"]))
    # few bytes but much work, here and below: a number of tasks that holds at every size, not one by bytes
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.repartition(tasks)
    prints = land(cut.withColumn("fp", simhash(F.col("w"))), "leak-prints")
    near = (prints.select("n", "fp").distinct().select("n", "fp", _blocks(F.col("fp")).alias("block"))
            .join(items.select("n", F.col("fp").alias("ifp"), _blocks(F.col("fp")).alias("block")).distinct(),
                  ["n", "block"])
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("n", "fp", "ifp").distinct())
    pairs = prints.join(near, ["n", "fp"]).join(items.select(
        "n", F.col("fp").alias("ifp"), F.col("w").alias("iw")), ["n", "ifp"]).repartition(tasks)
    pairs = pairs.withColumn("a", _shingles(F.col("w"))).withColumn("b", _shingles(F.col("iw"))).select(
        "id", "th", "iw", "start", similarity(F.col("a"), F.col("b")).alias("similarity"))
    # landed before the filter, which would else move below the repartition with all that it computes
    sure = land(pairs, "leak-similarities").where(F.col("similarity") >= similarity_at_least)
    best = sure.groupBy("id", "th", "iw").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("m"))
    names = benchmark.select("item_id", norm_words(F.col("text")).alias("iw"))
    return best.join(names, "iw").select(F.col("id").alias("doc_id"), "th", "item_id", F.col("m.similarity").alias(
        "similarity"), (-F.col("m.s")).alias("start"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item."""
    bad = leaks(docs, benchmark).select("doc_id", "th").distinct()
    df = pack(docs).withColumn("h", F.xxhash64("row.text"))
    on = df["row.doc_id"].eqNullSafe(bad["doc_id"]) & (df["h"] == bad["th"])
    return df.join(bad, on, "left_anti").select("row.*")
