"""Importance resampling towards a target corpus by hashed n-grams.

The texts of a batch are joined with a sentinel that no word holds; one regex pass over the whole
finds all words, ``searchsorted`` over the texts' offsets tells whose each word is, which masks the
n-grams that would run from one text into the next, and ``bincount`` adds up the buckets.

Every text is read once: its bucket numbers (two bytes each) are written to the shared folder, and the corpus
counts, then the weights, come from those.  A bucket's gain is the floored log-ratio of its smoothed
target and raw frequency, a document's weight the floored mean gain of its features.  Gumbel noise
from a hash of the id turns the highest scores into a draw without replacement.  Scores are integers
of a few ten thousand values (gains and noise are logarithms), so one count for each value gives every
drawn document's rank without a global sort.

Defined results: null and empty texts have no word, no feature and weight 0.  A null id is hashed as ''.
Ties in score go to the smaller id (null first), then to fewer features; repeated rows are rows of their
own.  Very long texts are read whole, in a chunk of their own.  Empty tables give an empty result; an
empty target corpus leaves the gains to the smoothing.  Further columns play no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import land
from .textcodes import chunks

BUCKETS = 10_000
NGRAM = 1
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Words whose hash a task remembers.
HELD = 200_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SENTINEL = b"\x00"


class _Hashes(dict):
    """crc32 of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        got = self[word] = crc32(word)
        return got


def features(texts: list[bytes], hashes: dict[bytes, int], n: int = NGRAM,
             buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, text number of each, number of words of each text), features by text."""
    joined = SENTINEL.join(texts).lower()  # of bytes: A-Z only
    begins = np.cumsum([0, *(len(t) + len(SENTINEL) for t in texts)])
    words, starts = [], []
    for m in _WORD.finditer(joined):
        words.append(m[0])
        starts.append(m.start())
    text = np.searchsorted(begins, np.array(starts, np.int64), "right") - 1
    code = np.fromiter((hashes[w] for w in words), np.int64, len(words))
    codes, owners = [code % buckets], [text]
    for k in range(1, n):
        if len(words) <= k:
            break
        whole = text[k:] == text[:-k]  # the run stays within one text
        code = code[:len(words) - k].copy()
        for i in np.flatnonzero(whole).tolist():
            code[i] = crc32(b" " + words[i + k], int(code[i]))
        codes.append(code[whole] % buckets)
        owners.append(text[:-k][whole])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(codes)[order], owner[order], np.bincount(text, minlength=len(texts))


def bucket_lists(docs: DataFrame, n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, codes): the buckets of each text's features as packed integers."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for a, b, data, offs in chunks(batch["text"]):
                raw = data.tobytes()
                code, owner, n_words = features([raw[i:j] for i, j in zip(offs[:-1], offs[1:])], hashes, n, buckets)
                count = np.bincount(owner, minlength=b - a)
                ends = np.append(0, np.cumsum(count)) * kind.itemsize
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [
                    None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(code.astype(kind))])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(count, pa.int64()),
                     packed.cast(pa.binary())], ["doc_id", "n_words", "n_features", "codes"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_features bigint, codes binary")


def _packed(column: pa.Array, buckets: int) -> np.ndarray:
    """All bucket numbers of a batch, one text after the other."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = memoryview(column.buffers()[2] or b"")[ends[0]:ends[-1]] if len(column) else b""
    return np.frombuffer(raw, "<u2" if buckets <= 1 << 16 else "<u4")


def bucket_counts(lists: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: tasks bring their counts, Spark adds them, ``buckets`` numbers come back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_packed(batch["codes"], buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = lists.select("codes").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed target and raw frequency) of each bucket."""
    raw_all, target_all = float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) * raw_all / ((s + 1.0) * target_all)))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weights(lists: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a text's features, 0 without any."""
    shared = lists.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.append(0, np.cumsum(shared.value[_packed(batch["codes"], len(shared.value))]))
            count = batch["n_features"].to_numpy()
            ends = np.cumsum(count)
            mean = (value[ends] - value[ends - count]) // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_words"], batch["n_features"], pa.array(mean, pa.int64())],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return lists.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def with_score(weighed: DataFrame, seed: str = SEED) -> DataFrame:
    """``score``: the weight plus 1000 times a Gumbel variable made of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    noise = -1000 * F.log(-F.log((h + 0.5) / 4294967296.0))
    return weighed.withColumn("score", F.col("weight") + F.floor(noise))


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds ``rank``: 1, 2, 3... for the ``percent`` of the texts of ``min_words`` words with the highest scores, else null."""
    fit = F.col("n_words") >= min_words
    # integer scores: a few ten thousand rows at any corpus size
    levels = scored.where(fit).groupBy(F.col("score").alias("level")).agg(F.count("*").alias("_n"))
    down = Window.orderBy(F.desc("level"))
    levels = levels.withColumns({
        "_above": F.sum("_n").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"),
        "_drawn": F.expr(f"sum(_n) OVER () * {percent} DIV 100")}).where("_above < _drawn").drop("_n")
    met = scored.join(F.broadcast(levels), fit & (F.col("score") == F.col("level")), "left")
    within = Window.partitionBy("score").orderBy("doc_id", "n_features")
    high = met.where(F.col("level").isNotNull()).withColumn("rank", F.col("_above") + F.row_number().over(within))
    high = high.withColumn("rank", F.when(F.col("rank") <= F.col("_drawn"), F.col("rank")))
    rest = met.where(F.col("level").isNull()).withColumn("rank", F.lit(None).cast("bigint"))
    return high.unionByName(rest).drop("level", "_above", "_drawn")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, n: int = NGRAM, buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``; ``target`` needs a text column."""
    lists = land(bucket_lists(docs, n, buckets), "resample-buckets")
    aims = bucket_lists(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), n, buckets)
    gain = gains(bucket_counts(lists, buckets), bucket_counts(aims, buckets))
    return draw(land(with_score(weights(lists, gain), seed), "resample-scores"), percent, min_words)
