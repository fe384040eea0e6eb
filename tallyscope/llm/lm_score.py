"""Masked pseudo-likelihood scores from a bidirectional window network.

The network predicts every token from the two tokens on either side, the token itself being
masked.  Tokens are words of a vocabulary counted over all documents.  The network knows 4096
ids of two base-64 digits: the ``OWN`` most frequent words have ids of their own, the others
share ids by hash.  The output is factored: P(first digit | window) * P(second digit | window,
first digit), and for a word of a shared id * P(word | id), from the full counts of the
vocabulary, which stays a table of any size.  A document's score is the sum of the conditional
log-probabilities of all its tokens.

Training is in numpy inside Spark tasks.  Documents are dealt by a hash of id and text to units of about
``UNIT_TOKENS`` tokens, whose texts stand in hash order.  In each round every unit starts from the same
weights, goes through all its documents and reports its weights; the token-weighted mean of all
units, summed block by block in tasks, starts the next round.  Units, not partitions, decide what is
averaged, so the result does not depend on how the input is partitioned (but for the order of sums).
The rounds share out the positions of the texts by a hash of the position, so that together they are one
full pass: every token of every document is a target once.  The driver holds one set of weights, whose
size is fixed by the parameters below.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import isqrt
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import land
from . import textcodes as tc

DIGIT = 64
VOCAB = DIGIT * DIGIT
#: Most frequent words with an id of their own; the ids from there on are shared by hash.
OWN = 2048
SHARED = VOCAB - OWN  # a power of two
#: Added to the count of each word of a shared id, and to that of any word not in the vocabulary.
UNSEEN = 0.5
WINDOW = (-2, -1, 1, 2)
WIDTH = 24
ROUNDS = 2
BATCH = 4096
#: Tokens are scored in multiples of this many.
ROWS = 64
RATE = 0.15
SEED = 11
#: Tokens of a training unit; of a piece of a unit that is windowed at a time.
UNIT_TOKENS, PIECE = 1 << 21, 1 << 18
#: Weights travel in blocks of this many numbers; the units' reports of one block are first summed in about
#: as many groups as a group has units.
BLOCK = 16384
SHAPES = {"emb": (len(WINDOW), VOCAB + 1, WIDTH), "bias": (WIDTH,), "out1": (WIDTH, DIGIT), "b1": (DIGIT,),
          "digit": (DIGIT, WIDTH), "out2": (WIDTH, DIGIT), "b2": (DIGIT,)}
N_WEIGHTS = sum(int(np.prod(s)) for s in SHAPES.values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of a flat weight vector by name."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k], at = flat[at:at + n].reshape(s), at + n
    return out


def start_weights(seed: int = SEED) -> np.ndarray:
    flat = (np.random.default_rng(seed).standard_normal(N_WEIGHTS) * 0.05).astype(np.float32)
    w = unpack(flat)
    for k in ("bias", "b1", "b2"):
        w[k][:] = 0
    return flat


def count_words(docs: DataFrame) -> DataFrame:
    """(h, n): hash and count of every word of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in tc.chunks(batch["t"]):
                h, n = np.unique(tc.word_codes(data, offs)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counts = docs.select(F.col("text").alias("t")).mapInArrow(run, "h bigint, n bigint")
    return land(counts.groupBy("h").agg(F.sum("n").alias("n")), "lm-words")


class Vocabulary(NamedTuple):
    """``words`` (h, n) holds all words; the arrays, of fixed size, travel with the tasks."""

    words: DataFrame
    own: np.ndarray  # sorted hashes of the words with ids of their own
    own_ids: np.ndarray
    whole: np.ndarray  # log of the smoothed count of each shared id


def vocabulary(docs: DataFrame) -> Vocabulary:
    words = count_words(docs)
    top = words.orderBy(F.desc("n"), "h").limit(OWN).collect()
    h = np.array([r.h for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    n, kinds = np.zeros(SHARED), np.zeros(SHARED)
    if len(top) == OWN:
        rest = words.where((F.col("n") < top[-1].n) | (F.col("n") == top[-1].n) & (F.col("h") > top[-1].h))
        for r in rest.groupBy(F.col("h").bitwiseAND(F.lit(SHARED - 1)).alias("b")).agg(
                F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():  # at most SHARED rows
            n[r.b], kinds[r.b] = r.n, r.kinds
    return Vocabulary(words, h[order], order.astype(np.int32), np.log(n + UNSEEN * (kinds + 1)))


def token_ids(words: np.ndarray, own: np.ndarray, own_ids: np.ndarray) -> np.ndarray:
    ids = (words & np.uint64(SHARED - 1)).astype(np.int32) + np.int32(OWN)
    if len(own):
        at = np.minimum(np.searchsorted(own, words), len(own) - 1)
        ids = np.where(own[at] == words, own_ids[at], ids)
    return ids


def windows(words: np.ndarray, counts: np.ndarray, ids: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(token ids, their windows, position in the text); past a text's ends stands the id VOCAB.
    Without ``ids`` all words share ids by hash."""
    if ids is None:
        ids = (words % np.uint64(VOCAB)).astype(np.int32)
    ends = np.repeat(np.cumsum(counts), counts)
    begins = ends - np.repeat(counts, counts)
    at = np.arange(len(ids))
    around = np.empty((len(WINDOW), len(ids)), np.int32)
    for j, o in enumerate(WINDOW):
        ok = (at + o >= begins) & (at + o < ends)
        around[j] = np.where(ok, ids[np.clip(at + o, 0, max(len(ids) - 1, 0))] if len(ids) else 0, VOCAB)
    return ids, around, at - begins


def _softmax(h: np.ndarray, out: np.ndarray, b: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, ...]:
    """(log-probability of the picked column, exponentials of all columns, their sum) of each row."""
    x = h @ out
    x += b
    if (np.abs(out).sum(axis=0) + np.abs(b)).max() > 60:  # |h| is at most 1: below, no exponential overflows
        x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(x)), pick]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return own - np.log(total), x, total


def forward(w: dict[str, np.ndarray], ids: np.ndarray, around: np.ndarray):
    """(log-probability of each token, and what the gradient needs)."""
    z = np.take(w["emb"][0], around[0], axis=0, mode="clip")
    for j in range(1, len(WINDOW)):
        z += np.take(w["emb"][j], around[j], axis=0, mode="clip")
    z += w["bias"]
    one, two = ids // DIGIT, ids % DIGIT
    h1 = np.tanh(z)
    z += np.take(w["digit"], one, axis=0, mode="clip")
    h2 = np.tanh(z, out=z)
    p1, e1, s1 = _softmax(h1, w["out1"], w["b1"], one)
    p2, e2, s2 = _softmax(h2, w["out2"], w["b2"], two)
    return p1 + p2, (one, two, h1, h2, e1, e2, s1, s2)


def _sums(keys: np.ndarray, x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, the sum of the rows of ``x`` of each)."""
    at = np.flatnonzero(np.bincount(keys, minlength=size))
    cell = keys[:, None].astype(np.int64) * WIDTH + np.arange(WIDTH)
    return at, np.bincount(cell.ravel(), x.ravel(), size * WIDTH).reshape(size, WIDTH)[at]


def slopes(w: dict[str, np.ndarray], around: np.ndarray, held) -> list[tuple[str, tuple, np.ndarray]]:
    """(name, index, gradient of the mean negative log-probability) of all weights whose gradient
    is not plainly 0; no weight occurs twice.  Uses up ``held``."""
    one, two, h1, h2, e1, e2, s1, s2 = held
    row, n, ones = np.arange(len(one)), len(one), np.ones(len(one), h1.dtype)
    e1 /= s1[:, None]
    e2 /= s2[:, None]
    e1[row, one] -= 1
    e2[row, two] -= 1
    d2 = e2 @ w["out2"].T
    d2 *= (1 - h2 * h2) / n
    dz = e1 @ w["out1"].T
    dz *= (1 - h1 * h1) / n
    dz += d2
    every = (...,)
    out = [("out1", every, h1.T @ e1 / n), ("b1", every, ones @ e1 / n), ("out2", every, h2.T @ e2 / n),
           ("b2", every, ones @ e2 / n), ("bias", every, ones @ dz)]
    keys, x = _sums(one, d2, DIGIT)
    out.append(("digit", (keys,), x))
    dz = dz.astype(np.float64)
    for j in range(len(WINDOW)):
        keys, x = _sums(around[j], dz, VOCAB + 1)
        out.append(("emb", (j, keys), x))
    return out


def gradient(w: dict[str, np.ndarray], around: np.ndarray, held) -> np.ndarray:
    """Gradient of the mean negative log-probability, flat."""
    flat = np.zeros(N_WEIGHTS, np.float32)
    g = unpack(flat)
    for name, at, x in slopes(w, around, held):
        g[name][at] = x
    return flat


def train(flat: np.ndarray, stream: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, int]:
    """Adagrad over (ids, windows) pieces; returns (weights, number of targets)."""
    flat, power, total = flat.copy(), np.full(N_WEIGHTS, 1e-6, np.float32), 0
    w, powers = unpack(flat), unpack(power)

    def step(ids, around):
        _, held = forward(w, ids, around)
        for name, at, g in slopes(w, around, held):  # a weight of gradient 0 stays, and so does its power
            rows, power_rows = (x[name][at[0]] if len(at) == 2 else x[name] for x in (w, powers))
            g = g.astype(np.float32, copy=False)
            p = np.take(power_rows, at[-1], axis=0, mode="clip") if at[-1] is not ... else power_rows
            p = p + g * g
            power_rows[at[-1]] = p
            np.sqrt(p, out=p)
            np.divide(g, p, out=p)
            p *= np.float32(RATE)
            rows[at[-1]] -= p

    ids, around = np.zeros(0, np.int32), np.zeros((len(WINDOW), 0), np.int32)
    for i, a in stream:
        ids, around, total = np.concatenate((ids, i)), np.concatenate((around, a), axis=1), total + len(i)
        while len(ids) >= BATCH:
            step(ids[:BATCH], around[:, :BATCH])
            ids, around = ids[BATCH:], around[:, BATCH:]
    if len(ids):
        step(ids, around)
    return flat, total


def targets(pos: np.ndarray, round_no: int, rounds: int) -> np.ndarray:
    """Numbers of the tokens, by their positions in their texts, that a round predicts."""
    return np.flatnonzero(tc.mix64(pos.astype(np.uint64)) % np.uint64(rounds) == np.uint64(round_no))


def units_of(docs: DataFrame, vocab: Vocabulary, units: int) -> DataFrame:
    """(unit, h, ids): the token ids of every text with a word, whole units in a partition, in hash order."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab.own, vocab.own_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in tc.chunks(batch["t"]):
                words, counts = tc.word_codes(data, offs)
                ends = np.append(0, np.cumsum(counts) * 2).astype(np.int64)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [
                    None, pa.py_buffer(ends), pa.py_buffer(token_ids(words, *shared.value).astype("<u2"))])
                out = pa.RecordBatch.from_arrays([batch["unit"].slice(a, b - a), batch["h"].slice(a, b - a),
                                                  packed.cast(pa.binary())], ["unit", "h", "ids"])
                yield out.filter(pa.array(counts > 0))

    src = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)).cast("int").alias("unit"),
                      F.xxhash64("text", "doc_id").alias("h"), F.col("text").alias("t"))
    found = src.mapInArrow(run, "unit int, h bigint, ids binary")
    return found.repartition(units, "unit").sortWithinPartitions("unit", "h")


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """(unit, its rows in pieces): one unit after the other, each to be used up before the next."""
    def runs():
        for batch in batches:
            unit = batch["unit"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    yield int(unit[a]), batch.slice(a, b - a)
    for unit, rows in groupby(runs(), key=itemgetter(0)):
        yield unit, (r for _, r in rows)


def _pieces(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, tokens of each text) of runs of whole texts of about ``PIECE`` tokens."""
    column = rows["ids"].cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] // 2
    ids = np.frombuffer(column.buffers()[2], "<u2")
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + PIECE, "right")) - 1)
        yield ids[ends[a]:ends[b]].astype(np.int32), np.diff(ends[a:b + 1])
        a = b


def _report(shared, round_no: int, rounds: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream(pieces):
            for piece in pieces:
                for ids, counts in _pieces(piece):
                    _, around, pos = windows(ids, counts, ids)
                    pick = targets(pos, round_no, rounds)
                    yield ids[pick], around[:, pick]

        for unit, pieces in _by_unit(batches):
            flat, n = train(shared.value, stream(pieces))
            if n:
                blocks = [flat[i:i + BLOCK] * np.float32(n) for i in range(0, N_WEIGHTS, BLOCK)]
                yield _blocks(range(len(blocks)), [unit % groups] * len(blocks), [float(n)] * len(blocks), blocks)
    return run


SUMS = "block int, part int, n double, x array<float>"


def _blocks(block, part, n, x) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array(n, pa.float64()),
         pa.array(x, pa.list_(pa.float32()))], ["block", "part", "n", "x"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the reports of each block as they stream by: one array a block is held."""
    total: dict[int, list] = {}
    for batch in batches:
        for r in range(len(batch)):
            k = batch["block"][r].as_py()
            x = np.asarray(batch["x"][r].values, np.float64)
            if k in total:
                total[k][0] += batch["n"][r].as_py()
                total[k][1] += x
            else:
                total[k] = [batch["n"][r].as_py(), x.copy()]
    if total:
        ks = sorted(total)
        yield _blocks(ks, [0] * len(ks), [total[k][0] for k in ks], [total[k][1].astype(np.float32) for k in ks])


class Model(NamedTuple):
    weights: np.ndarray
    vocabulary: Vocabulary


def fit(docs: DataFrame, rounds: int = ROUNDS, unit_tokens: int = UNIT_TOKENS) -> Model:
    """Vocabulary of ``docs``, and weights trained on every token; the starting weights if it has none."""
    sc, vocab = docs.sparkSession.sparkContext, vocabulary(docs)
    total = vocab.words.agg(F.sum("n").alias("n")).first().n or 0
    units = -(-total // unit_tokens) or 1
    groups = isqrt(units)
    # kept on the executors' disks between the rounds; what is lost is made again
    src = units_of(docs, vocab, units).persist(StorageLevel.DISK_ONLY)
    flat, n_blocks = start_weights(), -(-N_WEIGHTS // BLOCK)
    for k in range(rounds):
        reports = src.mapInArrow(_report(sc.broadcast(flat), k, rounds, groups), SUMS)
        some = reports.repartition(n_blocks * groups, "block", "part").mapInArrow(_sum, SUMS)
        rows = some.repartition(n_blocks, "block").mapInArrow(_sum, SUMS).collect()  # one set of weights
        if not rows:
            break
        flat = flat.copy()
        for r in rows:
            flat[r.block * BLOCK:r.block * BLOCK + len(r.x)] = np.asarray(r.x, np.float32) / np.float32(r.n)
    src.unpersist()
    return Model(flat, vocab)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_probability) for every row of ``docs``.

    A text without a word (or null) has 0 tokens, log-likelihood 0 and a null mean.  Words that the
    vocabulary lacks count as one unseen word of their id.  Equal texts get equal scores up to
    rounding; ids play no part; empty tables give an empty result.
    """
    vocab = model.vocabulary
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, vocab.own, vocab.own_ids, vocab.whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, own, own_ids, whole = shared.value
        w = unpack(flat)
        for batch in batches:
            for a, b, data, offs in tc.chunks(batch["t"]):
                words, counts = tc.word_codes(data, offs)
                ids, around, _ = windows(words, counts, token_ids(words, own, own_ids))
                logp = np.empty(len(ids), np.float32)
                for i in range(0, len(ids), BATCH):
                    part, near = ids[i:i + BATCH], around[:, i:i + BATCH]
                    # in whole blocks of rows a token's products are rounded alike wherever it stands
                    if full := -len(part) % ROWS:
                        part, near = np.pad(part, (0, full)), np.pad(near, ((0, 0), (0, full)))
                    logp[i:i + BATCH] = forward(w, part, near)[0][:len(logp) - i]
                text, rare = np.repeat(np.arange(b - a), counts), np.flatnonzero(ids >= OWN)
                logp = logp.astype(float)
                logp[rare] -= whole[ids[rare] - OWN]
                total = np.bincount(text, logp, b - a)
                h, of, n = tc.counted(words[rare], text[rare])
                ends = np.append(0, np.cumsum(np.bincount(of, minlength=b - a))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int64, copy=False)))
                         for x in (h.view(np.int64), n)]
                yield pa.RecordBatch.from_arrays(
                    [batch["number"].slice(a, b - a), batch["doc_id"].slice(a, b - a), pa.array(counts.astype(np.int64)),
                     pa.array(total.astype(float)), *lists], ["number", "doc_id", "n_tokens", "part", "h", "times"])

    src = docs.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id").cast("bigint").alias("doc_id"),
                      F.col("text").alias("t"))
    # landed, as the row numbers are read twice
    rows = land(src.mapInArrow(run, "number bigint, doc_id bigint, n_tokens bigint, part double, h array<bigint>, "
                                    "times array<bigint>"), "lm-rows")
    rare = rows.select("number", F.explode(F.arrays_zip("h", "times")).alias("x")).select("number", "x.h", "x.times")
    # a word of a shared id holds less than one in OWN of the tokens, so no key of the join is hot
    rare = rare.join(vocab.words, "h", "left").groupBy("number").agg(F.sum(
        F.col("times") * F.log(F.coalesce("n", F.lit(0)) + F.lit(UNSEEN))).alias("own"))
    out = rows.drop("h", "times").join(rare, "number", "left").withColumn(
        "log_likelihood", F.col("part") + F.coalesce("own", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_likelihood", F.when(
        F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_probability"))


def lm_score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Train on ``docs`` and score every document of it."""
    return score(docs, fit(docs, rounds))
