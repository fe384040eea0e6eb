"""Language of every text by a byte convolutional network.

The network reads fixed-length windows of UTF-8 bytes: filters of several widths, each with a weight
for every byte value at every place, max pooling over the window, ReLU and a softmax over the languages.
It is trained in numpy on labelled texts and then applied to batches of windows that cover each text
wholly; a text's probabilities are the mean of its windows', weighted by their bytes of letters.

Training rows: non-null text, language and id, crc32(doc_id as text) mod 4 not 2.  At most ``TRAIN_ROWS``
rows, equally many of each language where there are enough, those of the smallest hash of their ids;
of each row at most ``ROW_WINDOWS`` windows, those of the smallest hash of their place.  This documented
bound holds at every corpus size; every text is read whole when it is labelled.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is everything
where no language can be learned.  A null id counts as not held out.  Repeated rows and equal texts get
equal predictions; of equal probabilities the alphabetically first language wins.  Very long texts are
cut into windows chunk by chunk; empty tables give an empty result; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import land
from .textcodes import chunks, mix64

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
TRAIN_ROWS = 8_000
ROW_WINDOWS = 6
PASSES = 4
#: Batches at least, for small corpora.
LEAST_STEPS = 400
BATCH = 64
RATE = 0.004
#: Languages up to which their sizes are broadcast.
MANY = 10_000
#: Windows that the network reads at once.
AT_ONCE = 64
UNKNOWN = "und"
PAD = 0x20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows of bytes, text number of each): consecutive, the last one of a text padded with blanks."""
    lengths = np.diff(offs)
    n = -(-lengths // WINDOW)
    text = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    at = (offs[:-1][text] + nth * WINDOW)[:, None] + np.arange(WINDOW)
    inside = at < offs[1:][text][:, None]
    if not len(data):
        return np.zeros((0, WINDOW), np.uint8), text
    return np.where(inside, data[np.minimum(at, len(data) - 1)], PAD).astype(np.uint8), text


@dataclass
class ByteNet:
    """``filters``: for each width an array (place, byte, filter); ``dense``: (pooled filters, language)."""

    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, n_out: int, rng: np.random.Generator) -> ByteNet:
        pooled = FILTERS * len(WIDTHS)
        return cls([rng.normal(0, 0.3 / w ** 0.5, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
                   np.zeros(pooled, np.float32), rng.normal(0, 0.2, (pooled, n_out)).astype(np.float32),
                   np.zeros(n_out, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.dense, self.out_bias]

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest value of each filter over the window, before bias and ReLU; where it is, on demand."""
        best, at = [], []
        for f in self.filters:
            w, last = len(f), x.shape[1] - len(f) + 1
            got = f[0][x[:, :last]]
            for k in range(1, w):
                got += f[k][x[:, k:last + k]]
            if places:
                place = got.argmax(axis=1)
                at.append(place)
                best.append(np.take_along_axis(got, place[:, None, :], axis=1)[:, 0])
            else:
                best.append(got.max(axis=1))
        return np.concatenate(best, axis=1), at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.out_bias)), np.float32)
        for a in range(0, len(x), AT_ONCE):
            hidden = np.maximum(self.pooled(x[a:a + AT_ONCE])[0] + self.bias, 0)
            z = hidden @ self.dense + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[a:a + AT_ONCE] = z / z.sum(axis=1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of a batch and its gradient for every parameter."""
        best, at = self.pooled(x, places=True)
        raw = best + self.bias
        hidden = np.maximum(raw, 0)
        z = hidden @ self.dense + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        rows = np.arange(len(x))
        loss = -float(np.log(np.maximum(p[rows, y], 1e-30)).mean())
        p[rows, y] -= 1
        p /= len(x)
        back = (p @ self.dense.T) * (raw > 0)  # reaches a filter only at its largest place
        grads = []
        for j, (f, place) in enumerate(zip(self.filters, at)):
            own, g = back[:, j * FILTERS:(j + 1) * FILTERS], np.zeros_like(f)
            for k in range(len(f)):
                np.add.at(g[k], (x[rows[:, None], place + k], np.arange(FILTERS)), own)
            grads.append(g)
        return loss, [*grads, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]


def train(x: np.ndarray, y: np.ndarray, n_out: int, seed: int = 0) -> ByteNet:
    """Adam over shuffled batches; half of the windows are cut short, so that short texts are known too."""
    rng = np.random.default_rng(seed)
    net = ByteNet.fresh(n_out, rng)
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    weight = 1.0 / np.maximum(np.bincount(y, minlength=n_out), 1)
    steps = max(LEAST_STEPS, PASSES * -(-len(x) // BATCH))
    for step in range(1, steps + 1):
        pick = rng.choice(len(x), size=min(BATCH, len(x)), p=weight[y] / weight[y].sum())  # every language alike
        batch = x[pick]
        cut = np.where(rng.random(len(pick)) < 0.5, rng.integers(12, WINDOW + 1, len(pick)), WINDOW)
        batch = np.where(np.arange(WINDOW) < cut[:, None], batch, PAD).astype(np.uint8)
        _, grads = net.gradients(batch, y[pick])
        rate = RATE * (1 - (step - 1) / steps) * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
        for p, g, m, v in zip(net.parameters(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * m / (np.sqrt(v) + 1e-8)
    return net


def training_windows(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(lang, id, place, window) of the training rows: at most ``rows`` texts and ``ROW_WINDOWS`` windows of each."""
    ids = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("id"), "lang")
    ids = land(ids.distinct(), "langid-ids")
    sizes = land(ids.groupBy("lang").agg(F.count("*").alias("n")), "langid-sizes")
    n = sizes.count()
    quota = max(1, rows // max(1, n))
    # of a large language only ids of small hashes, four times as many as are wanted, so that no task orders all of them
    small = F.xxhash64("id") / F.lit(2.0 ** 64) + 0.5 < 4.0 * quota / F.col("n")
    ids = ids.join(F.broadcast(sizes) if n <= MANY else sizes, "lang").where(small)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= quota).orderBy("_n", "lang").limit(rows).select("id", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(batch["text"]):
                x, text = windows(data, offs)
                begin = np.searchsorted(text, np.arange(b - a))
                place = np.arange(len(text)) - begin[text] if len(text) else text
                order = np.lexsort((mix64(place.astype(np.uint64)), text))
                at = np.sort(order[place < ROW_WINDOWS])  # the first ones of each text in hash order
                owner = pa.array(text[at] + a)
                yield pa.RecordBatch.from_arrays(
                    [batch["lang"].take(owner), batch["id"].take(owner), pa.array(place[at], pa.int64()),
                     pa.array([w.tobytes() for w in x[at]], pa.binary())], ["lang", "id", "place", "window"])

    # at most ``rows`` ids
    texts = docs.select(F.col("doc_id").alias("id"), "lang", "text").join(F.broadcast(ids), ["id", "lang"])
    return texts.select("lang", F.col("id").cast("bigint").alias("id"), "text").mapInArrow(
        run, "lang string, id bigint, place bigint, window binary")


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, seed: int = 0) -> tuple[ByteNet | None, list[str]]:
    """(network, its languages); the windows that come to the driver are bounded by ``rows``."""
    got = training_windows(docs, rows).toArrow().sort_by([(c, "ascending") for c in ("lang", "id", "place", "window")])
    names = sorted(set(got["lang"].to_pylist()))
    if not names:
        return None, []
    x = np.frombuffer(b"".join(got["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(names, got["lang"].to_pylist())
    return train(x, y, len(names), seed), names


def predict(docs: DataFrame, net: ByteNet | None, names: list[str]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((net, names))  # some 40,000 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, langs = shared.value
        for batch in batches:
            known, score = [], []
            for a, b, data, offs in chunks(batch["text"]):
                x, text = windows(data, offs)
                mass = np.zeros((b - a, max(1, len(langs))))
                if model is not None and len(x):
                    weight = _LETTER[x].sum(axis=1)
                    used = np.flatnonzero(weight)
                    np.add.at(mass, text[used], model.probabilities(x[used]) * weight[used, None])
                total = mass.sum(axis=1)
                known += [langs[i] if t > 0 else UNKNOWN for i, t in zip(mass.argmax(axis=1), total)]
                score += (mass.max(axis=1) / np.where(total > 0, total, 1)).clip(0, 1).tolist()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], batch["letters"], pa.array(known, pa.string()),
                                              pa.array(score, pa.float64())], ["doc_id", "held_out", "letters", "known", "own"])

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                      F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    out = src.mapInArrow(run, "doc_id bigint, held_out boolean, letters boolean, known string, own double")
    return out.select("doc_id", "held_out", F.when(F.col("letters"), F.col("known")).otherwise(UNKNOWN).alias("lang_pred"),
                      F.when(F.col("letters"), F.col("own")).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Train on the labelled texts of ``docs`` and predict the language of every row."""
    return predict(docs, *fit(docs, rows))
