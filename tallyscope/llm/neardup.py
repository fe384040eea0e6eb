"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

A text is the weighted set of its five-word shingles, a shingle weighing its count.  Each
shingle sends a Poisson process of exponential arrivals at rate = weight, every arrival
hitting a random register; a register keeps its earliest arrival.  A shingle stops as soon
as its next arrival is later than every register's (early termination).  Two texts agree
in a register with probability equal to their probability Jaccard similarity.

Bands of registers give buckets.  Inside a bucket every text is compared with one hub
member only: the comparison first estimates the similarity from one byte of every register,
drops pairs five standard errors below the threshold, and verifies the others by the exact
probability Jaccard of their texts.  Buckets that then still hold several components fall in
two kinds.  Where at most ``DENSE`` members are outside the largest component, these are
dealt out to blocks of bounded size that meet blocks of all the bucket's members; a task
verifies two blocks at once by matrix products of their shingle counts and returns a forest
of the components it connects, so that no pair without a link is ever a row.  Members of the
other, dense buckets (texts around one very common passage, say) meet, in blocks as well, by
their rare shingles: similarity s means that the common shingles carry at least s of either
text's weight, so the rarest common one is among the rarest shingles carrying 1 - s of each.
Texts that share only the common passage do not meet that way, however many they are.  No
link that the bands find is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import land
from . import textcodes as tc
from .common import pack, text_id

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
REGISTERS = BANDS * ROWS
#: Estimates below this are not verified: five standard errors under the threshold.
FLOOR = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
#: Stands for a null document id inside this module; it sorts first.
NO_ID = -2 ** 63
#: Up to so many members outside a bucket's largest component are compared in blocks: about what
#: the rare shingles of one text cost against one member.
DENSE = 4096
#: Members and bytes of text that make up one block of a comparison.
BLOCK_ROWS = 256
BLOCK_BYTES = 1 << 19
#: Shingles (columns of a matrix product) that a comparison of two blocks takes at once.
COLUMNS = 8192


def signatures(code: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int,
               registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signature (n_texts x registers) of distinct weighted shingles, sorted by text."""
    time = np.full(n_texts * registers, np.inf)
    sig = np.zeros(n_texts * registers, np.uint64)
    at, seed, rate, owner = np.zeros(len(code)), code, 1.0 / weight, text
    step = 0
    while len(at):
        step += 1
        draw = tc.mix64(seed + np.uint64(step * 0x9E3779B97F4A7C15 % 2 ** 64))
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53) * rate
        slot = owner * registers + (tc.mix64(draw) % np.uint64(registers)).astype(np.int64)
        live = at <= time[slot]
        np.minimum.at(time, slot[live], at[live])
        won = live & (at == time[slot])
        sig[slot[won]] = seed[won]
        latest = time.reshape(n_texts, registers).max(axis=1)
        stay = at < latest[owner]
        at, seed, rate, owner = at[stay], seed[stay], rate[stay], owner[stay]
    return sig.reshape(n_texts, registers)


def band_codes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit code for each band of each signature; the band's number is part of it."""
    parts = sig.reshape(len(sig), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        out = tc.mix64(out + np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out.view(np.int64)


SIGNED = "id bigint, h binary, bands array<bigint>, sketch binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in tc.chunks(batch["t"]):
            words, counts = tc.word_codes(data, offs)
            code, text, weight = tc.counted(*tc.shingle_codes(words, counts, SHINGLE))
            sig = signatures(code, text, weight.astype(float), b - a)
            lens = np.where(counts > 0, BANDS, 0)  # without a word there is no band
            bands = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lens))).astype(np.int32),
                                             pa.array(band_codes(sig)[counts > 0].reshape(-1)))
            sketch = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.arange(
                0, (b - a + 1) * REGISTERS, REGISTERS, dtype=np.int32)), pa.py_buffer((tc.mix64(
                    sig) >> np.uint64(56)).astype(np.uint8).tobytes())])
            yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), batch["h"].slice(a, b - a), bands, sketch],
                                             ["id", "h", "bands", "sketch"])


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose sketches agree in enough registers."""
    for batch in batches:
        sides = [np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("as", "bs")]
        out = batch.filter(pa.array((sides[0] == sides[1]).mean(axis=1) >= FLOOR))
        yield pa.RecordBatch.from_arrays([out["an"], out["bn"]], ["an", "bn"])


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common shingles d of 1 / sum over e of max(x_e / x_d, y_e / y_d)."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    both = np.stack((x[1][i], y[1][j]), axis=1).astype(float)
    only_x, only_y = x[1].sum() - both[:, 0].sum(), y[1].sum() - both[:, 1].sum()
    pairs, times = np.unique(both, axis=0, return_counts=True)
    below = [only_x / a + only_y / b + (np.maximum(pairs[:, 0] / a, pairs[:, 1] / b) * times).sum() for a, b in pairs]
    return float((times / np.array(below)).sum())


def _profile(value: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(value.as_buffer() or b"", np.uint8)
    words, counts = tc.word_codes(data, np.array([0, len(data)]))
    code, _, weight = tc.counted(*tc.shingle_codes(words, counts, SHINGLE))
    return code, weight


#: Shingles of decoded texts that a verifying task keeps at hand.
HELD = 1_000_000


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarity of each pair; a text's shingles are worked out once while they are held."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    size = 0
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        sides = [(batch[n].to_pylist(), batch[t]) for n, t in (("an", "at"), ("bn", "bt"))]
        for r in range(len(batch)):
            own = []
            for number, text in sides:
                got = held.get(number[r])
                if got is None:
                    got = _profile(text[r])
                    if size > HELD:
                        held, size = {}, 0
                    held[number[r]], size = got, size + len(got[0])
                own.append(got)
            keep[r] = probability_jaccard(*own) >= SIMILARITY
        out = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([out["an"], out["bn"]], ["an", "bn"])


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text number, count) of a block's texts, by text and shingle."""
    out = []
    for a, _, data, offs in tc.chunks(texts):
        code, text, weight = tc.counted(*tc.shingle_codes(*tc.word_codes(data, offs), SHINGLE))
        out.append((code, text + a, weight))
    return tuple(np.concatenate(x) for x in zip(*out))


def _similar(x: pa.Array, y: pa.Array, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the texts of ``x`` and ``y`` that reach the similarity, where ``apart`` holds.

    With counts of 1 it is the number of common shingles over that of all.  For other counts, the
    common mass of both less the number of common shingles, over the mass of both less the
    smaller common mass, is never below it; pairs that reach the threshold by that bound are
    verified one by one.
    """
    sides = [_shingles(t) for t in (x, y)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    both, mass_x, mass_y = (np.zeros(apart.shape) for _ in range(3))
    for a in range(0, len(common), COLUMNS):
        columns, dense = common[a:a + COLUMNS], []
        for (code, text, weight), n in zip(sides, apart.shape):
            at = np.minimum(np.searchsorted(columns, code), len(columns) - 1)
            hit = columns[at] == code
            matrix = np.zeros((n, len(columns)))
            matrix[text[hit], at[hit]] = weight[hit]
            dense.append(matrix)
        has = [(m > 0).astype(float) for m in dense]
        both += has[0] @ has[1].T
        mass_x += dense[0] @ has[1].T
        mass_y += has[0] @ dense[1].T
    mass = [np.bincount(text, weight, n) for (_, text, weight), n in zip(sides, apart.shape)]
    rest = np.add.outer(*mass) - np.minimum(mass_x, mass_y)
    i, j = np.nonzero(apart & (rest > 0) & ((mass_x + mass_y - both) / np.maximum(rest, 1) >= SIMILARITY))
    ones = [np.bincount(text, weight > 1, n) == 0 for (_, text, weight), n in zip(sides, apart.shape)]
    sure = ones[0][i] & ones[1][j]
    yield i[sure], j[sure]
    bounds = [np.searchsorted(text, np.arange(n + 1)) for (_, text, _), n in zip(sides, apart.shape)]
    for p, q in zip(i[~sure], j[~sure]):
        own = [(code[b[r]:b[r + 1]], weight[b[r]:b[r + 1]]) for (code, _, weight), b, r in zip(sides, bounds, (p, q))]
        if probability_jaccard(*own) >= SIMILARITY:
            yield np.array([p]), np.array([q])


def _forest(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest, other) that connect what the links (one, two) connect."""
    names, at = np.unique(np.concatenate((one, two)), return_inverse=True)
    x, y = np.split(at, 2)
    root = np.arange(len(names))
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            return names[root][root != np.arange(len(names))], names[root != np.arange(len(names))]
        root = low


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks of (c, t) each, links that connect the components whose texts reach the similarity."""
    for batch in batches:
        for r in range(len(batch)):
            x, y = (batch[side][r].values for side in ("a", "b"))
            cx, cy = (z.field("c").to_numpy() for z in (x, y))
            links = list(_similar(x.field("t"), y.field("t"), cx[:, None] != cy[None, :]))
            one, two = (np.concatenate([link[s] for link in links]) for s in (0, 1))
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in _forest(cx[one], cy[two])], ["an", "bn"])


PAIRS = "an bigint, bn bigint"


def _both(pairs: DataFrame, values: DataFrame, value: str, one: str, two: str) -> DataFrame:
    """``pairs`` with the value of either side; the larger side of the second join, a hot
    number's pairs, is one that adaptive execution splits."""
    left = pairs.join(values.select(F.col("n").alias("an"), F.col(value).alias(one)), "an")
    return left.join(values.select(F.col("n").alias("bn"), F.col(value).alias(two)), "bn").select("an", "bn", one, two)


def _links(near: DataFrame, texts: DataFrame) -> DataFrame:
    """Of estimated pairs (an, bn), those whose texts reach the similarity."""
    near = land(near, "dup-near")
    return land(_both(near, texts, "t", "at", "bt").mapInArrow(_verify, PAIRS), "dup-links")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Merge the components ``c`` of ``labels`` (n, c) along ``links`` (an, bn).

    Contracting rounds: every component points to its smallest neighbour, pointers are
    doubled until they reach roots, and links inside one component fall away.  Rounds are
    few (the number of components at least halves); nothing is gathered on the driver.
    """
    one, two = labels.select(F.col("n").alias("an"), F.col("c").alias("x")), labels.select(
        F.col("n").alias("bn"), F.col("c").alias("y"))
    edges = land(links.join(one, "an").join(two, "bn").where("x <> y").select("x", "y").distinct(), "dup-edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("y", "x"))
        up = land(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p")), "dup-up")
        while True:
            over = up.select(F.col("x").alias("p"), F.col("p").alias("pp"))
            nxt = land(up.join(over, "p").select("x", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")),
                       "dup-up")
            up = nxt.select("x", "p")
            if nxt.where("moved").isEmpty():
                break
        labels = land(labels.join(up.withColumnRenamed("x", "c"), "c", "left").select(
            "n", F.coalesce("p", "c").alias("c")), "dup-labels")
        a, b = up.select("x", F.col("p").alias("px")), up.select(F.col("x").alias("y"), F.col("p").alias("py"))
        edges = land(edges.join(a, "x").join(b, "y").where("px <> py").select(
            F.col("px").alias("x"), F.col("py").alias("y")).distinct(), "dup-edges")
    return labels


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(NO_ID).cast("bigint")).alias("id")


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: (n, h, id), every distinct text with a number, its 128-bit hash and its
    smallest document id; and (n, c), the component of every text that shares a bucket."""
    texts = docs.select(_id(F.col("doc_id")), text_id(F.col("text")).alias("h"), F.coalesce(
        "text", F.lit("")).alias("t"))
    names = land(texts.groupBy("h").agg(F.min("id").alias("id")).withColumn("n", F.monotonically_increasing_id()),
                 "dup-names")
    # of equal texts the row of the smallest id; equal rows are told by the same keys, without a shuffle
    signed = land(texts.mapInArrow(_sign, SIGNED).join(names, ["h", "id"]).dropDuplicates(["h", "id"]).select(
        "n", "h", "id", "bands", "sketch"), "dup-signatures")
    members = signed.select("n", F.explode("bands").alias("b"))
    shared = members.groupBy("b").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = land(members.join(shared, "b"), "dup-members")
    # a bucket's hub is the member with the most company in all its buckets: the least edited copy
    # of a family, to which far more of the others are similar than to any member taken at random
    company = members.groupBy("n").agg(F.sum("m").alias("company"))
    hub = members.select("b", "n").join(company, "n").groupBy("b").agg(F.max(F.struct("company", "n"))["n"].alias("hub"))
    members = land(members.join(hub, "b"), "dup-members")
    wanted = land(signed.join(members.select("n").distinct(), "n", "left_semi").select("n", "h", "id", "sketch"),
                  "dup-wanted")
    pool = land(texts.join(wanted.select("n", "h", "id"), ["h", "id"]).dropDuplicates(["h", "id"]).select(
        "n", "t", F.octet_length("t").cast("bigint").alias("size")), "dup-texts")
    sketches = wanted.select("n", "sketch")
    stars = members.where("n <> hub").select(F.col("n").alias("an"), F.col("hub").alias("bn")).distinct()
    near = _both(stars, sketches, "sketch", "as", "bs").mapInArrow(_estimate, PAIRS)
    labels = components(wanted.select("n", F.col("n").alias("c")), _links(near, pool))
    # where a bucket holds two texts, one is the hub: they have been compared
    open_, mixed = _mixed(members.where("m > 2").select(F.col("b").alias("k"), "n").join(labels, "n"))
    links = _across(open_, mixed.where(F.col("outside") <= DENSE), pool)
    dense = land(open_.join(mixed.where(F.col("outside") > DENSE).select("k"), "k", "left_semi").select(
        "n", "c").distinct(), "dup-dense")
    if not dense.isEmpty():
        links = links.union(_across(*_mixed(_rare_shingles(dense, pool)), pool))
    return names, components(labels, land(links, "dup-links"))


def _mixed(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (k, n, c): the rows, landed, and the keys that hold several components, with the
    largest one (``big``) and the number of members outside it."""
    members = land(members.select("k", "n", "c"), "dup-open")
    sizes = members.groupBy("k", "c").agg(F.count(F.lit(1)).alias("m"))
    keys = sizes.groupBy("k").agg(F.max(F.struct("m", "c")).alias("big"), F.sum("m").alias("all")).select(
        "k", F.col("big.c").alias("big"), (F.col("all") - F.col("big.m")).alias("outside"))
    return members, land(keys.where("outside > 0"), "dup-mixed")


def _across(members: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between components of which members (k, n, c) share one of ``keys``, one of the two
    outside the key's largest component.

    Members outside and inside are dealt out, apart from each other, to blocks of about
    ``BLOCK_ROWS`` members and ``BLOCK_BYTES`` of text; a row is two blocks that meet.
    """
    rows = members.join(keys.select("k", "big"), "k").select("k", "n", "c", (F.col("c") != F.col("big")).alias("out"))
    rows = rows.join(texts.select("n", "size"), "n")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("parts")
    rows = rows.join(rows.groupBy("k", "out").agg(parts), ["k", "out"])
    rows = rows.select("k", "n", "c", "out", F.pmod(F.xxhash64("n"), "parts").alias("part"))
    blocks = land(rows.join(texts.select("n", "t"), "n").groupBy("k", "out", "part").agg(
        F.collect_list(F.struct("c", "t")).alias("block")), "dup-blocks")
    a = blocks.select("k", F.col("out").alias("ao"), F.col("part").alias("ap"), F.col("block").alias("a"))
    b = blocks.where("out").select("k", F.col("part").alias("bp"), F.col("block").alias("b"))
    return a.join(b, "k").where("not ao or ap <= bp").select("a", "b").mapInArrow(_block_links, PAIRS)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(len(batch)):
            code, weight = _profile(batch["t"][r])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(code), batch[c][r].as_py(), np.int64)) for c in ("n", "c")]
                + [pa.array(code.view(np.int64)), pa.array(weight / max(weight.sum(), 1))], ["n", "c", "k", "mass"])


def _rare_shingles(dense: DataFrame, texts: DataFrame) -> DataFrame:
    """(k, n, c): the rarest shingles of each text, up to 1 - similarity of its weight."""
    rows = land(texts.join(dense, "n").select("n", "c", "t").mapInArrow(
        _shingle_rows, "n bigint, c bigint, k bigint, mass double"), "dup-shingles")
    rows = rows.join(rows.groupBy("k").agg(F.count(F.lit(1)).alias("df")), "k")
    before = F.sum("mass").over(Window.partitionBy("n").orderBy("df", "k").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0.0)))
    return rows.where((F.col("before") <= 1 - SIMILARITY + 1e-9) & (F.col("df") > 1)).select("k", "n", "c")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class_id, representative): one row for every input row.

    ``class_id`` is the smallest document id of the class; ``representative`` marks the rows
    of the smallest document (smallest id, then text hash).  Equal texts are always one
    class, null counting as empty; texts without a word are linked to nothing else; null ids
    come first.  Equal rows (id and text) count as one document.  Empty tables give none.
    """
    names, labels = text_classes(docs)
    names = names.join(labels, "n", "left").select("h", "id", F.coalesce("c", "n").alias("c"))
    first = names.groupBy("c").agg(F.min(F.struct("id", "h")).alias("f"))
    names = names.join(first, "c").select("h", "f")
    rows = docs.select("doc_id", _id(F.col("doc_id")), text_id(F.col("text")).alias("h"))
    return rows.join(names, "h").select(
        "doc_id", F.col("h").alias("text_hash"), F.when(F.col("f.id") != NO_ID, F.col("f.id")).alias("class_id"),
        ((F.col("f.id") == F.col("id")) & (F.col("f.h") == F.col("h"))).alias("representative"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that represent their class; of equal rows
    of id and text one stays."""
    kept = near_duplicates(docs).where("representative").select("doc_id", "text_hash").distinct()
    df = pack(docs).withColumn("h", text_id(F.col("row.text")))
    on = df["row.doc_id"].eqNullSafe(kept["doc_id"]) & (df["h"] == kept["text_hash"])
    df = df.join(kept, on, "left_semi").withColumn("i", F.col("row.doc_id")).dropDuplicates(["i", "h"])
    return df.select("row.*")
