"""Decontamination against brute force over all windows, and the fingerprint index's promise."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyscope.llm import decontam as dc


def nw(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def sh(w):
    return Counter(" ".join(w[i:i + 5]) for i in range(max(len(w) - 4, 1)))


def sim(a, b):
    x, y = sh(a), sh(b)
    return sum((x & y).values()) / sum((x | y).values())


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = nw(t)
        for k, it in items:
            iw = nw(it)
            if not iw:
                continue
            best = max((sim(w[s:s + len(iw)], iw) for s in range(len(w)) if w[s:s + len(iw)]), default=0)
            if best >= dc.SIMILARITY:
                out[d, k] = round(best, 9)
    return out


def cases():
    rnd = random.Random(5)
    v = [f"t{i}" for i in range(300)]

    def words(n):
        return [rnd.choice(v) for _ in range(n)]

    items = [(k, words(rnd.choice([3, 15, 20, 20, 40, 59]))) for k in range(12)]
    docs = []
    for d in range(40):
        w = words(rnd.randint(5, 120))
        for k, it in rnd.sample(items, rnd.choice([0, 1, 2])):
            it = list(it)
            if rnd.random() < .4:
                it[rnd.choice([0, -1, len(it) // 2])] = "changed"
            at = rnd.randint(0, len(w))
            w[at:at] = it
        docs.append((d, rnd.choice([" ", ", ", "\n"]).join(w).upper() if d % 3 else " ".join(w)))
    docs += [(100, None), (101, ""), (102, "t1 " * 500)]
    return docs, [(k, " ".join(w)) for k, w in items] + [(50, None), (51, ""), (52, " ".join(items[1][1])), (None, " ".join(items[2][1]))]


def test_equals_brute_force(spark):
    docs, items = cases()
    want = brute(docs, items)
    d = spark.createDataFrame(docs + docs[:2], "doc_id long, text string").withColumn("th", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want and len(got) == len(want)
    assert len(want) > 20
    bad = {k[0] for k in want}
    assert sorted(r.doc_id for r in dc.drop_leaks(d, b).collect()) == sorted(
        i for i, _ in docs + docs[:2] if i not in bad)


def test_blocks_find_all_within_radius(spark):
    rnd = random.Random(2)
    a = [rnd.getrandbits(63) for _ in range(40)]
    rows = []
    for x in a:
        y = x
        for b in rnd.sample(range(63), rnd.randint(0, 20)):
            y ^= 1 << b
        rows.append((x, y))
    df = spark.createDataFrame(rows, "a long, b long")
    near = {(r.a, r.b) for r in df.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= dc.RADIUS).collect()}
    met = df.select("a", "b", dc._blocks(F.col("a")).alias("x")).join(
        df.select(F.col("a").alias("a2"), F.col("b").alias("b2"), dc._blocks(F.col("b")).alias("x")), "x").where(
        "a = a2 and b = b2").select("a", "b").distinct()
    assert near <= {(r.a, r.b) for r in met.collect()}


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert dc.leaks(d, b).count() == 0 and dc.leaks(some, b).count() == 0 and dc.drop_leaks(some, b).count() == 1
