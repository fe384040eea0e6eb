"""Quality rules against plain-Python counts and a brute-force log-likelihood ratio."""

import math
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyscope.llm import quality

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def spark_hash(*parts: str) -> int:
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed & (2 ** 64 - 1))
    return seed - 2 ** 64 if seed >= 2 ** 63 else seed


def buckets(ws, n):
    return [spark_hash(w) % n for w in ws] + [spark_hash(a, b) % n for a, b in zip(ws, ws[1:])]


def py_words(t):
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def base(t):
    t = t or ""
    ws = py_words(t)
    win = Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
    hit = {i + j for i in range(len(ws) - 7) if win[tuple(ws[i:i + 8])] > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if py_words(x)]
    return (len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(hit), len(ws) < 20 or 100 * len(hit) > 30 * len(ws))


CASES = [
    (1, " ".join(f"w{i}ing" for i in range(40))),
    (2, None), (3, ""), (4, " \t\n "),
    (5, "one two three four five six seven eight " * 5),
    (6, "a b c\n" * 30),
    (7, "ünï çode ### $$$ <b> " * 9 + "\x0b x\xa0y"),
    (8, " ".join(f"w{i}ing" for i in range(40))),
    (9, "x"), (None, "no id but words " * 8), (9, "x"),
    (11, "long tail " * 20000),
    (12, " ".join("abcdefgh") + " z " + " ".join("abcdefgh") + " " + " ".join(f"q{i}" for i in range(60))),
]


def judged(spark, rows, labels, **kw):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return quality.quality_rules(docs, lab, **kw)


def test_rules_equal_plain_python(spark):
    got = judged(spark, CASES, [(1, 1, 0)]).select(
        "row.doc_id", "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed").collect()
    assert len(got) == len(CASES)
    for r in got:
        assert tuple(r)[2:] == base(r.text), r.doc_id


def test_score_equals_brute_force(spark):
    n, prior = 50, 100.0
    labels = [(1, 1, 0), (1, 1, 0), (5, 0, 0), (8, 1, 1), (None, 1, 0), (777, 1, 0)]
    raw, good = Counter(), Counter()
    for i, t in CASES:
        b = buckets(py_words(t or ""), n)
        raw.update(b)
        if i in (1, 8):
            good.update(b)
    rs, gs = sum(raw.values()), sum(good.values())
    w = {k: math.log((good[k] + prior * raw[k] / rs) / (gs + prior) / (raw[k] / rs)) for k in raw}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in CASES], DOC)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, lab, n, prior), n, 0.0).collect()
    for r in got:
        b = buckets(py_words(r.row.text or ""), n)
        want = sum(w[k] for k in b) / len(b) if b else None
        assert (r.score is None) == (want is None)
        if want is not None:
            assert r.score == pytest.approx(want, abs=1e-9)
            assert r.kept == (not r.base_failed and want >= 0)
        else:
            assert not r.kept


def test_edges(spark):
    empty = judged(spark, [], [])
    assert empty.count() == 0
    # no trusted row: every weight is 0 and only the base rules decide
    got = judged(spark, CASES, []).collect()
    assert all(r.kept == (not r.base_failed) for r in got)
    # clashing extra columns survive in the row
    docs = spark.createDataFrame([(1, "a b", 9, "x")], "doc_id long, text string, score int, _w string").withColumn(
        "weights", F.lit(1))
    lab = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    r = quality.quality_rules(docs, lab).first()
    assert (r.row.score, r.row._w, r.row.weights, r.n_words) == (9, "x", 1, 2)


def test_keep_gives_the_kept_rows_whole(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(30 + i % 5)), "mine", i) for i in range(40)]
    rows += [(None, None, "mine", 1), (3, "", "mine", 2), (5, "too short", "mine", 3), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, number long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    want = sorted(tuple(r.row) for r in quality.quality_rules(docs, labels).collect() if r.kept)
    got = quality.keep(docs, labels)
    assert got.columns == docs.columns and want and sorted(tuple(r) for r in got.collect()) == want
    assert quality.keep(docs.where("false"), labels).count() == 0


def test_labels_are_told_apart(spark):
    """Trusted text is kept, junk goes; texts that differ only in stems score apart."""
    import random
    rnd = random.Random(2)
    stems, junk = [f"stem{k}ing" for k in range(60)], [f"junk{k}ing" for k in range(60)]
    rows = [(i, " ".join(rnd.choices(junk if i % 5 == 0 else stems, k=200)), "en", "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, labels, prior=1000.0)).collect()
    assert all(r.kept == (r.row.doc_id % 5 != 0) for r in got)
