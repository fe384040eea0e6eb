"""Importance resampling: plain Python over whole tables, n-grams, ranks and edges."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tallyscope.llm import queries, resample
from tests.conftest import SF

DOC = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, n):
    w = words_of(text)
    return [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=10, n=1, buckets=10_000, min_words=20):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for g in grams(t, n):
                out[zlib.crc32(g.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        g = grams(text, n)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(g), weight, score, None, len(words_of(text))])
    fit = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for i, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_whole_table_equals_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    df = queries.op13_target_resampling(spark, SF)
    assert rows_of(df) == brute(docs, target)
    assert dict(df.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")


@pytest.mark.parametrize("n,buckets", [(2, 97), (3, 70_000)])
def test_longer_runs_stay_within_a_text(spark, n, buckets):
    docs = [(i, t) for i, t in enumerate(["a b c d", "e", "", None, "F g. h\x00i", "Éa日 b2 c", "z z z z z"] * 3)]
    target = ["a b", "c d e", None]
    frame = spark.createDataFrame(docs, DOC)
    got = resample.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), 50, n, buckets, 2)
    assert rows_of(got) == brute(docs, target, 50, n, buckets, 2)


def test_one_pass_over_a_batch():
    texts = ["", "Ab c", "c ab", "", "x-y_z 9"]
    code, owner, n_words = resample.features([t.encode() for t in texts], resample._Hashes(), 2, 1 << 32)
    assert n_words.tolist() == [len(words_of(t)) for t in texts]
    for i, t in enumerate(texts):
        assert sorted(code[owner == i].tolist()) == sorted(zlib.crc32(g.encode()) for g in grams(t, 2))


def test_hash_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(resample, "HELD", 4)
    hashes = resample._Hashes()
    assert [hashes[bytes([65 + i])] for i in range(20)] == [zlib.crc32(bytes([65 + i])) for i in range(20)]
    assert len(hashes) <= 5


def test_ranks_with_equal_scores(spark):
    rows = [(i, 30, 30, 0, s) for i, s in zip((9, 3, 7, 1, 5, 2, 8, 4), (5, 5, 5, 5, 2, 9, 5, 2))] + [(6, 3, 3, 0, 99)]
    frame = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    got = {r.doc_id: r["rank"] for r in resample.draw(frame, 50).collect()}
    assert got == {2: 1, 1: 2, 3: 3, 7: 4, 8: None, 9: None, 5: None, 4: None, 6: None}


def test_edges(spark):
    long = "lang und breit " * 60_000
    rows = [(None, "a " * 30), (None, "b " * 40), (1, None), (2, ""), (3, "..."), (4, long), (4, long), (5, "a " * 20), (5, "a " * 20),
            (6, "a " * 19)]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], DOC + ", rank long, level string")
    target = spark.createDataFrame([("a a b", 0), (None, 0)], "text string, codes long")
    assert rows_of(resample.resample(docs, target, 100)) == brute(rows, ["a a b", None], 100)
    assert rows_of(resample.resample(docs, target.limit(0))) == brute(rows, [])
    assert resample.resample(docs.limit(0), target).collect() == []


def test_packed_lists_of_sliced_batches():
    import pyarrow as pa
    col = pa.array([np.array(x, "<u2").tobytes() for x in ([1, 2], [], [3], [4, 5])], pa.binary())
    assert resample._packed(col.slice(1, 3), 10_000).tolist() == [3, 4, 5]
    assert resample._packed(col.slice(0, 0), 10_000).tolist() == []
