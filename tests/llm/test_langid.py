"""Language ID: gradients, a plain convolution, held-out accuracy, bounds and edges."""

import zlib

import numpy as np
import pytest

from tallyscope.llm import langid, queries
from tests.conftest import SF

DOC = "doc_id long, text string, lang string"


def plain_probabilities(net, window):
    """The network written as loops over places, filters and offsets."""
    pooled = []
    for f in net.filters:
        for j in range(f.shape[2]):
            pooled.append(max(sum(float(f[k, window[i + k], j]) for k in range(len(f)))
                              for i in range(len(window) - len(f) + 1)))
    hidden = [max(0.0, v + float(b)) for v, b in zip(pooled, net.bias)]
    z = [sum(h * float(net.dense[i, o]) for i, h in enumerate(hidden)) + float(net.out_bias[o])
         for o in range(len(net.out_bias))]
    e = [np.exp(v - max(z)) for v in z]
    return np.array(e) / sum(e)


def some_net(n_out=3, seed=1):
    rng = np.random.default_rng(seed)
    net = langid.ByteNet.fresh(n_out, rng)
    net.bias += rng.normal(0, 0.1, len(net.bias)).astype(np.float32)
    return net


def test_forward_equals_plain_convolution():
    net, x = some_net(), np.random.default_rng(2).integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    got = net.probabilities(x)
    for row, window in zip(got, x):
        assert np.allclose(row, plain_probabilities(net, window), atol=1e-4)


def test_gradients_equal_differences():
    net = some_net()
    for f in (*net.filters, net.dense):
        f += 0  # own copies
    net = langid.ByteNet([f.astype(np.float64) for f in net.filters], net.bias.astype(np.float64),
                         net.dense.astype(np.float64), net.out_bias.astype(np.float64))
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grads = net.gradients(x, y)
    for p, g in zip(net.parameters(), grads):
        flat, at = p.reshape(-1), np.argsort(-np.abs(g).reshape(-1))[:4]
        for i in at:
            keep, eps = flat[i], 1e-6
            flat[i] = keep + eps
            up = net.gradients(x, y)[0]
            flat[i] = keep - eps
            down = net.gradients(x, y)[0]
            flat[i] = keep
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[i]) < 1e-4


def test_windows_cover_every_byte():
    texts = [b"", b"a" * langid.WINDOW, b"", b"b" * (2 * langid.WINDOW + 7), b"c"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    x, owner = langid.windows(data, np.cumsum([0, *map(len, texts)]))
    back = [b"".join(w.tobytes() for w, o in zip(x, owner) if o == i) for i in range(len(texts))]
    for text, got in zip(texts, back):
        assert got[:len(text)] == text and set(got[len(text):]) <= {langid.PAD}
        assert len(got) == -(-len(text) // langid.WINDOW) * langid.WINDOW


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.op11_language_id(spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert sum(held) / len(held) >= 0.95


def test_labels_of_held_out_rows_are_never_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", langid.F.when(langid.held_out(langid.F.col("doc_id")), "xx").otherwise(langid.F.col("lang")))
    (a, names), (b, others) = langid.fit(docs), langid.fit(other)
    assert names == others and all(np.array_equal(p, q) for p, q in zip(a.parameters(), b.parameters()))


def test_fit_is_bounded_and_free_of_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = langid.training_windows(docs, rows=12).collect()
    by_row = {}
    for r in few:
        by_row.setdefault((r.lang, r.id), []).append(r.place)
    langs = [lang for lang, _ in by_row]
    assert len(by_row) <= 12 and max(map(langs.count, langs)) <= 3
    assert max(map(len, by_row.values())) <= langid.ROW_WINDOWS
    one, many = langid.fit(docs.repartition(1), 40)[0], langid.fit(docs.repartition(7), 40)[0]
    assert all(np.array_equal(p, q) for p, q in zip(one.parameters(), many.parameters()))


def test_rows_are_those_of_the_smallest_hash(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('word ', id) AS text", "IF(id % 10 = 0, 'bb', 'aa') AS lang")
    got = {(r.lang, r.id) for r in langid.training_windows(docs, rows=40).collect()}
    ranked = docs.where(~langid.held_out(langid.F.col("doc_id"))).orderBy(langid.F.xxhash64("doc_id"), "doc_id").collect()
    want = {(lang, r.doc_id) for lang in ("aa", "bb") for r in [x for x in ranked if x.lang == lang][:20]}
    assert got == want


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [(i, ("kaka loko tiki " if i % 2 else "zürß schön ächzt ") * (1 + i % 5), "aa" if i % 2 else "bb") for i in range(60)]
    return spark.createDataFrame(rows, DOC)


def test_edges(spark, tiny):
    net, names = langid.fit(tiny)
    assert names == ["aa", "bb"]
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "12 .. 7!", None), (None, "tiki kaka", "bb"), (4, "loko tiki " * 30_000, None),
            (4, "loko tiki " * 30_000, None), (5, "schön", "aa"), (6, "x" * 400_000, None)]
    docs = spark.createDataFrame([(*r, "k", "u") for r in rows], DOC + ", known string, score string")
    got = [tuple(r) for r in langid.predict(docs, net, names).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i][2:] == ("und", 0.0) for i in (1, 2, 3))
    assert by[None][1] is False and by[None][2] == "aa"
    assert by[4][2] == "aa" and [r for r in got if r[0] == 4][0] == [r for r in got if r[0] == 4][1]
    assert by[5][2] == "bb" and by[6][2] in names


def test_nothing_to_learn(spark, tiny):
    for docs in (tiny.limit(0), tiny.withColumn("lang", langid.F.lit(None).cast("string"))):
        got = langid.identify(docs).collect()
        assert len(got) == docs.count() and all(r.lang_pred == "und" and r.score == 0 for r in got)
