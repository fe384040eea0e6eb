"""Masked pseudo-likelihood: gradient, normalisation, held-out gain over unigrams, edges."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyscope.llm import lm_score as lm
from tallyscope.llm import textcodes as tc

DOC = "doc_id long, text string"


def sample(n=400):
    rng = np.random.default_rng(0)
    return rng.integers(0, lm.VOCAB, n).astype(np.int32), rng.integers(0, lm.VOCAB + 1, (4, n)).astype(np.int32)


def test_probabilities_sum_to_one():
    w = lm.unpack(lm.start_weights())
    ids, around = np.arange(lm.VOCAB, dtype=np.int32), np.repeat(sample(1)[1], lm.VOCAB, axis=1)
    logp, _ = lm.forward(w, ids, around)
    assert np.exp(logp.astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_gradient_equals_differences():
    flat = lm.start_weights().astype(np.float64)
    ids, around = sample(50)

    def loss(f):
        return -lm.forward(lm.unpack(f), ids, around)[0].mean()

    w = lm.unpack(flat)
    g = lm.gradient(w, around, lm.forward(w, ids, around)[1])
    at = list(np.argsort(-np.abs(g))[:20]) + [len(g) - 1, len(g) - 100]
    for i in at:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        assert g[i] == pytest.approx((loss(up) - loss(down)) / 2e-4, rel=2e-2, abs=1e-6)


def test_windows_mask_the_token_and_stop_at_texts():
    for _, _, data, offs in tc.chunks(pa.array(["a b c d", "", "e"])):
        ids, around, pos = lm.windows(*tc.word_codes(data, offs))
    assert list(pos) == [0, 1, 2, 3, 0]
    assert list(around[:, 0]) == [lm.VOCAB, lm.VOCAB, ids[1], ids[2]]
    assert list(around[:, 2]) == [ids[0], ids[1], ids[3], lm.VOCAB]
    assert list(around[:, 4]) == [lm.VOCAB] * 4


def text(rnd, n):
    out = []
    for _ in range(n):
        k = rnd.randrange(12)
        out += [f"open{k}", f"mid{rnd.randrange(3)}", f"close{k}"]
    return " ".join(out)


def test_held_out_beats_unigrams_and_shuffled_text(spark):
    rnd = random.Random(4)
    train = [text(rnd, 120) for _ in range(400)]
    held = [text(rnd, 120) for _ in range(20)]
    mixed = [" ".join(rnd.sample(t.split(), len(t.split()))) for t in held]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(train)], DOC).repartition(3)
    w = lm.fit(docs, rounds=3)
    got = {r.doc_id: r.mean_log_probability for r in lm.score(
        spark.createDataFrame([(i, t) for i, t in enumerate(held + mixed)], DOC), w).collect()}
    c = Counter(x for t in train for x in t.split())
    uni = sum(np.log(c[x] / sum(c.values())) for t in held for x in t.split()) / sum(len(t.split()) for t in held)
    own = np.mean([got[i] for i in range(20)])
    assert own > uni + 0.2
    assert all(got[i] > got[20 + i] for i in range(20))


def test_edges(spark):
    assert lm.lm_score(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, None), (1, ""), (1, " \n"), (2, "one"), (2, "one"), (3, "long text " * 40000)]
    d = spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS n_tokens", "2 AS x")
    got = lm.lm_score(d).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 0, 1, 1, 80000]
    assert all((r.mean_log_probability is None) == (r.n_tokens == 0) for r in got)
    assert len({r.log_likelihood for r in got if r.n_tokens == 1}) == 1


def test_every_position_is_a_target_once():
    for rounds in (1, lm.ROUNDS, 5):
        picked = [lm.targets(np.arange(1000), k, rounds) for k in range(rounds)]
        assert sorted(np.concatenate(picked)) == list(range(1000))


def test_training_predicts_every_token(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i + 1))) for i in range(40)], DOC)
    vocab = lm.vocabulary(docs)
    units = lm.units_of(docs, vocab, 5)
    assert units.select("unit").distinct().count() == 5
    shared = spark.sparkContext.broadcast(lm.start_weights())
    n = [units.mapInArrow(lm._report(shared, k, lm.ROUNDS, 2), lm.SUMS).where("block = 0").selectExpr("sum(n) AS n").first().n
         for k in range(lm.ROUNDS)]
    assert sum(n) == sum(range(1, 41)) and min(n) > 0


def test_units_are_whole_and_in_order(spark):
    docs = spark.createDataFrame([(i % 7, f"a{i % 50} b c" if i % 9 else None) for i in range(300)], DOC)
    vocab = lm.vocabulary(docs)
    found = lm.units_of(docs.repartition(6), vocab, 8).select("unit", "h", "ids", lm.F.spark_partition_id().alias("p")).collect()
    assert len(found) == docs.where("text IS NOT NULL").count()
    of = {}
    for r in found:
        of.setdefault(r.unit, []).append((r.p, r.h))
    assert len(of) > 1 and all(len({p for p, _ in x}) == 1 and [h for _, h in x] == sorted(h for _, h in x) for x in of.values())
    rows = pa.RecordBatch.from_pydict({"unit": [0, 0, 3, 3, 3], "ids": [b"\x01\x00", b"\x02\x00\x03\x00", b"", b"\x04\x00", b"\x05\x00"]})
    got = [(u, [(x.tolist(), n.tolist()) for piece in p for x, n in lm._pieces(piece)]) for u, p in lm._by_unit(iter([rows, rows.slice(3)]))]
    assert got == [(0, [([1, 2, 3], [1, 2])]), (3, [([4, 5], [0, 1, 1]), ([4, 5], [1, 1])])]


def test_scores_do_not_depend_on_partitions(spark):
    rnd = random.Random(8)
    docs = spark.createDataFrame([(i, text(rnd, rnd.randrange(60))) for i in range(300)], DOC)
    scores = []
    for n in (2, 12):
        model = lm.fit(docs.repartition(n), unit_tokens=4000)
        scores.append([r.mean_log_probability for r in lm.score(docs, model).orderBy("doc_id").collect()])
    pairs = [(a, b) for a, b in zip(*scores) if a is not None]
    assert len(pairs) > 250 and max(abs(a - b) for a, b in pairs) < 1e-4


def test_scores_equal_plain_python(spark):
    """Every document of a small corpus, token by token, from the weights and the counts of the words."""
    rnd = random.Random(3)
    texts = [text(rnd, 15) + f" only{i}" for i in range(30)] + ["", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    model = lm.fit(docs)
    w, counts = lm.unpack(model.weights.astype(np.float64)), Counter(x for t in texts for x in t.split())

    def id_of(word):
        for _, _, data, offs in tc.chunks(pa.array([word])):
            return int(lm.token_ids(tc.word_codes(data, offs)[0], model.vocabulary.own, model.vocabulary.own_ids)[0])

    ids = {x: id_of(x) for x in counts}
    shared = {}
    for x, n in counts.items():
        if ids[x] >= lm.OWN:
            shared.setdefault(ids[x], []).append(n)

    def soft(h, out, b, pick):
        x = h @ out + b
        return x[pick] - np.log(np.exp(x).sum())

    got = {r.doc_id: r.log_likelihood for r in lm.score(docs, model).collect()}
    for i, t in enumerate(texts):
        ws, total = t.split(), 0.0
        for at, word in enumerate(ws):
            z = w["bias"].copy()
            for j, o in enumerate(lm.WINDOW):
                z += w["emb"][j][ids[ws[at + o]] if 0 <= at + o < len(ws) else lm.VOCAB]
            one, two = divmod(ids[word], lm.DIGIT)
            total += soft(np.tanh(z), w["out1"], w["b1"], one) + soft(np.tanh(z + w["digit"][one]), w["out2"], w["b2"], two)
            if ids[word] >= lm.OWN:
                of = shared[ids[word]]
                total += np.log((counts[word] + lm.UNSEEN) / (sum(of) + lm.UNSEEN * (len(of) + 1)))
        assert got[i] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_scores_cover_the_actual_tokens(spark):
    """Words of one shared id differ by their counts; the word probabilities of an id sum to 1."""
    rnd = random.Random(5)
    often = [f"often{k}" for k in range(lm.OWN)]
    rare = [f"rare{k}" for k in range(6000)]
    n = {x: rnd.randint(1, 3) for x in rare}
    texts = [" ".join(often)] * 5 + [" ".join(x for x in rare[k::7] for _ in range(n[x])) for k in range(7)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(3)
    vocab = lm.vocabulary(docs)
    assert vocab.words.count() == lm.OWN + 6000 and len(vocab.own) == lm.OWN
    model = lm.Model(lm.start_weights(), vocab)

    def bucket(word):
        for _, _, data, offs in tc.chunks(pa.array([word])):
            return int(lm.token_ids(tc.word_codes(data, offs)[0], vocab.own, vocab.own_ids)[0])

    assert sorted(bucket(x) for x in often) == list(range(lm.OWN))
    groups = {}
    for x in rare:
        groups.setdefault(bucket(x), []).append(x)
    one = max(groups.values(), key=len)
    assert len({n[x] for x in one}) > 1 and min(groups) >= lm.OWN
    new = next(f"new{k}" for k in range(10 ** 6) if bucket(f"new{k}") == bucket(one[0]))
    got = [r.log_likelihood for r in lm.score(spark.createDataFrame(list(enumerate([*one, new])), DOC).coalesce(1), model)
           .orderBy("doc_id").collect()]
    network = lm.forward(lm.unpack(model.weights), np.array([bucket(new)], np.int32), np.full((4, 1), lm.VOCAB, np.int32))[0]
    assert np.exp(np.array(got) - network).sum() == pytest.approx(1, rel=1e-4)
    for x, g in zip(one, got):
        assert g - got[-1] == pytest.approx(np.log((n[x] + lm.UNSEEN) / lm.UNSEEN), abs=1e-5)
