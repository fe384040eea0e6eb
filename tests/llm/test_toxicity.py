"""Toxicity: Viterbi against enumeration, restored obfuscations, held-out accuracy, edges."""

import itertools
import random
import zlib

import numpy as np
import pytest

from tallyscope.llm import toxicity as tx

DOC = "doc_id long, text string"
BAD = ["idiot", "stupid", "loser", "worthless"]


def model_of(spark, texts):
    return tx.char_model(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOC))


@pytest.fixture(scope="module")
def model(spark):
    return model_of(spark, ["an idiot and a stupid loser feel worthless in the cold rain near the old mill"] * 20)


def test_counts_equal_brute_force(spark):
    texts = ["Ab cé", None, "", "a", "xyz\tq", "0!"]
    got = np.exp(model_of(spark, texts))
    n = np.full((28, 28, 28), 0.5)
    for t in texts:
        c = [0 if b in b" \t\n\x0b\x0c\r" else (b | 32) - 96 if chr(b).isascii() and chr(b).isalpha() else 27
             for b in (t or "").encode()]
        for x in zip(c, c[1:], c[2:]):
            n[x] += 1
    assert np.allclose(got, n / n.sum(axis=2, keepdims=True))


def test_viterbi_equals_enumeration(model):
    r = tx.Restorer(model)

    def cost(path):
        x = y = 0
        s = 0.0
        for letters, p in path:
            s += p
            for ch in letters:
                c = r._code(ch)
                s, x, y = s + r.model[x][y][c], y, c
        return s + r.model[x][y][0]

    for w in ["1d10t", "st00pid", "l00oser", "w0rth1ess", "a", "1", "ss!!", "i.d.i.o.t"]:
        best = max(itertools.product(*r.lattice(w)), key=cost)
        assert cost([(t, p) for t, p in best]) == pytest.approx(cost_of(r, w, cost))


def cost_of(r, w, cost):
    got = r.decode(w)
    return max(cost(p) for p in itertools.product(*r.lattice(w)) if "".join(t for t, _ in p) == got)


@pytest.mark.parametrize("text,word", [
    ("you 1d10t", "idiot"), ("an i d i o t here", "idiot"), ("so stuuuupid!", "stupid"),
    ("l.o.s.e.r", "loser"), ("w0r7hl3ss", "worthless"), ("IDIOT!!", "idiot"), ("(loser)", "loser"), ("$tupid", "stupid")])
def test_restores(model, text, word):
    assert word in tx.Restorer(model).words(text)


@pytest.mark.parametrize("text,word", [
    ("i d i o t.", "idiot"), ("such a l o s e r!", "loser"), ("a l o s e r", "loser"), ("'i d i o t'", "idiot"),
    ("an a s s", "ass"), ("s t u p i d !", "stupid"), ("1 d 1 0 t.", "idiot"), ("stuupid", "stupid"), ("idiiot!", "idiot"),
    ("s-tupid", "stupid"), ("st.upid,", "stupid"), ("lo_ser", "loser"), ("wor-thl3ss", "worthless")])
def test_restores_narrow_spellings(model, text, word):
    assert word in tx.Restorer(model).words(text)


def test_one_path_words_equal_the_lattice(model):
    r = tx.Restorer(model)
    for w in ["s-tupid", "st.upid", "plain", "é-x", "2-b"]:
        assert r.decode(w) == "".join(max(slot, key=lambda x: x[1])[0] for slot in r.lattice(w))


def corpus(n=600, seed=1):
    rnd = random.Random(seed)
    v = [f"{a}{b}" for a in ("ran", "tel", "mor", "vis", "kup") for b in ("en", "ost", "ila", "ur", "ash", "e")]
    hide = [lambda w: w, lambda w: w.replace("i", "1").replace("o", "0"), " ".join, lambda w: w[:2] + w[1] * 3 + w[2:]]
    docs, labels = [], []
    for i in range(n):
        w, toxic = [rnd.choice(v) for _ in range(rnd.randint(5, 60))], i % 5 == 0
        if toxic:
            w.insert(rnd.randrange(len(w)), rnd.choice(hide if i % 10 else hide[:1])(rnd.choice(BAD)))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tx.toxicity(d, lab).collect()}
    assert len(got) == len(docs)
    out = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == set(out)
    right = sum(got[i].predicted == labels[i][2] for i in out) / len(out)
    hidden = [i for i in out if labels[i][2]]
    assert right > 0.95 and sum(got[i].predicted for i in hidden) / len(hidden) > 0.85
    assert all(0 <= r.score <= 1 for r in got.values())


def test_learns_only_from_allowed_rows(spark):
    docs, labels = corpus(200)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    d = spark.createDataFrame(docs, DOC)
    res = [sorted((r.doc_id, r.score) for r in tx.toxicity(d, spark.createDataFrame(
        x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flipped)]
    assert res[0] == res[1]


def test_edges(spark):
    lab = "doc_id long, quality int, toxic int"
    assert tx.toxicity(spark.createDataFrame([], DOC), spark.createDataFrame([], lab)).count() == 0
    rows = [(None, "x"), (1, None), (1, ""), (2, "a b c d e f g"), (3, "!!! 000 " * 3000), (3, "é" * 5000)]
    d = spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS score", "true AS held_out")
    got = tx.toxicity(d, spark.createDataFrame([(2, 1, None), (None, 1, 1), (3, 1, 1), (3, 1, 0)], lab)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
