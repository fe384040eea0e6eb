"""ProbMinHash classes against brute-force probability Jaccard and union-find."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyscope.llm import neardup as nd
from tallyscope.llm import textcodes as tc

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = (t or "").split()
    if not w:
        return Counter()
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def jp(x, y):
    total = 0.0
    for d in x.keys() & y.keys():
        total += 1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys())
    return total


def brute(rows):
    texts = {}
    for i, t in rows:
        t = t or ""
        texts[t] = min(texts.get(t, i), i)
    up = {t: t for t in texts}

    def find(t):
        while up[t] != t:
            t = up[t]
        return t

    prof = {t: shingles(t) for t in texts}
    ts = list(texts)
    for a in range(len(ts)):
        for b in range(a):
            if prof[ts[a]] and jp(prof[ts[a]], prof[ts[b]]) >= nd.SIMILARITY:
                up[find(ts[a])] = find(ts[b])
    least = {}
    for t in ts:
        least[find(t)] = min(least.get(find(t), texts[t]), texts[t])
    return {i: least[find(t or "")] for i, t in rows}


def corpus(seed=3):
    rnd = random.Random(seed)
    vocab = ["ab", "cdé", "x", "the", "of", "zz", "gh", "lorem", "qu"] + [f"w{i}" for i in range(60)]
    rows, n = [], 0
    for _ in range(40):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(1, 160))]
        for _ in range(rnd.randint(1, 6)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((n, rnd.choice([" ", "\n", "  "]).join(w)))
            n += 1
    chain = [rnd.choice(vocab) for _ in range(120)]  # each link is near its neighbours only
    for k in range(30):
        chain[(k * 7) % 120] = f"c{k}"
        rows.append((n, " ".join(chain)))
        n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "  \n"), (n + 3, "a a a a a a a a a a"), (n + 4, "a " * 3000)]
    return rows


def test_codes_equal_python_words():
    texts = ["a bb  ccc\t\n", "", None, "ünï x\xa0y", " lead", "a bb", "bb", "a b c d e f a b c d e f"]
    out = []
    for a, b, data, offs in tc.chunks(pa.array(texts)):
        words, counts = tc.word_codes(data, offs)
        assert list(counts) == [len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
                                for t in texts[a:b]]
        out = np.split(words, np.cumsum(counts)[:-1])
    assert out[0][0] == out[5][0] and out[0][1] == out[6][0] and len(set(out[0])) == 3
    code, text = tc.shingle_codes(np.concatenate(out), np.array([len(x) for x in out]), 5)
    own = code[text == 7]
    assert len(own) == 8 and len(set(own)) == 6


def test_signature_estimates_probability_jaccard():
    x = Counter({i: 1 + i % 3 for i in range(200)})
    y = Counter({i: 1 + i % 4 for i in range(40, 230)})
    sig = []
    for c in (x, y):
        code = tc.mix64(np.array(sorted(c), np.uint64))
        sig.append(nd.signatures(code, np.zeros(len(code), int), np.array([c[k] for k in sorted(c)], float), 1, 4096)[0])
    want = jp(x, y)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04
    ax = (np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)]))
    ay = (np.array(sorted(y), np.uint64), np.array([y[k] for k in sorted(y)]))
    assert nd.probability_jaccard(ax, ay) == pytest.approx(want)


def test_blocks_find_all_similar_pairs():
    rows = [t for _, t in corpus(5) if shingles(t)][:90]
    x, y = pa.array(rows[:50]), pa.array(rows[50:] + rows[:5])
    want = {(i, j) for i in range(len(x)) for j in range(len(y))
            if (i + j) % 3 and jp(shingles(x[i].as_py()), shingles(y[j].as_py())) >= nd.SIMILARITY}
    apart = np.add.outer(np.arange(len(x)), np.arange(len(y))) % 3 > 0
    got = [pair for a, b in nd._similar(x, y, apart) for pair in zip(a.tolist(), b.tolist())]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_forest_connects_the_same():
    one, two = np.array([5, 7, 9, 20, 9]), np.array([7, 9, 11, 21, 5])
    roots, others = nd._forest(one, two)
    assert set(zip(roots.tolist(), others.tolist())) == {(5, 7), (5, 9), (5, 11), (20, 21)}


# dense 0: every mixed bucket takes the rare-shingle way; 3 rows: a bucket has many blocks
@pytest.mark.parametrize("dense,rows_of_block", [(4096, 256), (4096, 3), (0, 256)])
def test_classes_equal_brute_force(spark, monkeypatch, dense, rows_of_block):
    monkeypatch.setattr(nd, "DENSE", dense)
    monkeypatch.setattr(nd, "BLOCK_ROWS", rows_of_block)
    rows = corpus()
    rows.append(rows[0])
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    got = nd.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    kept = nd.drop_near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_edges(spark):
    assert nd.near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (None, None), (4, "a b c"), (4, "other words here")],
                                 "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS v")
    got = {(r.doc_id, r.representative) for r in nd.near_duplicates(docs).collect()}
    assert got == {(None, True), (4, False), (4, True)}
    assert nd.drop_near_duplicates(docs).count() == 3
