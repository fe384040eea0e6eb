"""Raking against plain-Python proportional fitting, and the sample's shares."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyscope.llm import mixing

DOC = "doc_id long, text string, lang string, source string"


def rows(n=300, seed=2):
    rnd = random.Random(seed)
    tail = ["", " icense", " 12345678", " | x", " ###"]
    return [(i, "w " * rnd.randint(0, 60) + rnd.choice(tail), rnd.choice(["en", "en", "de", "it", None]),
             "src0" if rnd.random() < .4 else f"src{rnd.randint(1, 6)}") for i in range(n)]


def plain(cells, targets, rounds, rate=mixing.RATE):
    dims = list(targets)
    total = sum(cells.values())
    goals = {}
    for k, d in enumerate(dims):
        mass = defaultdict(float)
        for c, b in cells.items():
            mass[c[k]] += b
        mass = {v: m for v, m in mass.items() if m}
        t = targets[d]
        if isinstance(t, dict):
            spare = sum(m for v, m in mass.items() if v not in t)
            share = {v: t[v] if v in t else max(0, 1 - sum(t.values())) * m / spare for v, m in mass.items()}
        else:
            share = {v: (m / total) ** t for v, m in mass.items()}
        goals[d] = {v: s / sum(share.values()) * total for v, s in share.items()}
    w = dict(cells)
    for _ in range(rounds):
        for k, d in enumerate(dims):
            now = defaultdict(float)
            for c, x in w.items():
                now[c[k]] += x
            w = {c: min(x * goals[d].get(c[k], 0) / now[c[k]] if now[c[k]] else 0, cells[c] / rate) for c, x in w.items()}
    return w, goals


def test_rake_equals_plain_python(spark):
    data = rows()
    df = spark.createDataFrame(data, DOC).withColumn("ratio", F.lit(1)).withColumn("row", F.lit(2))
    got = mixing.mix(df).collect()
    assert len(got) == len(data)
    cells = defaultdict(float)
    for r in got:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    want, goals = plain(cells, mixing.TARGETS, mixing.ROUNDS)
    ratio = {c: want[c] / b if b else 0 for c, b in cells.items()}
    for r in got:
        assert r.ratio == pytest.approx(ratio[r.source, r.lang, r.topic], rel=1e-9)
        assert r.probability == pytest.approx(r.ratio * mixing.RATE, rel=1e-9) and r.probability <= 1 + 1e-9
        assert not (r.selected and r.n_tokens == 0)
    assert any(r.selected for r in got if r.lang in ("it", mixing.NONE))  # languages not named have a share


def test_the_mix_has_the_target_shares(spark):
    """Where the tokens reach, and as the rounds go on."""
    rnd = random.Random(6)
    data = [(i, "w " * 20 + rnd.choice(["", " icense", " 12345678"]), rnd.choice(["en", "en", "en", "de", "fr", "es", "it"]),
             f"src{rnd.randint(0, 3)}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(data, DOC)).collect()
    lang, of = defaultdict(float), mixing.TARGETS["lang"]
    for r in got:
        lang[r.lang] += r.n_tokens * r.probability
    for v, x in lang.items():
        assert x / sum(lang.values()) == pytest.approx(of.get(v, 1 - sum(of.values())), rel=0.02)


def test_a_rare_cell_is_taken_whole_and_shrinks_no_other(spark):
    data = [(i, "w " * 30, ["en", "de", "fr", "es"][i % 4], f"src{i % 3}") for i in range(600)]
    plenty = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(data, DOC)).collect()}
    rare = {r.doc_id: r for r in mixing.mix(spark.createDataFrame([*data, (-1, "w " * 5, None, "once")], DOC)).collect()}
    assert rare[-1].probability == pytest.approx(1) and rare[-1].selected
    assert all(rare[i].probability >= 0.9 * r.probability for i, r in plenty.items())


def test_sample_agrees_with_mix(spark):
    df = spark.createDataFrame(rows() + rows()[:5], DOC).withColumn("mix_probability", F.lit(9.0))
    taken = mixing.sample(df)
    assert taken.columns == ["doc_id", "text", "lang", "source", "mix_probability"]
    want = sorted(r.doc_id for r in mixing.mix(df).where("selected").collect())
    assert sorted(r.doc_id for r in taken.collect()) == want and want


def test_edges(spark):
    assert mixing.mix(spark.createDataFrame([], DOC)).count() == 0
    got = mixing.mix(spark.createDataFrame([(None, None, None, None), (1, "", "en", "s")], DOC)).collect()
    assert [(r.n_tokens, r.selected) for r in got] == [(0, False)] * 2
