"""The pipeline against a plain-Python version of its stages on a small corpus."""

import hashlib
import random

import corpus_pipeline
from tallyscope.llm import mixing

from .test_decontam import brute as leak_brute
from .test_linedup import brute as line_brute
from .test_neardup import brute as dup_brute
from .test_quality import base

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(8)
    v = [f"w{i}ing" for i in range(400)]

    def line(n):
        return " ".join(rnd.choice(v) for _ in range(n))

    items = [(k, line(rnd.randint(15, 40))) for k in range(5)]
    texts = ["\n".join(line(rnd.randint(6, 14)) for _ in range(rnd.randint(4, 12))) for _ in range(60)]
    passage = "\n".join(line(18) for _ in range(4))
    for i in range(0, 20, 4):
        texts.append(texts[i] + "\n" + passage)  # shares a document's lines and a passage
    texts += [texts[1], texts[2].replace(texts[2].split()[3], "changed", 1), "too short", "", None, "a b\n" * 50]
    for k, (_, it) in enumerate(items):
        texts[20 + k] += "\n" + it
    docs = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["src0", "src0", "src1", "src2"]), len(t or ""))
            for i, t in enumerate(texts)]
    return docs, items


def test_pipeline_equals_plain_python(spark, tmp_path):
    docs, items = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(docs, DOC).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    # without trusted rows every n-gram weighs 0: the rules alone decide
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")

    rows = {i: (t, la, s) for i, t, la, s, _ in docs if not base(t)[-1]}
    lines = line_brute([(i, r[0]) for i, r in rows.items()])
    rows = {i: (lines[i][0], *r[1:]) for i, r in rows.items() if lines[i][2] == 0 or lines[i][2] < lines[i][1]}
    classes = dup_brute([(i, r[0]) for i, r in rows.items()])
    rows = {i: r for i, r in rows.items() if classes[i] == i}
    bad = {i for i, _ in leak_brute([(i, r[0]) for i, r in rows.items()], items)}
    rows = {i: r for i, r in rows.items() if i not in bad}
    assert len(rows) > 30 and len(bad) >= 4

    got = docs_of(spark, sf)
    assert got["decontamination"] == {(i, r[0], r[1], r[2], len(r[0])) for i, r in rows.items()}
    last = corpus_pipeline.run(spark, sf)
    assert last.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_probability"]
    mixed = last.collect()
    for r in mixed:
        u = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:8], 16) / 2 ** 32
        assert r.doc_id in rows and u < r.mix_probability <= 1
    prob = {r.doc_id: r.probability for r in mixing.mix(spark.createDataFrame(sorted(got["decontamination"]), DOC)).collect()}
    assert {r.doc_id for r in mixed} == {i for i, p in prob.items() if int(hashlib.md5(
        f"{mixing.SEED}:{i}".encode()).hexdigest()[:8], 16) / 2 ** 32 < p}


def docs_of(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out[name] = {tuple(r) for r in docs.collect()}
    return out


def test_empty(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], DOC).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
