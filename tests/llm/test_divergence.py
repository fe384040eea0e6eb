"""Source divergence: plain Python over whole tables, block sizes, exactness and edges."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyscope.llm import divergence, queries
from tests.conftest import SF

DOC = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs=3, top=200):
    """rows: (text, lang, source).  Contract of the audit, with unbounded integers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    held, count = Counter(), Counter()
    for text, lang, source in rows:
        words = TERM.findall(low(text))
        held.update((lang, t) for t in set(words))
        count.update((lang, source, t) for t in words)
    out = set()
    for lang in {r[1] for r in rows}:
        terms = [t for (g, t), n in held.items() if g == lang and n >= min_docs]
        sources = sorted({r[2] for r in rows if r[1] == lang})
        v = len(terms)

        def shares(counts):
            n = sum(counts.values())
            return {t: 1 + 10 ** 9 * (counts[t] + 1) // (n + v) for t in terms}

        own = {s: {t: count[lang, s, t] for t in terms} for s in sources}
        p = {s: shares(own[s]) for s in sources}
        q = shares({t: sum(own[s][t] for s in sources) for t in terms})

        def f(a, b):
            return (a - b) * (a - b) // b

        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in terms), o) for o in sources if o != s]
            known = [(f(p[s][t], q[t]), t) for t in terms if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", known, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])}
    return out


def rows_of(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_whole_table_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.text, r.lang, r.source) for r in docs.collect()])
    df = queries.op12_source_divergence(spark, SF)
    assert rows_of(df) == want
    assert dict(df.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


@pytest.mark.parametrize("seed", [0, 1])
def test_any_block_size_gives_the_same(spark, seed, monkeypatch):
    rng = random.Random(seed)
    words = ["Aa", "b", "éÉ", "日本", "ſ", "K", "zz", "q'r", "İ", "x1y"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "de"]), rng.choice("stu")) for _ in range(40)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOC)
    want = brute(rows, top=3)
    monkeypatch.setattr(divergence, "CELLS", 4)
    assert rows_of(divergence.audit(docs, top=3, block_rows=5)) == want
    monkeypatch.setattr(divergence, "HELD", 3)
    assert rows_of(divergence.audit(docs.repartition(3), top=3)) == want


def test_tokens():
    text = "Ab_c Éé-d9E\x7ff\x00G“h”　iİ"
    assert [t.decode() for t in divergence.tokens(text.encode())] == TERM.findall(low(text))


def test_shares_are_exact_for_large_counts():
    rng = random.Random(5)
    whole = [rng.randrange(1, 1 << 53) for _ in range(500)]
    part = [rng.randrange(0, w + 1) for w in whole]
    got = divergence.per_billion(np.array(part), np.array(whole))
    assert got.tolist() == [10 ** 9 * a // b for a, b in zip(part, whole)]


def test_edges(spark):
    rows = [("wa wo", "en", "s"), ("wa", "en", "s"), ("wa wo", "en", "t"), (None, "en", "empty"), ("", None, None),
            ("solo", "fr", "a"), ("solo", "fr", "b"), ("wa " * 100_000, "en", "s"), ("wa " * 100_000, "en", "s"),
            ("wo wa wi wi wi", None, "s"), ("wi", "", "s"), ("wi", None, None), ("wi", "de", "only"), ("wi", "de", "only"),
            ("wi", "de", "only"), ("1234 .,", "en", None)]
    docs = spark.createDataFrame([(None, *r, 7, "c") for r in rows], DOC + ", term long, docs string")
    assert rows_of(divergence.audit(docs)) == brute(rows)
    assert ("fr", "a", "pair", "b", 0, 1) in brute(rows)  # a language without kept terms
    assert divergence.audit(docs.limit(0)).collect() == []


def test_ties_by_bytes(spark):
    rows = [("z é \U00010000 ￿ a", "en", "s")] * 3 + [("b", "en", s) for s in ("t", "u", "é", "Z")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOC)
    got = divergence.audit(docs).where("source = 's' and part = 'term'").orderBy("rank").collect()
    assert [r.item for r in got] == ["a", "z", "é", "￿", "\U00010000"]
    assert rows_of(divergence.audit(docs)) == brute(rows)
