"""License scans: alignment against exact subsequences, brute-force regions, edges."""

import itertools
import random

from tallyscope.llm import licenses as li

MIT, GPL = li.TEMPLATES["MIT"], li.TEMPLATES["GPL-3.0-notice"]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_a_common_subsequence():
    rnd = random.Random(0)
    for _ in range(300):
        a = [rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 14))]
        b = [rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 14))]
        got = li.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        assert len(got) <= lcs(a, b)
        assert len(li._common(a, b)) == lcs(a, b)
        assert li.align(a, a) == [(i, i) for i in range(len(a))]


def test_finds_whole_edited_and_repeated():
    s = li.Scanner()
    filler = " ".join(f"w{i} the of" for i in range(300))
    assert [m[0] for m in s.scan(f"{filler}\n{MIT}\n{filler}")] == ["MIT"]
    words = MIT.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 9)  # one word in nine lost
    got = s.scan(filler + " " + edited)
    assert [m[0] for m in got] == ["MIT"] and 0.8 <= got[0][1] < 1
    assert s.scan(" ".join(w for i, w in enumerate(words) if i % 3)) == []
    twice = s.scan(f"{GPL} {filler} {GPL.upper()} {GPL}")
    assert [(m[0], m[1]) for m in twice] == [("GPL-3.0-notice", 1.0)] * 3
    assert s.scan("licensed " * 5000) == []


def test_prefilter_loses_nothing():
    rnd = random.Random(3)
    s, names = li.Scanner(), list(li.TEMPLATES)
    for _ in range(150):
        k = rnd.choice(names)
        t = li.tokens(li.TEMPLATES[k])
        drop = set(rnd.sample(range(len(t)), rnd.randint(0, len(t) // 4)))
        part = [w for i, w in enumerate(t) if i not in drop]
        text = " ".join(["foo"] * 30 + part + ["bar"] * 30)
        if len(part) >= li.COVERAGE * len(t):
            assert k in {m[0] for m in s.scan(text)}


def test_edges(spark):
    kind = "doc_id long, text string, found int"
    assert li.license_scan(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, MIT, 1), (1, None, 2), (1, "", 3), (2, MIT, 4), (2, MIT, 4), (3, "x " * 100000 + GPL, 5)]
    got = {(r.doc_id, tuple(m.license for m in r.found)) for r in li.license_scan(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(None, ("MIT",)), (1, ()), (2, ("MIT",)), (3, ("GPL-3.0-notice",))}
