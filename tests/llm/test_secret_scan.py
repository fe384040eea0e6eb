"""Secret scan: trigram queries, spans against Python's re, postings as a superset."""

import hashlib
import random
import re

from tallyscope.llm import secret_scan as ss

DOC = "doc_id long, text string"


def spans(t):
    out = []
    for order, r in enumerate(ss.RULES):
        for m in re.finditer(r.pattern, t or "", re.ASCII):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), order, m.end(), r.kind))
    return sorted(out)


def texts():
    rnd = random.Random(6)
    parts = ["password=", "PassWord: '", "api_key = \"", "apikey:", "tok", "token", "=", ": ", "AKIA", "ABCDEFGHIJKLMNOP",
             "0123456789abcdef" * 2, "deadbeef", "é", "ſecret=longenough1", "\U0001F600", " ", "\n", "secret : ",
             "ghp_" + "a1B2" * 10, "xoxb-12345-abcdefghijkl", "-----BEGIN RSA PRIVATE KEY-----", "short",
             "eyJhbGciOi.eyJzdWIiOi.abcdefghijklmnopqrstuvwxyz", "AIza" + "x" * 40, "longvalue_not", "passwd=secret=abcdefgh"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    return out + ["x " * 50000 + "password=abcdefgh1", "", "token='abc' token='abcdefgh'"]


def test_trigram_queries():
    q = {r.kind: ss.trigram_query(r.pattern) for r in ss.RULES}
    assert q["hex"] == []  # scans every document
    assert q["access"] == [[frozenset({"aki", "kia"})]]
    assert frozenset({"tok", "oke", "ken"}) in q["assign"][0] and len(q["assign"][0]) == 6
    assert ss.trigram_query("ab") == [] and ss.trigram_query("abc|xy") == []
    assert ss.trigram_query("(?:abc)?defg") == [[frozenset({"def", "efg"})]]
    # every match satisfies the query of its rule
    for t in texts():
        for s in spans(t):
            low = t[s[0]:s[2]].lower()
            assert all(any(all(g in low for g in alt) for alt in clause) for clause in q[s[3]])


def test_spans_equal_python_re(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "token=abcdefgh"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS kinds", "2 AS key", "3 AS spans")
    got = ss.secret_digest(ss.secret_scan(df))
    want = []
    for i, t in rows:
        sp = spans(t)
        def show(xs):
            return ",".join(f"{k}:{a}:{b}" for a, _, b, k in xs)
        n = [sum(s[3] == r.kind for s in sp) for r in ss.BASE]
        want.append((i, *n, hashlib.sha256(show([s for s in sp if s[1] < 3]).encode()).hexdigest(), show(sp)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert ss.secret_scan(spark.createDataFrame([], DOC)).count() == 0
