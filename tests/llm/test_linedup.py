"""Line dedup against a plain-Python version."""

import random

from tallyscope.llm import linedup

BLANK = " \t\n\x0b\x0c\r"


def brute(rows):
    """doc id -> (new text, lines with a word, lines removed); ids are unique here."""
    seen, gone, full = set(), {}, {}
    for i, t in sorted(rows):
        body = [(k, x.strip(BLANK)) for k, x in enumerate((t or "").split("\n")) if x.strip(BLANK)]
        full[i], gone[i] = body, set()
        for k in range(len(body) - 2):
            w = tuple(x for _, x in body[k:k + 3])
            if w in seen:
                gone[i].update(n for n, _ in body[k:k + 3])
            seen.add(w)
    return {i: (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]),
                len(full[i]), len(gone[i])) for i, t in rows}


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS th", "2 AS covered", "3 AS new_text")
    return linedup.line_dedup(df.repartition(3)).collect()


def test_equals_plain_python(spark):
    rnd = random.Random(1)
    pool = [f"line {k} x" for k in range(25)] + ["", " \t", " line 3 x "]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "a\nb"), (103, "a\na\na\na\na\n\n"), (104, "\n\n\n"),
             (105, "\n".join(f"row {k}" for k in range(5000)) * 2)]
    got = {r.row.doc_id: (r.new_text, r.n_lines, r.n_removed) for r in run(spark, rows)}
    assert got == brute(rows)
    assert sum(v[2] for v in got.values()) > 100


def test_ties_repeats_and_null_ids(spark):
    t = "a\nb\nc\nd"
    rows = [(None, t), (1, t), (1, t), (1, "x\na\nb\nc"), (2, t)]
    got = run(spark, rows)
    assert len(got) == 5
    # null ids come first and keep the lines; the others lose them
    assert {(r.row.doc_id, r.row.text): r.new_text for r in got} == {
        (None, t): t, (1, t): "", (2, t): "", (1, "x\na\nb\nc"): "x"}
    assert run(spark, []) == []
    twins = run(spark, [(5, t), (5, t)])
    assert [r.new_text for r in twins] == [t, t]
