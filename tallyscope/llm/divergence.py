"""Source divergence audit: how the sources of a language differ in their words.

Terms are runs of ASCII letters and of characters above ASCII, ``A-Z`` lower-cased.  One
``bytes.translate`` lowers letters and blanks separators, ``bytes.split`` cuts the terms and a
``Counter`` of each document gives frequencies; tasks add them up sparsely, by language, source
and term.  A language keeps the terms that at least ``min_docs`` of its documents hold.

Shares are integers: p = 1 + floor(10**9 * (count + 1) / (N + V)), with N the counts of the kept
terms in a group and V their number, and the divergence of a term is floor((p - q)**2 / q).
The kept terms are dealt out in blocks by hash; a block meets the sizes of its language's sources,
fills a dense matrix of terms and sources slice by slice, and gives one sum for each two sources
and its ``top`` terms of each source.  No block grows with the corpus (there are more of them), and
no two sources meet as rows.  The report names all pairs of a language's sources, so its own size
is the square of their number, which therefore has to be moderate.

Defined results: null text, language and source count as ''.  Empty texts add no term, yet their
group is reported; a language without kept terms has pairs of value 0.  Repeated rows and ids count
as documents of their own; further columns play no part.  A very long text is one row of one
Counter.  Ties go to the smaller item in UTF-8 order.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import land

MIN_DOCS = 3
TOP = 200
#: (term, source) counts a task holds before it passes them on.
HELD = 200_000
#: Rows of a block of terms; cells of the dense matrix that is filled at a time.
BLOCK_ROWS = 50_000
CELLS = 1 << 18

#: Letters lowered, bytes above ASCII as they are, anything else a blank.
TABLE = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))

COUNTS = "lang string, source string, term binary, n bigint, docs bigint"
FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()),
                   ("value", pa.int64())])


def tokens(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(TABLE).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[dict[bytes, int], dict[bytes, int]]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang), len(n)), pa.repeat(pa.scalar(source), len(n)), pa.array(n, pa.binary()),
                 pa.array(n.values(), pa.int64()), pa.array((docs[t] for t in n), pa.int64())],
                ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"]):
            own = Counter(tokens(text.as_py()))
            n, docs = held.setdefault((lang, source), ({}, {}))
            size -= len(n)
            for term, c in own.items():
                n[term] = n.get(term, 0) + c
                docs[term] = docs.get(term, 0) + 1
            size += len(n)
            if size > HELD:
                yield from out()
                held, size = {}, 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs that hold it); ``docs`` has lang, source and text without nulls."""
    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_count, COUNTS).groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def per_billion(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """floor(10**9 * part / whole), exact while ``whole`` is below 2**53: long division by thousands."""
    out, rest = part // whole, part % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _block(top: int):
    def run(rows: pa.Table, groups: pa.Table) -> pa.Table:
        if not groups.num_rows:
            return FOUND.empty_table()
        lang, sources = groups["lang"][0].as_py(), groups["source"].to_pylist()
        place = {s: i for i, s in enumerate(sources)}
        whole = (groups["size"].to_numpy() + groups["terms"].to_numpy()).astype(np.int64)
        n_groups = len(sources)
        pairs = np.zeros((n_groups, n_groups), np.int64)
        best: list[list[tuple[int, bytes]]] = [[] for _ in sources]
        if rows.num_rows:
            rows = rows.sort_by("term")
            names = rows["term"].cast(pa.binary()).to_pylist()
            new = np.array([True, *(a != b for a, b in zip(names, names[1:]))])
            term = np.cumsum(new) - 1
            at = np.array([place[s] for s in rows["source"].to_pylist()])
            n, total = rows["n"].to_numpy(), rows["total"].to_numpy()
            p = 1 + per_billion(n + 1, whole[at])
            q = 1 + per_billion(total + 1, groups["lang_size"][0].as_py() + groups["terms"][0].as_py())
            f = divergence(p, q)
            for i in np.flatnonzero(p > q):
                best[at[i]].append((-int(f[i]), names[i]))
            step = max(1, CELLS // n_groups)
            for a in range(0, int(term[-1]) + 1, step):
                lo, hi = np.searchsorted(term, (a, a + step))
                count = np.zeros((int(term[hi - 1]) + 1 - a, n_groups), np.int64)
                count[term[lo:hi] - a, at[lo:hi]] = n[lo:hi]
                share = 1 + per_billion(count + 1, whole)
                for g in range(n_groups):
                    pairs[g] += divergence(share[:, g:g + 1], share).sum(axis=0)
        out: list[tuple[str, str, str, int]] = [
            (sources[a], "pair", sources[b], int(pairs[a, b])) for a in range(n_groups) for b in range(n_groups) if a != b]
        for source, found in zip(sources, best):
            out += [(source, "term", t.decode(), -v) for v, t in heapq.nsmallest(top, found)]
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.Table.from_arrays([pa.array([lang] * len(out), pa.string()), *(
            pa.array(c, kind) for c, kind in zip(cols, FOUND.types[1:]))], schema=FOUND)
    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language with the
    divergence over all kept terms, part ``term`` the ``top`` terms more frequent here than in the language."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    of_term = Window.partitionBy("lang", "term")
    kept = term_counts(docs).withColumns({
        "in_docs": F.sum("docs").over(of_term), "total": F.sum("n").over(of_term),
        "head": (F.min("source").over(of_term) == F.col("source")).cast("bigint")})
    kept = land(kept.where(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "total", "head"), "divergence-terms")
    blocks = kept.count() // block_rows + 1

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("head").alias("heads"))
    of_lang = Window.partitionBy("lang")
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").na.fill(0).withColumns({
        "lang_size": F.sum("size").over(of_lang), "terms": F.sum("heads").over(of_lang)})
    groups = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "lang", "block", "source", "size", "lang_size", "terms")
    rows = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), "source", "term", "n", "total")
    found = rows.groupBy("lang", "block").cogroup(groups.groupBy("lang", "block")).applyInArrow(
        _block(top), "lang string, source string, part string, item string, value bigint")
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
