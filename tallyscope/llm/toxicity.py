"""Toxicity scores after noisy-channel deobfuscation.

Obfuscated words (leetspeak, stretched letters, letters set apart) become character lattices:
every written character offers the letters it may stand for, a doubled letter or a stretched
run one or two copies, a separator nothing.  A run of letters set apart by blanks is read from
each of its letters on, as its neighbours of one letter are not told from it.  Viterbi decoding under a character trigram model, counted over
the whole corpus, picks the likeliest letters.  The restored words of a text (and their
beginnings) are scored by a lexicon of word evidence learned from labelled rows.

Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1, and from at
most ``LABELLED_ROWS`` of them (those of the smallest hash of their id).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import land
from . import textcodes as tc

LABELLED_ROWS = 20_000
LEXICON = 50_000
THRESHOLD = 0.7
#: Weight, in rows, of the base rate as the prior of a feature's evidence.
PRIOR = 10.0
MIN_ROWS = 3
PREFIXES = (5,)
#: Further words whose evidence is added to the strongest one's.
MORE = 5
#: Feature counts held by a task before they are passed on.
HELD = 200_000

#: What a written character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
#: Log-probabilities of the channel: writing a letter as another character, dropping a mark,
#: doubling a letter.
SWAP, MARK, DOUBLED = -1.0, -0.5, -1.0
#: Letters of a spaced run that are read from one start, beside the whole run.
SPACED = 24
LETTERS = 28  # blank, a to z, any other
_FOLD = np.full(256, 27, np.int64)
_FOLD[[0x20, *range(0x09, 0x0E)]] = 0
_FOLD[ord("a"):ord("z") + 1] = _FOLD[ord("A"):ord("Z") + 1] = np.arange(1, 27)
_SPACED = re.compile(r"(?<!\S)[\"'(\[{<*_~`]*(\S(?:[ \t]+\S){2,})[^\w\s]*(?!\S)")
_RUN = re.compile(r"(.)\1", re.DOTALL)
_PIECE = re.compile(r"[^\W\d_]+")
_END = "!$+|"
_EDGE = ".,;:?\"'()[]{}<>#%&*-_~`^=/\\"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS ** 3, np.int64)
    for batch in batches:
        for _, _, data, offs in tc.chunks(batch["t"]):
            c = _FOLD[data]
            code = c[:-2] * LETTERS ** 2 + c[1:-1] * LETTERS + c[2:]
            whole = np.ones(len(code), bool)  # no trigram across two texts
            for back in (1, 2):
                edge = offs[1:-1] - back
                whole[edge[(edge >= 0) & (edge < len(code))]] = False
            total += np.bincount(code[whole], minlength=LETTERS ** 3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])


def char_model(docs: DataFrame) -> np.ndarray:
    """Log P(third | first two) over folded characters, counted over all texts: 28 cubed numbers."""
    counts = docs.select(F.col("text").alias("t")).mapInArrow(_count, "code bigint, n bigint")
    n = np.zeros(LETTERS ** 3)
    for r in counts.groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most 28 cubed rows
        n[r.code] = r.n
    n = n.reshape(LETTERS, LETTERS, LETTERS) + 0.5
    return np.log(n / n.sum(axis=2, keepdims=True))


class Restorer:
    """Decodes words under a character model; remembers what it has decoded."""

    def __init__(self, model: np.ndarray) -> None:
        self.model, self.seen = model.tolist(), {}

    @staticmethod
    def _code(ch: str) -> int:
        return ord(ch) - 96 if "a" <= ch <= "z" else 27

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """Slots of (letters, log-probability): a run of one character is one slot."""
        out, i = [], 0
        while i < len(word):
            j = i
            while j < len(word) and word[j] == word[i]:
                j += 1
            ch = word[i]
            if ch.isalpha():
                bare = [(ch, 0.0)]
            elif ch in LEET:
                bare = [(x, SWAP) for x in LEET[ch]]
            else:
                bare = []
            slot = [(x, p) for x, p in bare]
            if j - i == 2 and ch.isalpha():
                slot = [(ch * 2, 0.0), (ch, DOUBLED)]
            elif j - i >= 2:
                slot += [(x * 2, p) for x, p in bare]
            if not ch.isalpha():
                slot.append(("", MARK if not bare else 3 * SWAP))
            out.append(slot)
            i = j
        return out

    def decode(self, word: str) -> str:
        if not _RUN.search(word) and LEET.keys().isdisjoint(word):  # the lattice has one path
            return "".join(filter(str.isalpha, word))
        got = self.seen.get(word)
        if got is None:
            best = {(0, 0): (0.0, "")}
            for slot in self.lattice(word):
                nxt: dict[tuple[int, int], tuple[float, str]] = {}
                for (a, b), (p, text) in best.items():
                    for letters, q in slot:
                        x, y, s = a, b, p + q
                        for ch in letters:
                            c = self._code(ch)
                            s += self.model[x][y][c]
                            x, y = y, c
                        if (x, y) not in nxt or nxt[x, y][0] < s:
                            nxt[x, y] = (s, text + letters)
                best = nxt
            got = max((p + self.model[a][b][0], t) for (a, b), (p, t) in best.items())[1]
            if len(self.seen) >= HELD:
                self.seen.clear()
            self.seen[word] = got
        return got

    def words(self, text: str | None) -> set[str]:
        """The restored lower-case words of a whole text."""
        low = (text or "").lower()
        out = set()
        for m in _SPACED.finditer(low):
            run = "".join(m[1].split())
            for whole in {run, run.rstrip(_EDGE + _END)}:
                out.add(self.decode(whole))
                out.update(self.decode(whole[i:i + SPACED]) for i in range(len(whole) - 2))
        for w in set(low.split()):
            if not w.isalpha():
                w = w.strip(_EDGE)
                bare = w.rstrip(_END)  # as a rule these end a word and stand for no letter
                if not bare.isalpha():
                    if any(c.isalpha() for c in w):
                        out.add(self.decode(w))
                        out.add(self.decode(bare))
                        out.update(_PIECE.findall(w))
                    continue
                w = bare
            if _RUN.search(w):
                out.add(self.decode(w))
            out.add(w)
        out.discard("")
        return out

    def features(self, text: str | None) -> list[list[str]]:
        """For each restored word, the word marked by $ and its beginnings marked by ^."""
        return [[w + "$", *["^" + w[:n] for n in PREFIXES if len(w) >= n]] for w in self.words(text)]


def combined(evidence: list[float], base: float) -> float:
    """Score from the evidence of a text's words: the strongest, plus what the next ``MORE - 1``
    add beyond even odds; a fifth of the base rate without any."""
    if not evidence:
        return base / 5
    top = sorted(evidence, reverse=True)[:MORE]
    odds = top[0] / (1 - top[0])
    for p in top[1:]:
        odds *= max(1.0, p / (1 - p))
    return odds / (1 + odds)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> DataFrame:
    """(t, y): texts with labels to learn from; ids labelled both ways or not at all are left out."""
    ids = (labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("z")).where("y = z")
           .select(F.col("doc_id").alias("id"), "y").orderBy(F.xxhash64("id"), "id").limit(limit))
    # at most ``limit`` rows of two numbers
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).join(F.broadcast(ids), "id").select("t", "y")


def lexicon(rows: DataFrame, model: np.ndarray, size: int = LEXICON) -> tuple[dict[str, float], float]:
    """(feature -> probability of label 1, base rate): features that speak for label 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, counts = Restorer(model), (Counter(), Counter())

        def out():
            fs = list({**counts[0], **counts[1]})
            return pa.RecordBatch.from_arrays([pa.array(fs, pa.string()), pa.array([counts[1][f] for f in fs], pa.int64()),
                                               pa.array([counts[0][f] for f in fs], pa.int64())], ["f", "n1", "n0"])

        for batch in batches:
            for t, y in zip(batch["t"], batch["y"].to_pylist()):
                fs = {f for word in restorer.features(t.as_py()) for f in word}
                fs.add("")  # counts the rows themselves
                counts[1 if y else 0].update(fs)
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield out()
                    counts = Counter(), Counter()
        yield out()

    sums = rows.mapInArrow(run, "f string, n1 bigint, n0 bigint").groupBy("f").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    sums = land(sums, "tox-features")
    all_rows = sums.where("f = ''").first()
    n1, n0 = (all_rows.n1, all_rows.n0) if all_rows else (0, 0)
    base = (n1 + 0.1) / (n1 + n0 + 1.0)
    p = (F.col("n1") + PRIOR * base) / (F.col("n1") + F.col("n0") + PRIOR)
    top = sums.where(f"f <> '' and n1 >= {MIN_ROWS}").select("f", p.alias("p")).where(F.col("p") >= 2 * base).orderBy(
        F.desc("p"), "f").limit(size)
    return {r.f: r.p for r in top.collect()}, base


def score(docs: DataFrame, model: np.ndarray, evidence: dict[str, float], base: float) -> DataFrame:
    """(doc_id, held_out, score, predicted, words) for every row of ``docs``.

    The score combines the strongest evidence among a text's words.  Null and empty texts have none.  Equal texts get equal scores, ids decide
    only ``held_out`` (null: false); empty tables give an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, evidence))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, known = shared.value
        restorer = Restorer(chars)
        for batch in batches:
            scores, hits = [], []
            for t in batch["t"]:
                got = []
                for word in restorer.features(t.as_py()):
                    own = [(known[f], f) for f in word if f in known]
                    if own:
                        got.append(max(own))
                got.sort(reverse=True)
                scores.append(combined([p for p, _ in got], base))
                hits.append(" ".join(f for _, f in got[:3]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held"], pa.array(scores, pa.float64()),
                                              pa.array(hits, pa.string())], ["doc_id", "held_out", "score", "evidence"])

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held"),
                      F.col("text").alias("t"))
    out = src.mapInArrow(run, "doc_id bigint, held_out boolean, score double, evidence string")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Count the character model over ``docs``, learn from ``labels``, score every document."""
    model = char_model(docs)
    return score(docs, model, *lexicon(training_rows(docs, labels), model))
