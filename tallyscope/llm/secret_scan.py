"""Secret scans over a trigram inverted index.

Each rule's regular expression yields a Boolean trigram query: an AND of clauses, each an
OR of alternatives, each a set of trigrams that must all be present.  The index holds, for
every trigram that some query needs, the postings (trigram, document).  Intersecting the
postings gives candidate documents per rule; only these are searched with the expression.
A rule without a mandatory trigram (a pure character-class run) scans every document.

Index, intersection and search are built-in functions.  The index folds case, so its
answers are a superset for case-sensitive rules; the search decides.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import land
from .common import pack


@dataclass(frozen=True)
class Rule:
    """``group``/``least``: matches whose group is shorter than ``least`` characters are dropped."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, fixed by the contract, in their order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: The method's further rules; their spans come after the base kinds.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
RULES = BASE + EXTRA
#: Alternatives that one clause may spell out before it is cut and a new one begins.
MAX_STRINGS = 64

Query = list[list[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """AND of ORs of trigram sets that any match of ``pattern`` must contain, in lower case.

    An empty list means that no trigram is mandatory.
    """
    clauses: Query = []

    def flush(strings: list[str]) -> list[str]:
        sets = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings]
        if all(sets):  # an alternative shorter than three characters demands nothing
            least = [x for x in set(sets) if not any(y < x for y in sets)]  # the others imply one of these
            clauses.append(sorted(least, key=sorted))
        return [""]

    def spelled(item) -> list[str] | None:
        """Every string that an item can match, if they are few."""
        op, arg = item
        if op is sre.LITERAL:
            return [chr(arg).lower()]
        if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            return sorted({chr(a).lower() for _, a in arg})
        if op is sre.SUBPATTERN:
            return joined(arg[3])
        if op is sre.BRANCH:
            parts = [joined(x) for x in arg[1]]
            return None if None in parts else sorted({s for p in parts for s in p})
        if op is sre.MAX_REPEAT and arg[1] <= 2:
            one = joined(arg[2])
            return one and sorted({"".join(t) for n in range(arg[0], arg[1] + 1) for t in product(one, repeat=n)})
        return None

    def joined(items) -> list[str] | None:
        out = [""]
        for item in items:
            own = spelled(item)
            if own is None or len(own) * len(out) > MAX_STRINGS:
                return None
            out = [a + b for a in out for b in own]
        return out

    def walk(items, strings: list[str]) -> list[str]:
        for item in items:
            own = spelled(item)
            if own is not None and len(own) * len(strings) <= MAX_STRINGS:
                strings = [a + b for a in strings for b in own]
                continue
            strings = flush(strings)
            op, arg = item
            if own is not None and len(own) <= MAX_STRINGS:
                strings = own
            elif op is sre.SUBPATTERN:
                strings = walk(arg[3], strings)
            elif op is sre.MAX_REPEAT and arg[0] >= 1:  # at least one copy is there
                strings = flush(walk(arg[2], strings))
        return strings

    flush(walk(sre.parse(pattern), [""]))
    return clauses


def vocabulary(rules=RULES) -> list[str]:
    """The trigrams that the rules' queries need: a fixed list, however large the corpus."""
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for alt in clause for t in alt})


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """The inverted index: (trigram, key) for the trigrams of the vocabulary.

    ``key`` hashes id and text; documents that share it share candidates, which costs at
    most a needless search.
    """
    df = docs.select(_key().alias("key"), F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    hits = F.array(*[F.when(F.contains("t", F.lit(g)), F.lit(g)) for g in vocabulary(rules)])
    return df.select("key", F.explode(F.array_compact(hits)).alias("trigram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(key, kinds): the rules whose query the postings of a document satisfy."""
    df = index.groupBy("key").agg(F.collect_set("trigram").alias("g"))  # bounded by the vocabulary

    def holds(query: Query) -> Column:
        def every(alt):
            return F.size(F.array_intersect("g", F.array(*[F.lit(t) for t in sorted(alt)]))) == len(alt)
        return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [every(s) for s in c]) for c in query])

    kinds = [F.when(holds(q), F.lit(r.kind)) for r in rules if (q := trigram_query(r.pattern))]
    return df.select("key", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches of a rule, long enough, with code-point offsets: the
    pieces between the matches give the positions."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"),
                         F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(a, m):
        start = a["at"] + F.length(m["gap"])
        end = start + F.coalesce(F.length(m["all"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(m["part"]) >= rule.least, F.concat(
            a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.aggregate(found, zero, step, lambda a: a["out"])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """Every input row as struct ``row`` with ``spans``, an array of (start, ord, end, kind).

    Null text counts as empty and has no span.  Offsets are code points, the end exclusive.
    Equal rows get equal results; an empty table gives an empty result; texts of any length
    are searched whole.
    """
    index = land(postings(docs, rules), "secret-postings")
    cand = candidates(index, rules)
    df = pack(docs).withColumn("key", F.xxhash64("row.doc_id", "row.text"))
    df = df.join(cand, "key", "left").withColumn("_t", F.coalesce(F.col("row.text"), F.lit("")))
    parts = []
    for order, rule in enumerate(rules):
        search = _spans(F.col("_t"), rule, order)
        # a run of n class characters is looked for before its positions are worked out
        needed = F.array_contains("kinds", rule.kind) if trigram_query(rule.pattern) else F.col("_t").rlike(
            rule.pattern.replace("+", "{%d}" % max(rule.least, 1)) if rule.pattern.endswith("]+") else rule.pattern)
        parts.append(F.when(F.coalesce(needed, F.lit(False)), search).otherwise(F.array().cast(SPANS)))
    return df.select("row", F.concat(*parts).alias("spans"))


def secret_digest(scanned: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE]
    return scanned.select(F.col("row.doc_id").alias("doc_id"), *counts,
                          F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
