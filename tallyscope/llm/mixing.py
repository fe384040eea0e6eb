"""Mixing sources to target weights by raking (iterative proportional fitting).

Documents fall into cells (source, language, topic) whose weight is their token count.
The cell weights are scaled in turn so that their sums match the target share of each
source, each language and each topic; after ``ROUNDS`` rounds the ratio of a cell's
raked weight to its own weight, times ``RATE``, is the probability with which its documents are
drawn.  No cell is weighted beyond what taking it whole gives (the ratio 1 / ``RATE``): each step cuts such
cells back, and the following steps rake the others up for what is missing.  So a rare cell is
taken whole and shrinks no other, and the expected token mix is the raked mix as far as the tokens reach.

Built-in functions only.  The documents are read once into a narrow table; the rounds
work on the cells, with aggregates and joins, never on one whole marginal in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import land
from .common import pack, words

DIMS = ("source", "lang", "topic")
ROUNDS = 8
RATE = 0.5
SEED = 17
NONE = "(none)"
#: A number tempers the token shares of the data by that exponent (1 keeps them, 0 is
#: uniform); a dict gives shares, and values it does not name (none among them) share what is
#: left over in proportion to their tokens.
TARGETS = {"source": 0.5, "lang": {"en": 0.38, "de": 0.19, "fr": 0.19, "es": 0.19}, "topic": 0.75}


def topic(text: Column) -> Column:
    """Topic of a text by cue, first that holds: licence wording, long numbers or addresses,
    tables, symbol markup; prose otherwise."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(F.contains(t, F.lit("icense")), "legal")
            .when(t.rlike(r"[0-9]{7}|@"), "personal")
            .when(F.contains(t, F.lit(" | ")), "tabular")
            .when(t.rlike(r"[#$%&*]{3}"), "markup")
            .otherwise("prose"))


def _targets(cells: DataFrame, dim: str, target) -> DataFrame:
    """(dim, target): the target token mass of each value that holds tokens."""
    own = cells.groupBy(dim).agg(F.sum("base").alias("mass")).where("mass > 0")
    total = own.agg(F.sum("mass").alias("total"))
    own = own.join(F.broadcast(total))
    if isinstance(target, dict):
        named = F.create_map(*[x for k, v in target.items() for x in (F.lit(k), F.lit(float(v)))])
        rest = max(0.0, 1.0 - sum(target.values()))
        spare = own.agg(F.sum(F.when(~F.col(dim).isin(list(target)), F.col("mass"))).alias("spare"))
        own = own.join(F.broadcast(spare)).withColumn("share", F.coalesce(
            F.try_element_at(named, F.col(dim)), F.lit(rest) * F.col("mass") / F.col("spare")))
    else:
        own = own.withColumn("share", F.pow(F.col("mass") / F.col("total"), F.lit(float(target))))
    whole = own.agg(F.sum("share").alias("whole"))
    return own.join(F.broadcast(whole)).select(
        dim, (F.col("share") / F.col("whole") * F.col("total")).alias("target"))


def rake(cells: DataFrame, targets: dict = TARGETS, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """Rake cells (dims..., ``base``) to the targets: adds ``weight``, at most ``base / rate``.

    Cells without tokens, and cells whose target share is 0, end at weight 0.
    """
    goals = {d: land(_targets(cells, d, t), f"mix-{d}") for d, t in targets.items()}
    cells = cells.withColumn("weight", F.col("base").cast("double"))
    for _ in range(rounds):
        for d, goal in goals.items():
            now = cells.groupBy(d).agg(F.sum("weight").alias("now")).join(goal, d, "left").select(
                d, F.when(F.col("now") > 0, F.coalesce("target", F.lit(0.0)) / F.col("now"))
                .otherwise(0.0).alias("factor"))
            # a step reads the cells twice (sums, then scaling): landed, or the plan doubles each time
            cells = land(cells.join(now, d).withColumn("weight", F.least(
                F.col("weight") * F.col("factor"), F.col("base") / F.lit(rate))).drop("factor"), "mix-cells")
    return cells


def _dims(df: DataFrame) -> DataFrame:
    """Columns source, lang, topic, n_tokens of a packed frame; null values are a group of their own."""
    return df.select("row", F.coalesce(F.col("row.source"), F.lit(NONE)).alias("source"),
                     F.coalesce(F.col("row.lang"), F.lit(NONE)).alias("lang"),
                     topic(F.col("row.text")).alias("topic"),
                     F.size(words(F.col("row.text"))).cast("bigint").alias("n_tokens"))


def probabilities(feats: DataFrame, targets: dict = TARGETS, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """(source, lang, topic, ratio, probability) of every cell of ``feats``."""
    cells = land(feats.groupBy(*DIMS).agg(F.sum("n_tokens").alias("base")), "mix-base")
    raked = rake(cells, targets, rounds, rate).withColumn(
        "ratio", F.when(F.col("base") > 0, F.col("weight") / F.col("base")).otherwise(0.0))
    return raked.select(*DIMS, "ratio", (F.col("ratio") * F.lit(rate)).alias("probability"))


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """Uniform number in [0, 1) from the document id (null as empty) and the seed."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def mix(docs: DataFrame, targets: dict = TARGETS, rounds: int = ROUNDS, rate: float = RATE,
        seed: int = SEED) -> DataFrame:
    """Every input row as (doc_id, source, lang, topic, n_tokens, ratio, probability, selected).

    Null source or language is the value ``(none)``; documents without a word are never
    drawn; equal ids draw the same number, so repeated rows are taken or left together.  An
    empty table gives an empty result.
    """
    feats = land(_dims(pack(docs)).select(F.col("row.doc_id").alias("doc_id"), *DIMS, "n_tokens"), "mix-docs")
    prob = land(probabilities(feats, targets, rounds, rate), "mix-prob")
    # the cell table is a small landed file: Spark broadcasts it under its threshold and
    # otherwise joins by shuffle, where adaptive execution splits a hot cell
    return feats.join(prob, list(DIMS)).select(
        "doc_id", *DIMS, "n_tokens", "ratio", "probability",
        ((F.col("n_tokens") > 0) & (draw(F.col("doc_id"), seed) < F.col("probability"))).alias("selected"))


def sample(docs: DataFrame, targets: dict = TARGETS, rounds: int = ROUNDS, rate: float = RATE,
           seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns and ``mix_probability`` (which replaces a
    column of that name); rules as in ``mix``."""
    df = _dims(pack(docs))
    feats = land(df.drop("row"), "mix-feats")
    prob = land(probabilities(feats, targets, rounds, rate), "mix-prob")
    df = df.join(prob, list(DIMS)).where(
        (F.col("n_tokens") > 0) & (draw(F.col("row.doc_id"), seed) < F.col("probability")))
    keep = [F.col(f"row.`{c}`") for c in docs.columns if c != "mix_probability"]
    return df.select(*keep, F.col("probability").alias("mix_probability"))
