"""Exact order statistics per group by repeated narrowing, without holding a group in one task.

``percentile`` and ``percentile_disc`` keep a value->count map per group and merge it in one task,
which does not hold for a hot group of a third of 100 TB.  Here every requested rank is enclosed in a
bracket that each round cuts into slots by an order-preserving function of the value:

1. the first round needs no knowledge of the data: 64 slots for each factor of two, on either side of
   zero.  One map-side combined aggregate gives count, smallest and largest value of every non-empty
   slot; running counts over a group's slots tell which slot holds which rank;
2. a slot of more than ``LEAF_ROWS`` rows and more than one value is cut again, linearly between its
   smallest and largest value, into ``SLOTS`` slots, by one more aggregate over its rows.  Its range
   shrinks at least by that factor each time, so five rounds end for any doubles;
3. what remains are slots of a single value, which is the answer, and slots of at most ``LEAF_ROWS``
   rows, which a window picks from.

Where no group has more than ``LEAF_ROWS`` rows, one window over each group gives all ranks at once.

Counts are exact in every round, so nothing is ever redone.  A window reads at most the non-empty slots
of one bracket (271,075 in the first round, ``SLOTS`` later) or ``LEAF_ROWS`` values.  Brackets of groups
(one row for a group and rank) are landed and the driver reads two flags a round; without groups there
is one bracket a rank, which comes to the driver and returns as literals that reach the scan's filter.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import land
from .common import attach

RankFn = Callable[[Column], Column]

SLOTS = 4096
LEAF_ROWS = 1 << 16
#: Brackets up to which the bounds of all groups are broadcast to the rows.
BROADCAST_BRACKETS = 50_000

# slots of the first round: log2 of a double lies in [-1074, 1024]
_COARSE = ("CAST(CASE WHEN isnan(_v) THEN 135537 WHEN abs(_v) = double('inf') THEN signum(_v) * 135536.0D "
           "WHEN _v = 0 THEN 0 ELSE signum(_v) * (floor(log2(abs(_v)) * 64) + 69999) END AS INT)")


def fn_sql(fn) -> str:
    """Rank functions are SQL text over the group count ``n`` (or a callable returning it)."""
    return fn if isinstance(fn, str) else fn("n")


def disc(name: str, q: float) -> tuple[str, float, str]:
    """Element ``sorted[floor(n*q)]`` (0-based)."""
    return (name, q, f"floor(n * {q!r}D)")


def rank_spec(name: str, q: float, fn: str) -> tuple[str, float, str]:
    """A rank given as SQL text over the group count ``n`` (0-based)."""
    return (name, q, fn)


def linear(name: str, p: float) -> list[tuple[str, float, str]]:
    """Both neighbours of position ``p*(n-1)`` for linear interpolation."""
    return [(f"{name}__lo", p, f"floor({p!r}D * (n - 1))"),
            (f"{name}__hi", p, f"ceil({p!r}D * (n - 1))")]


def interpolate(name: str, p: float, n: str = "n") -> Column:
    return F.expr(interpolate_sql(name, p, n))


def interpolate_sql(name: str, p: float, n: str = "n") -> str:
    pos = f"({p!r}D * ({n} - 1))"
    return f"({name}__lo + ({name}__hi - {name}__lo) * ({pos} - floor({pos})))"


def _running(slots: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``_cum``, the running count of ``_c``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return slots.withColumn("_cum", F.sum("_c").over(w))


_HOLDS = "_r >= _cum - _c AND _r < _cum"
_BRACKET = ["_spec", "_id", "_r - (_cum - _c) AS _r", "_c", "_lo", "_hi"]


def _numbered(found: DataFrame, keys: list[str]) -> DataFrame:
    """Brackets shared by several ranks carry the number of the first of them as ``_id``."""
    return found.withColumn("_id", F.min("_spec").over(Window.partitionBy(*keys)))


def _first_round(base: DataFrame, by: list[str], ranks: list[str]) -> DataFrame:
    slots = base.groupBy(*by, F.expr(_COARSE).alias("_slot")).agg(
        F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    slots = _running(slots, by, "_slot").withColumn("n", F.sum("_c").over(Window.partitionBy(*by)))
    wanted = ", ".join(f"named_struct('i', {i}, 'r', least(greatest(CAST({r} AS BIGINT), 0L), n - 1))"
                       for i, r in enumerate(ranks))
    found = slots.selectExpr("*", f"explode(array({wanted})) AS _w").selectExpr("*", "_w.i AS _spec", "_w.r AS _r")
    return _numbered(found.where(_HOLDS), by + ["_slot"]).selectExpr(*by, *_BRACKET)


class _Brackets:
    """Brackets of one round: landed for groups, literals for the one group there is without keys."""

    def __init__(self, found: DataFrame, by: list[str], k: int, leaf_rows: int) -> None:
        self.by, self.k = by, k
        kind = f"CASE WHEN _lo <=> _hi THEN 'value' WHEN _c > {leaf_rows} THEN 'more' ELSE 'leaf' END AS _kind"
        found = found.selectExpr("*", kind)
        if by:
            self.rows = land(found, "order-brackets")
            counts = {r._kind: r.n for r in self.rows.groupBy("_kind").agg(F.count("*").alias("n")).collect()}  # three kinds
            self.kinds, self.few = set(counts), sum(counts.values()) <= BROADCAST_BRACKETS
        else:
            self.known = found.collect()  # at most ``k`` rows
            self.kinds = {r._kind for r in self.known}
            values = ", ".join(f"({r._spec}, {r._id}, {r._r}L, {r._c}L, {_literal(r._lo)}, {_literal(r._hi)}, '{r._kind}')"
                               for r in self.known)
            self.rows = found.sparkSession.sql("SELECT * FROM VALUES " + (values or "(0, 0, 0L, 0L, 0D, 0D, 'none')")
                                               + " AS t(_spec, _id, _r, _c, _lo, _hi, _kind)")

    def of(self, kind: str) -> DataFrame:
        return self.rows.where(F.col("_kind") == kind).drop("_kind")

    def inside(self, base: DataFrame, kind: str) -> DataFrame:
        """Rows of ``base`` that lie in a bracket of this kind, with its ``_id``, ``_lo`` and ``_hi``."""
        if self.by:
            mine = [F.expr(f"max(CASE WHEN _spec = {i} AND _id = {i} THEN {c} END)").alias(f"{c}{i}")
                    for i in range(self.k) for c in ("_lo", "_hi")]
            wide = self.of(kind).groupBy(*self.by).agg(*mine)
            base = attach(base, F.broadcast(wide) if self.few else wide, self.by, "inner")
            bounds = {i: (f"_lo{i}", f"_hi{i}") for i in range(self.k)}
        else:
            bounds = {r._id: (_literal(r._lo), _literal(r._hi)) for r in self.known if r._kind == kind}

        def pick(what: Callable[[int], str]) -> str:
            return "CASE " + " ".join(f"WHEN _v BETWEEN {lo} AND {hi} THEN {what(i)}" for i, (lo, hi) in bounds.items()) + " END"

        return base.where(" OR ".join(f"_v BETWEEN {lo} AND {hi}" for lo, hi in bounds.values())).selectExpr(
            *self.by, "_v", f"{pick(str)} AS _id", f"{pick(lambda i: bounds[i][0])} AS _lo", f"{pick(lambda i: bounds[i][1])} AS _hi")


def _literal(x: float) -> str:
    return f"double('{x!r}')"


def _next_round(rows: DataFrame, brackets: DataFrame, by: list[str], slots_n: int) -> DataFrame:
    cut = f"CAST(least(floor((_v - _lo) / (_hi - _lo) * {slots_n}), {slots_n - 1}) AS INT)"
    slots = rows.groupBy(*by, "_id", F.expr(cut).alias("_slot")).agg(
        F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    found = attach(_running(slots, by + ["_id"], "_slot"), brackets.select(*by, "_id", "_spec", "_r"), by + ["_id"], "inner")
    return _numbered(found.where(_HOLDS), by + ["_id", "_slot"]).selectExpr(*by, *_BRACKET)


def _of_small(base: DataFrame, by: list[str], specs: list[tuple[str, float, RankFn]]) -> DataFrame:
    """The values at all ranks where no group has more than a leaf's rows: one window over each group."""
    each = Window.partitionBy(*by)
    rows = base.select(*by, "_v", (F.row_number().over(each.orderBy("_v")) - 1).alias("_at"), F.count("*").over(each).alias("n"))
    return rows.groupBy(*by).agg(*[
        F.expr(f"max(CASE WHEN _at = least(greatest(CAST({fn_sql(fn)} AS BIGINT), 0L), n - 1) THEN _v END) + 0D").alias(name)
        for name, _q, fn in specs])


def order_statistics(df: DataFrame, value: str, by: Sequence[str],
                     specs: list[tuple[str, float, RankFn]], accuracy: int | None = None,
                     extra_aggs: list[Column] | None = None, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row per group: ``*by, n, <spec name>...`` with the exact value at each rank.

    ``accuracy`` is the number of slots of a later round (at least 2); it changes the work, never the
    result; a zero has no sign.  ``extra_aggs`` are computed over column ``_v`` (the value).  Null values are ignored; groups
    without values are absent.
    """
    by, k = list(by), len(specs)
    slots_n = max(2, accuracy or SLOTS)
    base = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    first = base.groupBy(*by).agg(F.count("_v").alias("n"), *(extra_aggs or []))
    if by:
        first = land(first, "order-groups")
        some = {r._small: r.n for r in first.groupBy((F.col("n") <= leaf_rows).alias("_small")).agg(F.count("*").alias("n")).collect()}
        if not some.get(False):
            return attach(first, _of_small(base, by, specs), by, "left")
    done: list[DataFrame] = []
    brackets = _Brackets(_first_round(base, by, [fn_sql(fn) for _, _, fn in specs]), by, k, leaf_rows)
    while True:
        done.append(brackets.of("value").selectExpr(*by, "_spec", "_lo AS _x"))
        if "leaf" in brackets.kinds:
            values = brackets.inside(base, "leaf").groupBy(*by, "_id", "_v").agg(F.count("*").alias("_c"))
            got = attach(_running(values, by + ["_id"], "_v"), brackets.of("leaf").select(*by, "_id", "_spec", "_r"),
                         by + ["_id"], "inner")
            done.append(got.where(_HOLDS).selectExpr(*by, "_spec", "_v AS _x"))
        if "more" not in brackets.kinds:
            break
        found = _next_round(brackets.inside(base, "more"), brackets.of("more"), by, slots_n)
        brackets = _Brackets(found, by, k, leaf_rows)

    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    wide = found.groupBy(*by).agg(*[
        F.expr(f"max(CASE WHEN _spec = {i} THEN _x END) + 0D").alias(name) for i, (name, _q, _fn) in enumerate(specs)])
    return attach(first, wide, by, "left")
