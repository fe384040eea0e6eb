"""Helpers shared by the analysis jobs: per-group scalar attachment and the fact bundle."""

from __future__ import annotations

from functools import cached_property
from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Roles


class Facts:
    """Cleaned fact rows plus the per-group data-quality record.

    ``df`` columns: ``*by, amount, event_ts, qty, user_key, category, product,
    is_iqr_outlier, iqr_lower, iqr_upper``.  ``quality`` is made when first asked for.
    """

    def __init__(self, df: DataFrame, quality: Callable[[], DataFrame], roles: Roles, by: tuple[str, ...]) -> None:
        self.df, self.roles, self.by, self._quality = df, roles, by, quality

    @cached_property
    def quality(self) -> DataFrame:
        return self._quality()


def attach(rows: DataFrame, scalars: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-group scalars onto rows.

    With no grouping keys ``scalars`` is a global aggregate of exactly one row (a
    proven size bound), so it is broadcast.  With keys it has one row per group;
    the equi join is left to AQE, which broadcasts it only when the measured size
    is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and otherwise
    shuffles both sides on the keys.  Keys match null-safely.
    """
    by = list(by)
    if not by:
        if how in ("inner", "cross"):
            return rows.crossJoin(F.broadcast(scalars))
        # at most one row on the right; keep the left rows when it is empty
        return rows.join(F.broadcast(scalars), F.lit(True), how)
    alias = {k: f"__key{i}" for i, k in enumerate(by)}
    s = scalars
    for k, a in alias.items():
        s = s.withColumnRenamed(k, a)
    cond = [rows[k].eqNullSafe(s[a]) for k, a in alias.items()]
    return rows.join(s, cond, how).drop(*alias.values())
