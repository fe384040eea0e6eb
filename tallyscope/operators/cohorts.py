"""Cohort retention (H1).

Rows collapse to distinct (user, month) pairs first (map-side combined), so the
per-user window that finds the first month sees at most one row per active
month of that user, however many raw rows a hot user has.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from ..model import TS, USER


def cohort_retention(facts: DataFrame, by: Sequence[str] = (), periods: int = 12, min_size: int = 3,
                     min_cohorts: int = 2) -> DataFrame:
    """H1: cohort = month of a user's first row; period = whole months since (0..11);
    distinct users per cell and % of the period-0 size (2 dp).  Cohorts smaller than 3 are
    dropped; a group yields rows only with at least 2 cohorts left.  All 12 periods are listed."""
    by = list(by)
    um = facts.where(F.col(USER).isNotNull() & F.col(TS).isNotNull()) \
        .select(*by, USER, F.trunc(F.to_date(TS), "month").alias("_m")).distinct()
    w = Window.partitionBy(*by, USER)
    um = um.withColumn("_c", F.min("_m").over(w))
    um = um.withColumn("period", F.months_between("_m", "_c").cast("int"))
    cells = um.where(F.col("period").between(0, periods - 1)) \
        .groupBy(*by, "_c", "period").agg(F.count("*").alias("users"))
    sizes = cells.where(F.col("period") == 0).select(*by, "_c", F.col("users").alias("size")) \
        .where(F.col("size") >= min_size)
    wg = Window.partitionBy(*by)
    sizes = sizes.withColumn("_k", F.count("*").over(wg)).where(F.col("_k") >= min_cohorts).drop("_k")
    grid = sizes.crossJoin(F.broadcast(facts.sparkSession.range(periods)
                                       .select(F.col("id").cast("int").alias("period"))))
    out = grid.join(cells, by + ["_c", "period"], "left")
    users = F.coalesce(F.col("users"), F.lit(0))
    return out.select(*by, F.date_format("_c", "yyyy-MM").alias("cohort"), "period", "size",
                      users.alias("users"), round_half_up(users / F.col("size") * 100).alias("pct"))


def cohort_matrix(retention: DataFrame, by: Sequence[str] = (), periods: int = 12) -> DataFrame:
    """H1 matrix view: one row per cohort with ``p0..p11`` retention percentages.

    The period values are listed explicitly, so the pivot needs no extra job to find them."""
    by = list(by)
    wide = retention.groupBy(*by, "cohort", "size").pivot("period", list(range(periods))).agg(F.first("pct"))
    return wide.select(*by, "cohort", "size", *[F.col(f"`{k}`").alias(f"p{k}") for k in range(periods)])
