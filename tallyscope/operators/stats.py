"""Statistics (T1-T3): describe a measure, least-squares trend, Pearson correlation."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_finite, rhu_sql, round_half_up
from ..model import THRESHOLDS
from .order_stats import interpolate_sql, linear, order_statistics

PERCENTILES = [5, 10, 25, 75, 90, 95, 99]


def describe_measure(df: DataFrame, value: str, by: Sequence[str] = (),
                     accuracy: int | None = None, rounded: bool = True) -> DataFrame:
    """N, sum, mean, median, population std/variance, min, max, skew (3 dp) and
    linearly interpolated p5..p99 at ``p/100*(n-1)``; non-finite values ignored."""
    by = list(by)
    clean = df.selectExpr(*by, f"CASE WHEN isnan(CAST({value} AS DOUBLE)) OR abs(CAST({value} AS DOUBLE)) = double('inf') "
                               f"THEN NULL ELSE CAST({value} AS DOUBLE) END AS _x")
    specs = linear("median", 0.5)
    for p in PERCENTILES:
        specs += linear(f"p{p}", p / 100)
    extra = [F.expr("sum(_v)").alias("sum"), F.expr("avg(_v)").alias("mean"),
             F.expr("stddev_pop(_v)").alias("std"), F.expr("var_pop(_v)").alias("variance"),
             F.expr("min(_v)").alias("min"), F.expr("max(_v)").alias("max"),
             F.expr("coalesce(skewness(_v), 0.0D)").alias("skew")]
    s = order_statistics(clean, "_x", by, specs, accuracy, extra)
    r = rhu_sql if rounded else (lambda x, d=2: x)
    out = [*by, "n", f"{r('sum')} AS sum", f"{r('mean')} AS mean",
           f"{r(interpolate_sql('median', 0.5))} AS median", f"{r('std')} AS std", f"{r('variance')} AS variance",
           f"{r('min')} AS min", f"{r('max')} AS max", f"{r('CASE WHEN std > 0 THEN skew ELSE 0.0D END', 3)} AS skew"]
    out += [f"{r(interpolate_sql(f'p{p}', p / 100))} AS p{p}" for p in PERCENTILES]
    return s.selectExpr(*out)


def with_index(series: DataFrame, order_col: str, by: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """0-based position in ``order_col`` order within each group.

    Only used on reduced series (days, months): one row per period per group.
    """
    w = Window.partitionBy(*by).orderBy(order_col)
    return series.withColumn(name, F.row_number().over(w) - 1)


def linear_trend(series: DataFrame, value: str, order_col: str, by: Sequence[str] = (),
                 min_r2: float = THRESHOLDS["MIN_R2_FOR_LINEAR_FORECAST"]) -> DataFrame:
    """Least squares of value on its 0-based index; slope/intercept 2 dp, r2 4 dp;
    ``usable`` = unrounded r2 >= 0.5; fewer than 2 points -> zeros; constant series -> r2 0."""
    by = list(by)
    idx = with_index(series, order_col, by)
    g = idx.groupBy(*by).agg(
        F.count("*").alias("points"),
        F.regr_slope(F.col(value), F.col("idx").cast("double")).alias("_slope"),
        F.regr_intercept(F.col(value), F.col("idx").cast("double")).alias("_icpt"),
        F.regr_r2(F.col(value), F.col("idx").cast("double")).alias("_r2"),
        F.var_pop(value).alias("_vy"))
    enough = F.col("points") >= 2
    r2 = F.when(enough & (F.col("_vy") > 0), F.col("_r2")).otherwise(0.0)
    return g.select(*by, "points",
                    F.when(enough, round_half_up(F.col("_slope"))).otherwise(0.0).alias("slope"),
                    F.when(enough, round_half_up(F.col("_icpt"))).otherwise(0.0).alias("intercept"),
                    round_half_up(r2, 4).alias("r2"),
                    (enough & (r2 >= min_r2)).alias("usable"))


def correlate(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson r over rows where both values are finite; 0 below 2 pairs or with zero
    variance; 4 dp.  (Means use the pairwise count.)"""
    by = list(by)
    xa, xb = F.col(a).cast("double"), F.col(b).cast("double")
    both = is_finite(xa) & is_finite(xb)
    pairs = df.select(*by, F.when(both, xa).alias("_a"), F.when(both, xb).alias("_b"))
    g = pairs.groupBy(*by).agg(F.count("_a").alias("pairs"), F.covar_pop("_a", "_b").alias("_cov"),
                               F.stddev_pop("_a").alias("_sa"), F.stddev_pop("_b").alias("_sb"))
    r = F.try_divide(F.col("_cov"), F.col("_sa") * F.col("_sb"))
    ok = (F.col("pairs") >= 2) & (F.col("_sa") > 0) & (F.col("_sb") > 0)
    return g.select(*by, "pairs", round_half_up(F.when(ok, r).otherwise(0.0), 4).alias("correlation"))
