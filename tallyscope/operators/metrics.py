"""Aggregations and time metrics (M1-M12) over a fact table.

Every job takes the fact DataFrame (standard columns, see :mod:`tallyscope.model`)
and optional grouping keys ``by``; one lazy plan answers all groups at once.
Windows only run over reduced series (days, months, categories with a group
limit), never over raw fact rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import day_key
from ..functions.numbers import rhu_sql, round_half_up
from ..model import AMOUNT, CATEGORY, PRODUCT, TS, USER, THRESHOLDS
from ..session import land
from .common import attach
from .order_stats import interpolate_sql, linear, order_statistics, rank_spec
from .profile import totals_of
from .stats import linear_trend, with_index


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


# --------------------------------------------------------------------------- M1, M2
def headline(facts: DataFrame, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """M1: revenue (rounded sum), orders (rows), AOV (rounded revenue / rows), median order."""
    by = list(by)
    med = order_statistics(facts, AMOUNT, by, linear("median", 0.5), accuracy,
                           [F.expr("sum(_v)").alias("_sum")])
    rows = facts.groupBy(*by).agg(F.count("*").alias("orders"))
    j = attach(rows, med, by, "left")
    revenue = rhu_sql("_sum")
    return j.selectExpr(*by, f"{revenue} AS revenue", "orders",
                        f"CASE WHEN orders > 0 THEN {rhu_sql(f'{revenue} / orders')} END AS aov",
                        f"{rhu_sql(interpolate_sql('median', 0.5))} AS median_order")


def headline_of(totals: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M1 from the profile's totals and an already computed ``describe_measure`` (same rounded sum and median)."""
    by = list(by)
    j = attach(totals.select(*by, F.col("rows").alias("orders")),
               stats.select(*by, F.col("sum").alias("_rev"), F.col("median").alias("_med")), by, "left")
    return j.selectExpr(*by, "_rev AS revenue", "orders",
                        f"CASE WHEN orders > 0 THEN {rhu_sql('_rev / orders')} END AS aov", "_med AS median_order")


def headline_without_outliers(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M2: sum and mean of the amounts not flagged as IQR outliers."""
    return without_outliers_of(totals_of(facts, by, ["kept", "kept_sum"]), by)


def without_outliers_of(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    some, rev = F.col("kept") > 0, round_half_up(F.col("kept_sum"))
    return totals.select(*by, F.when(some, rev).alias("revenue_excluding_outliers"),
                         F.when(some, round_half_up(rev / F.col("kept"))).alias("aov_excluding_outliers"))


# --------------------------------------------------------------------------- M3, M4, M5
def _enough_days(series: DataFrame, by: Sequence[str], min_points: int) -> DataFrame:
    if min_points <= 1:
        return series
    w = Window.partitionBy(*by)
    return series.withColumn("_pts", F.count("*").over(w)).where(F.col("_pts") >= min_points).drop("_pts")


def day_totals(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and amount total of every UTC day: what M3 to M5 are made of, by one scan."""
    return totals_of(facts.where(F.col(TS).isNotNull()).withColumn("day", day_key(TS)), [*by, "day"], ["rows", "amount_sum"])


def _value(has_amount: bool):
    return F.col("amount_sum") if has_amount else F.col("rows").cast("double")


def daily_trend(facts: DataFrame, by: Sequence[str] = (), has_amount: bool = True,
                min_points: int = THRESHOLDS["MIN_ROWS_FOR_TRENDS"]) -> DataFrame:
    """M3: per UTC day sum of amounts (or row count without an amount role), 2 dp.
    Empty unless the group has at least ``min_points`` distinct days."""
    return daily_of(day_totals(facts, by), by, has_amount, min_points)


def daily_of(days: DataFrame, by: Sequence[str] = (), has_amount: bool = True,
             min_points: int = THRESHOLDS["MIN_ROWS_FOR_TRENDS"]) -> DataFrame:
    return _enough_days(days, list(by), min_points).select(*by, "day", round_half_up(_value(has_amount)).alias("val"))


def monthly_trend(facts: DataFrame, by: Sequence[str] = (), has_amount: bool = True,
                  min_days: int = THRESHOLDS["MIN_ROWS_FOR_TRENDS"]) -> DataFrame:
    """M4: per ``yyyy-MM`` sum, 2 dp (same gate as M3)."""
    return monthly_of(day_totals(facts, by), by, has_amount, min_days)


def monthly_of(days: DataFrame, by: Sequence[str] = (), has_amount: bool = True,
               min_days: int = THRESHOLDS["MIN_ROWS_FOR_TRENDS"]) -> DataFrame:
    m = _enough_days(days, list(by), min_days).groupBy(*by, F.substring("day", 1, 7).alias("month"))
    return m.agg(round_half_up(F.sum(_value(has_amount))).alias("val"))


WEEKDAYS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def weekday_profile(facts: DataFrame, by: Sequence[str] = (), has_amount: bool = True,
                    min_days: int = THRESHOLDS["MIN_ROWS_FOR_TRENDS"]) -> DataFrame:
    """M5: sum and row count per weekday, always seven rows (Sun first) per group."""
    return weekdays_of(day_totals(facts, by), by, has_amount, min_days)


def weekdays_of(days: DataFrame, by: Sequence[str] = (), has_amount: bool = True,
                min_days: int = THRESHOLDS["MIN_ROWS_FOR_TRENDS"]) -> DataFrame:
    by = list(by)
    dow = F.dayofweek(F.to_date("day")) - 1
    sums = [c.alias(f"{n}{d}") for d in range(7) for n, c in (
        ("_v", F.sum(F.when(dow == d, _value(has_amount)))), ("_c", F.sum(F.when(dow == d, F.col("rows")))))]
    wide = days.groupBy(*by).agg(F.count("*").alias("_days"), *sums).where(F.col("_days") >= min_days)
    rows = ", ".join(f"named_struct('dow', {d}, 'name', '{n}', 'v', _v{d}, 'c', _c{d})" for d, n in enumerate(WEEKDAYS))
    long = wide.selectExpr(*by, f"explode(array({rows})) AS _w").select(*by, "_w.dow", "_w.name", "_w.v", "_w.c")
    return long.select(*by, "dow", "name", round_half_up(F.coalesce(F.col("v"), F.lit(0.0))).alias("val"),
                       F.coalesce(F.col("c"), F.lit(0)).alias("count"))


# --------------------------------------------------------------------------- M6, M7, M8
def annualised_growth(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M6: ((last/first)^(365/points) - 1) * 100 on the rounded daily series; needs first > 0
    and more than 30 points (points, not elapsed days)."""
    by = list(by)
    g = daily.groupBy(*by).agg(F.count("*").alias("points"),
                               F.min_by("val", "day").alias("first_val"),
                               F.max_by("val", "day").alias("last_val"))
    ok = (F.col("points") > 30) & (F.col("first_val") > 0)
    cagr = round_half_up((F.pow(F.col("last_val") / F.col("first_val"), 365.0 / F.col("points")) - 1) * 100)
    return g.select(*by, "points", "first_val", "last_val", F.when(ok, cagr).alias("cagr"))


def week_over_week(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M7: last 7 points vs the previous 7 points, %; needs 14 points; null if prior sum <= 0."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(F.col("day").desc())
    r = daily.withColumn("_rn", F.row_number().over(w))
    g = r.groupBy(*by).agg(F.count("*").alias("points"),
                           F.sum(F.when(F.col("_rn") <= 7, F.col("val"))).alias("last7"),
                           F.sum(F.when(F.col("_rn").between(8, 14), F.col("val"))).alias("prev7"))
    ok = (F.col("points") >= 14) & (F.col("prev7") > 0)
    return g.select(*by, "points", F.when(F.col("points") >= 14, round_half_up("last7")).alias("last7"),
                    F.when(F.col("points") >= 14, round_half_up("prev7")).alias("prev7"),
                    F.when(ok, round_half_up((F.col("last7") - F.col("prev7")) / F.col("prev7") * 100)).alias("growth"))


def linear_forecast(daily: DataFrame, by: Sequence[str] = (), horizon: int = 3,
                    min_points: int = THRESHOLDS["MIN_ROWS_FOR_FORECAST"]) -> DataFrame:
    """M8: with a usable fit and >= 12 points, max(0, slope*(n+i) + intercept) for i = 1..3
    using the rounded slope and intercept (so index n itself is skipped)."""
    by = list(by)
    t = linear_trend(daily, "val", "day", by).where(F.col("usable") & (F.col("points") >= min_points))
    steps = _spark(daily).range(1, horizon + 1).select(F.col("id").cast("int").alias("step"))
    f = t.crossJoin(F.broadcast(steps))  # horizon rows: a fixed bound
    val = round_half_up(F.greatest(F.lit(0.0), F.col("slope") * (F.col("points") + F.col("step")) + F.col("intercept")))
    return f.select(*by, "step", F.concat(F.lit("Period +"), F.col("step").cast("string")).alias("name"),
                    val.alias("val"), "r2")


# --------------------------------------------------------------------------- M9, M10
def user_totals(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and amount total (``t``) of every non-empty user."""
    return facts.where(F.col(USER).isNotNull()).groupBy(*by, USER).agg(
        F.count("*").alias("_c"), F.sum(F.coalesce(F.col(AMOUNT), F.lit(0.0))).alias("t"))


def customer_summary(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M9: distinct non-empty users and % of them with more than one row."""
    return customers_of(user_totals(facts, by), by)


def customers_of(users: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    g = users.groupBy(*by).agg(F.count("*").alias("unique_users"), F.count_if(F.col("_c") > 1).alias("_rep"))
    return g.select(*by, "unique_users", F.when(F.col("unique_users") > 0, round_half_up(
        F.col("_rep") / F.col("unique_users") * 100)).otherwise(0.0).alias("repeat_rate"))


def pareto_share(facts: DataFrame, by: Sequence[str] = (), top_fraction: float = 0.2,
                 accuracy: int | None = None) -> DataFrame:
    """% of the amount total carried by the top max(1, floor(0.2*users)) users.

    The k-th largest user total comes from the exact order-statistic job, then
    top sum = sum(totals above it) + (k - count above) * it -- no global sort.  The totals are
    landed: every narrowing round and the sum above the k-th read them.
    """
    return pareto_of(land(user_totals(facts, by).drop("_c"), "user-totals"), by, top_fraction, accuracy)


def pareto_of(totals: DataFrame, by: Sequence[str] = (), top_fraction: float = 0.2, accuracy: int | None = None) -> DataFrame:
    by = list(by)
    k_sql = f"greatest(1L, CAST(floor(n * {top_fraction!r}D) AS BIGINT))"
    kth = order_statistics(totals, "t", by, [rank_spec("tk", 1 - top_fraction, f"n - {k_sql}")],
                           accuracy, [F.expr("sum(_v)").alias("total")])
    kth = kth.withColumn("k", F.expr(k_sql))
    j = attach(totals, kth.select(*by, "tk"), by, "inner")
    above = j.groupBy(*by).agg(F.sum(F.when(F.col("t") > F.col("tk"), F.col("t"))).alias("_sa"),
                               F.count_if(F.col("t") > F.col("tk")).alias("_ca"))
    r = attach(kth, above, by, "left")
    top = F.coalesce(F.col("_sa"), F.lit(0.0)) + (F.col("k") - F.coalesce(F.col("_ca"), F.lit(0))) * F.col("tk")
    share = F.when(F.col("total") > 0, round_half_up(top / F.col("total") * 100))
    return r.select(*by, F.col("n").alias("users"), F.col("k").alias("top_users"), share.alias("top_share"))


# --------------------------------------------------------------------------- M11, M12
def top_of(sums: DataFrame, key_col: str, by: Sequence[str], k: int, count_name: str) -> DataFrame:
    """The ``k`` names of the largest totals; missing and empty names are one 'Unknown'."""
    by = list(by)
    name = F.when(F.col(key_col).isNull() | (F.col(key_col) == ""), F.lit("Unknown")).otherwise(F.col(key_col))
    g = sums.groupBy(*by, name.alias("name")).agg(F.sum("amount_sum").alias("_v"), F.sum("rows").alias(count_name))
    # row_number() <= k is planned with a partial per-group limit before the shuffle.
    w = Window.partitionBy(*by).orderBy(F.col("_v").desc(), F.col("name"))
    ranked = g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(*by, "rank", "name", round_half_up(F.col("_v")).alias("val"), count_name)


def _top_k(facts: DataFrame, key_col: str, by: Sequence[str], k: int, count_name: str) -> DataFrame:
    rows = facts.select(*by, key_col, F.coalesce(F.col(AMOUNT), F.lit(0.0)).alias("amount_sum"), F.lit(1).alias("rows"))
    return top_of(rows, key_col, by, k, count_name)


def category_breakdown(facts: DataFrame, by: Sequence[str] = (), k: int = 12) -> DataFrame:
    """Sum and rows per category (empty -> 'Unknown'), top 12 by sum (ties by name)."""
    return _top_k(facts, CATEGORY, by, k, "count")


def top_products(facts: DataFrame, by: Sequence[str] = (), k: int = 10) -> DataFrame:
    """The same per product, top 10."""
    return _top_k(facts, PRODUCT, by, k, "orders")


def daily_index(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return with_index(daily, "day", by)
