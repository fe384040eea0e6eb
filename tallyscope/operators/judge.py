"""Judgments (J1-J14): gates and distortion tests, one row per group.

All inputs are small per-group aggregates (statistics, daily/monthly series, category sums) out of the
shared :mod:`profile`, combined side by side; gates are columns, not driver branches, so one plan serves
every group.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_key, month_key
from ..functions.numbers import round_half_up
from ..functions.sqlfns import inr_sql, numtext_sql
from ..model import AMOUNT, CATEGORY, QTY, TS, THRESHOLDS, Roles
from ..texts import DETAIL, IMPLICATION, PREAMBLE, QUALITY_WARNING, filled, sql_text
from .common import Facts, attach
from .profile import Profile, build_profile, totals_of
from .stats import describe_measure, linear_trend

T = THRESHOLDS


def analysis_tier(rows: Column) -> Column:
    """J1."""
    return (F.when(rows >= T["MIN_ROWS_FOR_FULL"], "FULL")
            .when(rows >= T["MIN_ROWS_FOR_STANDARD"], "STANDARD")
            .when(rows >= T["MIN_ROWS_FOR_PATTERNS"], "DIRECTIONAL")
            .otherwise("FACTS_ONLY"))


def quality_verdict(clean_rate: Column) -> Column:
    """J2."""
    return (F.when(clean_rate < T["MIN_CLEAN_RATE_HARD_REFUSE"], "CRITICAL")
            .when(clean_rate < T["MIN_CLEAN_RATE_FOR_ANALYSIS"], "DEGRADED")
            .otherwise("CLEAN"))


def temporal_series(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """J6 series: per UTC day, sum of amount where a missing or zero amount counts as 1."""
    return totals_of(facts.where(F.col(TS).isNotNull()).withColumn("day", day_key(TS)), [*by, "day"], ["ones_sum"]) \
        .withColumnRenamed("ones_sum", "v")


def temporal_quality(facts: DataFrame, roles: Roles, by: Sequence[str] = ()) -> DataFrame:
    """Points, frequency, sufficiency flags, fit, and the trend-concentration test."""
    return temporal_of(temporal_series(facts, by), by).drop("concentrated_exact")


def temporal_of(s: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """J6-J9 of a daily series (``day``, ``v``)."""
    by = list(by)
    g = s.groupBy(*by).agg(
        F.count("*").alias("data_points"), F.sum("v").alias("_sum"), F.avg("v").alias("_mean"),
        F.max(F.struct(F.col("v"), F.negative(F.unix_date(F.to_date("day"))).alias("_nd"),
                       F.col("day"))).alias("_mx"),
        F.min(F.to_date("day")).alias("_d0"), F.max(F.to_date("day")).alias("_d1"))
    fit = linear_trend(s, "v", "day", by)
    g = attach(g, fit.select(*by, "r2", F.col("usable").alias("_usable")), by, "left")
    dp = F.col("data_points")
    avg_gap = F.datediff("_d1", "_d0") / (dp - 1)
    freq = F.when(dp < 2, "unknown").when(avg_gap < 1.5, "daily").when(avg_gap < 8, "weekly").otherwise("monthly")
    trend_ok = dp >= T["MIN_ROWS_FOR_TRENDS"]
    mean_r = round_half_up(F.col("_mean"))
    mx = F.col("_mx.v")
    impact = (mx - mean_r) / mean_r
    concentrated = trend_ok & (mean_r > 0) & (impact > 1.5)
    return g.select(
        *by, "data_points", freq.alias("frequency"), trend_ok.alias("trend_ok"),
        (dp >= T["MIN_ROWS_FOR_SEASONAL"]).alias("seasonal_ok"),
        (dp >= T["MIN_ROWS_FOR_FORECAST"]).alias("forecast_ok"),
        F.when(trend_ok, F.col("r2")).otherwise(0.0).alias("r2"),
        (trend_ok & F.col("_usable")).alias("is_linear_fit"),
        concentrated.alias("trend_concentrated"),
        F.when(concentrated, F.col("_mx.day")).alias("concentrated_period"),
        F.when(concentrated, round_half_up(mx)).alias("concentrated_value"),
        F.when(concentrated, round_half_up((F.col("_sum") - mx) / (dp - 1))).alias("concentrated_baseline"),
        F.when(concentrated, round_half_up(impact * 100)).alias("concentrated_pct_above"),
        F.when(concentrated, mx).alias("concentrated_exact"))


def dominance(facts: DataFrame, roles: Roles, by: Sequence[str] = (),
              pct: float = T["CONCENTRATION_DOMINANCE_PCT"]) -> DataFrame:
    """With >= 10 rows, the top category's share of the whole amount total (rows without a
    category included in the total) above 40 % -> category, pct, value (2 dp)."""
    return dominance_of(totals_of(facts, by, ["rows", "amount_sum"]),
                        totals_of(facts, [*by, CATEGORY], ["amount_sum"]), by, pct)


def dominance_of(totals: DataFrame, categories: DataFrame, by: Sequence[str] = (),
                 pct: float = T["CONCENTRATION_DOMINANCE_PCT"]) -> DataFrame:
    by = list(by)
    cats = categories.where(F.col(CATEGORY).isNotNull() & (F.col(CATEGORY) != ""))
    # the category with the largest sum, ties to the smallest name: one partial-combined
    # aggregate over (-sum, name) instead of a sort
    top = cats.groupBy(*by).agg(F.min(F.struct(F.negative("amount_sum").alias("nv"), F.col(CATEGORY).alias("c"))).alias("_t")) \
        .select(*by, F.negative("_t.nv").alias("_v"), F.col("_t.c").alias(CATEGORY))
    j = attach(totals.select(*by, "rows", "amount_sum"), top, by, "left")
    share = F.col("_v") / F.col("amount_sum") * 100
    fires = (F.col("rows") >= 10) & F.col("_v").isNotNull() & (F.col("amount_sum") > 0) & (share > pct)
    return j.where(fires).select(*by, F.col(CATEGORY).alias("category"), round_half_up(share).alias("pct"),
                                 round_half_up(F.col("_v")).alias("value"))


def price_volume_contradiction(facts: DataFrame, roles: Roles, by: Sequence[str] = ()) -> DataFrame:
    """Amount, quantity and date roles, >= 10 rows, >= 5 values each, >= 3 days, >= 4 months:
    monthly amount slope > 0 while monthly quantity slope < 0 (rounded slopes)."""
    by = list(by)
    base = totals_of(facts, by, ["rows", "amounts", "quantities"])
    dated = facts.where(F.col(TS).isNotNull())
    days = dated.groupBy(*by).agg(F.count_distinct(day_key(TS)).alias("days"))
    monthly = totals_of(dated.withColumn("month", month_key(TS)), [*by, "month"], ["amount_sum", "quantity_sum"])
    return contradiction_of(attach(base, days, by, "left"), monthly, roles, by)


def contradiction_of(totals: DataFrame, monthly: DataFrame, roles: Roles, by: Sequence[str] = ()) -> DataFrame:
    """J13 of per-group totals (rows, amounts, quantities, days) and monthly sums."""
    by = list(by)
    rt = linear_trend(monthly, "amount_sum", "month", by).select(*by, F.col("points").alias("months"),
                                                                 F.col("slope").alias("revenue_slope"))
    qt = linear_trend(monthly, "quantity_sum", "month", by).select(*by, F.col("slope").alias("quantity_slope"))
    j = attach(attach(totals, rt, by, "left"), qt, by, "left")
    applies = F.lit(bool(roles.revenue and roles.quantity and roles.date)) & (F.col("rows") >= 10) & \
        (F.col("amounts") >= 5) & (F.col("quantities") >= 5) & (F.col("days") >= T["MIN_ROWS_FOR_TRENDS"]) & \
        (F.col("months") >= 4)
    fires = F.coalesce(applies & (F.col("revenue_slope") > 0) & (F.col("quantity_slope") < 0), F.lit(False))
    return j.select(*by, F.coalesce(F.col("months"), F.lit(0)).alias("months"),
                    "revenue_slope", "quantity_slope", fires.alias("contradiction"))


def judgment(facts: Facts, accuracy: int | None = None, stats: DataFrame | None = None, profile: Profile | None = None,
             tails: DataFrame | None = None, cut: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """J1-J14 for every group: one row with tier, verdict, flags, distortions, sentences and permissions.

    The facts are scanned five times at most: once for the profile, three times for the order statistics and
    once for the tails.  ``stats``, ``profile`` and ``tails`` may pass what is already computed."""
    f, roles, by = facts.df, facts.roles, list(facts.by)
    profile = profile or build_profile(facts, cut=cut)
    q = facts.quality.select(*by, "rows_before", "rows_after", "clean_rate",
                             F.array_join("issues", "; ").alias("_issues"))
    j = attach(q, profile.totals.select(*by, "rows", F.col("outliers").alias("outlier_count"), "kept_sum"), by, "left") \
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("rows", "outlier_count")})
    if roles.category:
        named = profile.categories.where((F.col(CATEGORY) != "") & (F.col("rows") >= T["MIN_CATEGORY_INSTANCES"]))
        j = attach(j, named.groupBy(*by).agg(F.count("*").alias("_ncat")), by, "left")
        j = attach(j, dominance_of(profile.totals, profile.categories, by).select(
            *by, F.col("category").alias("dominant_category"), F.col("pct").alias("dominant_pct"),
            F.col("value").alias("dominant_value")), by, "left")
    if roles.revenue:
        if stats is None:
            stats = cut(describe_measure(f, AMOUNT, by, accuracy))
        tails = profile.tails(stats) if tails is None else tails
        j = attach(j, stats.select(*by, F.col("sum").alias("_s_sum"), F.col("mean").alias("_s_mean"),
                                   F.col("median").alias("_s_median"), "skew"), by, "left")
        j = attach(j, tails.select(*by, F.col("mean_up_to_p95").alias("_mean_wo")), by, "left")
    if roles.date:
        j = attach(j, temporal_of(profile.days.select(*by, "day", F.col("ones_sum").alias("v")), by), by, "left")
        days = profile.days.groupBy(*by).agg(F.count("*").alias("days"))
        j = attach(j, contradiction_of(attach(profile.totals.select(*by, "rows", "amounts", "quantities"), days, by, "left"),
                                       profile.months, roles, by).drop("months"), by, "left")
    absent = {"_ncat": "bigint", "dominant_category": "string", "dominant_pct": "double", "dominant_value": "double",
              "_s_sum": "double", "_s_mean": "double", "_s_median": "double", "skew": "double", "_mean_wo": "double",
              "data_points": "bigint", "frequency": "string", "trend_ok": "boolean", "seasonal_ok": "boolean",
              "forecast_ok": "boolean", "r2": "double", "is_linear_fit": "boolean", "trend_concentrated": "boolean",
              "concentrated_period": "string", "concentrated_value": "double", "concentrated_baseline": "double",
              "concentrated_pct_above": "double", "concentrated_exact": "double", "revenue_slope": "double",
              "quantity_slope": "double", "contradiction": "boolean"}
    j = j.withColumns({c: F.lit(None).cast(t) for c, t in absent.items() if c not in j.columns})

    rows, cr = F.col("rows"), F.col("clean_rate")
    density = F.when(rows > 0, F.col("outlier_count") / rows * 100)
    skew_flag = (rows >= 10) & (F.abs(F.col("skew")) > T["SKEW_DISTORTION_THRESHOLD"])
    with_o, without_o = F.col("_s_sum"), F.coalesce(F.col("kept_sum"), F.lit(0.0))
    diff = with_o - without_o
    ratio = F.abs(diff) / F.abs(with_o)
    outlier_dist = (rows >= 10) & with_o.isNotNull() & F.when(
        with_o == 0, diff != 0).otherwise(ratio > T["OUTLIER_DISTORTION_THRESHOLD"])
    trend_ok = F.coalesce(F.col("trend_ok"), F.lit(False))
    blocked = cr < T["MIN_CLEAN_RATE_HARD_REFUSE"]
    tier = analysis_tier(rows)
    perm = {
        "can_show_patterns": rows >= T["MIN_ROWS_FOR_PATTERNS"],
        "can_show_trends": trend_ok,
        "can_show_seasonal": F.col("seasonal_ok"),
        "can_forecast": F.col("forecast_ok") & F.col("is_linear_fit"),
        "can_show_categories": F.col("_ncat") >= 2,
        "can_show_user_analysis": F.lit(bool(roles.user)) & (rows >= 20),
        "can_show_statistical": rows >= T["MIN_ROWS_FOR_PATTERNS"],
        "can_show_recommendations": tier != "FACTS_ONLY",
        "full_analysis": rows >= T["MIN_ROWS_FOR_FULL"],
    }
    cols = [F.col(k) for k in by] + [
        "rows_before", "rows", "clean_rate", tier.alias("analysis_tier"),
        quality_verdict(cr).alias("quality_verdict"), blocked.alias("quality_blocks_analysis"),
        F.coalesce(density > T["MAX_ANOMALY_DENSITY_PCT"], F.lit(False)).alias("density_flag"),
        round_half_up(density).alias("outlier_density"), "outlier_count",
        F.coalesce(skew_flag, F.lit(False)).alias("skew_flag"), "skew",
        F.when(skew_flag, F.col("_s_mean")).alias("skew_mean"),
        F.when(skew_flag, F.col("_s_median")).alias("skew_median"),
        F.when(skew_flag, round_half_up(F.col("_mean_wo"))).alias("mean_without_top5"),
        F.when(skew_flag, F.when(F.col("skew") > 0, "right").otherwise("left")).alias("skew_direction"),
        F.coalesce(outlier_dist, F.lit(False)).alias("outlier_distortion"),
        F.when(outlier_dist, round_half_up(with_o)).alias("with_outliers"),
        F.when(outlier_dist, round_half_up(without_o)).alias("without_outliers"),
        F.when(outlier_dist, round_half_up(diff)).alias("outlier_difference"),
        F.when(outlier_dist, round_half_up(ratio * 100)).alias("outlier_pct_impact"),
        F.coalesce(F.col("data_points"), F.lit(0)).alias("data_points"),
        trend_ok.alias("has_sufficient_for_trend"),
        F.coalesce(F.col("frequency"), F.lit("unknown")).alias("frequency"),
        F.when(trend_ok, F.col("r2")).otherwise(0.0).alias("r2"),
        F.coalesce(F.col("is_linear_fit") & trend_ok, F.lit(False)).alias("is_linear_fit"),
        F.coalesce(trend_ok & F.col("trend_concentrated"), F.lit(False)).alias("trend_concentrated"),
        "concentrated_period", "concentrated_value", "concentrated_baseline", "concentrated_pct_above",
        "dominant_category", "dominant_pct", "dominant_value",
        F.coalesce(F.col("contradiction"), F.lit(False)).alias("contradiction"),
        "revenue_slope", "quantity_slope",
    ] + [(F.coalesce(v, F.lit(False)) & ~blocked).alias(k) for k, v in perm.items()]
    cols += ["rows_after", "_issues", F.when(outlier_dist, without_o).alias("_without"), "concentrated_exact"]
    return _with_sentences(j.select(*cols), by)


#: Displayed values by name: rupees, plain numbers, whole numbers.  One lambda each formats them all.
_SHOWN = {
    "inr": ("skew_mean", "skew_median", "mean_without_top5", "with_outliers", "_without", "concentrated_exact",
            "concentrated_baseline"),
    "num": ("clean_rate", "outlier_density", "outlier_pct_impact", "concentrated_pct_above", "dominant_pct"),
    "int": ("revenue_slope", "quantity_slope"),
}


def _with_sentences(j: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds the preamble, the warnings and the detail of every judgment that holds."""
    form = {"inr": inr_sql, "num": numtext_sql, "int": lambda x: numtext_sql(x, 0)}
    j = j.selectExpr("*", *[f"transform(array({', '.join(names)}), x -> {form[kind]('x')}) AS _{kind}"
                            for kind, names in _SHOWN.items()])

    def show(name: str) -> str:
        kind = next(k for k, names in _SHOWN.items() if name in names)
        return f"_{kind}[{_SHOWN[kind].index(name)}]"

    text = "CAST({} AS STRING)".format
    # the share left out is not rounded
    excluded = "regexp_replace(CAST(100.0D - clean_rate AS STRING), '[.]0$', '')"
    critical = filled(PREAMBLE["CRITICAL"], show("clean_rate"), text("rows_after"), text("rows_before"), "_issues")
    degraded = filled(PREAMBLE["DEGRADED"], text("rows_before - rows_after"), text("rows_before"), show("clean_rate"))
    density = filled(PREAMBLE["DENSITY"], show("outlier_density"), text("outlier_count"), text("rows"))
    shown = {
        "mandatory_preamble": f"array_compact(array(CASE quality_verdict WHEN 'CRITICAL' THEN {critical} "
                              f"WHEN 'DEGRADED' THEN {degraded} END, CASE WHEN density_flag THEN {density} END))",
        "quality_warnings": "array_compact(array(CASE WHEN quality_verdict = 'DEGRADED' THEN "
                            f"{filled(QUALITY_WARNING, excluded, show('clean_rate'))} END))",
        "skew_detail": "CASE WHEN skew_flag THEN " + filled(
            DETAIL["SKEW"], show("skew_mean"), "CASE WHEN skew > 0 THEN 'inflated' ELSE 'deflated' END",
            show("skew_median"), show("mean_without_top5")) + " END",
        "outlier_detail": "CASE WHEN outlier_distortion THEN " + filled(
            DETAIL["OUTLIER"], show("with_outliers"), show("_without"), show("outlier_pct_impact")) + " END",
        "trend_detail": "CASE WHEN trend_concentrated THEN " + filled(
            DETAIL["TREND"], "concentrated_period", show("concentrated_exact"), show("concentrated_pct_above"),
            show("concentrated_baseline")) + " END",
        "dominance_detail": "CASE WHEN dominant_category IS NOT NULL THEN " + filled(
            DETAIL["DOMINANCE"], "dominant_category", show("dominant_pct")) + " END",
        "contradiction_detail": "CASE WHEN contradiction THEN " + filled(
            DETAIL["CONTRADICTION"], show("revenue_slope"), show("quantity_slope")) + " END",
        "contradiction_implication": f"CASE WHEN contradiction THEN {sql_text(IMPLICATION)} END",
    }
    keep = [c for c in j.columns if not c.startswith("_") and c not in ("rows_after", "concentrated_exact")]
    return j.selectExpr(*[f"`{c}`" for c in keep], *[f"{e} AS {n}" for n, e in shown.items()])
