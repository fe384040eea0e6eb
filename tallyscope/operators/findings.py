"""Ranked findings (F1) and the confidence grade (F2)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sqlfns import numtext_sql
from ..model import RELIABILITY_WEIGHT, URGENCY_WEIGHT, Roles
from ..texts import CHECK, DETAIL, filled, sql_text
from .common import attach


def ranked_findings(anomalies: DataFrame, judged: DataFrame, metrics: DataFrame,
                    by: Sequence[str] = (), k: int = 5) -> DataFrame:
    """F1.  ``anomalies``: the ranked A9 list; ``judged``: the J frame; ``metrics``: one row per
    group with revenue, aov, growth, repeat_rate, unique_users (nullable).

    Sources in insertion order (``seq`` keeps ties stable): anomalies that are HIGH or have an
    impact, the price/volume contradiction, HIGH distortions (skew, outlier total, trend
    concentration), category dominance, a week-over-week move above 5 %, a repeat rate under 30 %.
    Score = magnitude x reliability weight x urgency weight; top 5 per group.
    """
    by = list(by)
    jm = attach(judged, metrics, by, "left")

    a = attach(anomalies, metrics.select(*by, "aov"), by, "left") \
        .where((F.col("severity") == "HIGH") | (F.col("impact") > 0))
    a = a.select(*by, F.col("rank").cast("int").alias("seq"), F.lit("ANOMALY").alias("type"),
                 F.col("type").alias("subtype"),
                 F.when(F.col("impact") != 0, F.col("impact"))
                 .otherwise(F.col("value") * F.coalesce(F.col("aov"), F.lit(0.0))).alias("magnitude"),
                 F.col("severity").alias("reliability"), (F.col("severity") != "LOW").alias("actionable"),
                 F.col("reason").alias("detail"), "falsifiability", F.lit(None).cast("string").alias("implication"))

    rev = "coalesce(revenue, 0.0D)"

    def item(seq, cond, type_, subtype, magnitude, reliability, actionable, detail, implication="CAST(NULL AS STRING)"):
        return (f"named_struct('keep', coalesce({cond}, false), 'seq', {100 + seq}, 'type', '{type_}', "
                f"'subtype', {subtype}, 'magnitude', CAST(({magnitude}) AS DOUBLE), 'reliability', {reliability}, "
                f"'actionable', {actionable}, 'detail', {detail}, 'falsifiability', {sql_text(CHECK[type_])}, "
                f"'implication', {implication})")

    note = f"CASE WHEN trend_concentrated THEN {filled(DETAIL['GROWTH_NOTE'], 'concentrated_period')} ELSE '' END"
    growth = filled(DETAIL["GROWTH"], "CASE WHEN growth > 0 THEN '+' ELSE '' END", numtext_sql("growth"), note)
    once = "CAST(unique_users - CAST(floor(unique_users * repeat_rate / 100 + 0.5D) AS BIGINT) AS STRING)"
    items = [
        item(1, "contradiction", "CONTRADICTION", "'REVENUE_UP_VOLUME_DOWN'", rev, "'HIGH'", "true",
             "contradiction_detail", "contradiction_implication"),
        item(2, "skew_flag", "DISTORTION", "'SKEW_DISTORTION'", f"{rev} * 0.2D", "'HIGH'", "false", "skew_detail"),
        item(3, "outlier_distortion", "DISTORTION", "'OUTLIER_TOTAL_DISTORTION'",
             f"CASE WHEN outlier_difference <> 0 THEN outlier_difference ELSE {rev} * 0.2D END", "'HIGH'", "false",
             "outlier_detail"),
        item(4, "trend_concentrated", "DISTORTION", "'TREND_CONCENTRATION'", f"{rev} * 0.2D", "'HIGH'", "false",
             "trend_detail"),
        item(5, "dominant_category IS NOT NULL", "CONCENTRATION_RISK", "'CATEGORY_CONCENTRATION'",
             "coalesce(dominant_value, 0.0D) * 0.3D", "'HIGH'", "true", "dominance_detail"),
        item(6, "has_sufficient_for_trend AND growth IS NOT NULL AND abs(growth) > 5", "TREND",
             "CASE WHEN growth > 0 THEN 'GROWTH' ELSE 'DECLINE' END", f"abs({rev}) * (abs(growth) / 100)",
             "CASE WHEN trend_concentrated THEN 'LOW' ELSE 'MEDIUM' END", "abs(growth) > 15", growth),
        item(7, "repeat_rate IS NOT NULL AND unique_users IS NOT NULL AND repeat_rate < 30", "RETENTION",
             "'LOW_REPEAT_RATE'",
             "CASE WHEN revenue IS NOT NULL AND revenue <> 0 THEN revenue * ((30 - repeat_rate) / 100) ELSE 0.0D END",
             "'MEDIUM'", "true", filled(DETAIL["RETENTION"], numtext_sql("repeat_rate"), once)),
    ]
    rest = jm.selectExpr(*by, f"explode(array({', '.join(items)})) AS _f").where("_f.keep") \
        .selectExpr(*by, "_f.seq", "_f.type", "_f.subtype", "_f.magnitude", "_f.reliability", "_f.actionable",
                    "_f.detail", "_f.falsifiability", "_f.implication")
    u = a.unionByName(rest)
    urgency = ("CASE WHEN type = 'ANOMALY' AND reliability = 'HIGH' THEN 'HIGH' WHEN type = 'CONTRADICTION' THEN 'HIGH' "
               "WHEN type IN ('CONCENTRATION_RISK', 'RETENTION') THEN 'MEDIUM' "
               "WHEN type = 'TREND' AND subtype = 'DECLINE' THEN 'HIGH' ELSE 'LOW' END")
    u = u.selectExpr("*", f"{urgency} AS urgency")
    rel_w = " ".join(f"WHEN reliability = '{k}' THEN {v}D" for k, v in RELIABILITY_WEIGHT.items())
    urg_w = " ".join(f"WHEN urgency = '{k}' THEN {v}D" for k, v in URGENCY_WEIGHT.items())
    u = u.selectExpr("*", f"coalesce(magnitude, 0.0D) * (CASE {rel_w} ELSE 0.25D END) "
                          f"* (CASE {urg_w} ELSE 0.4D END) AS score")
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("seq"))
    return u.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select(*by, "rank", "type", "subtype", "magnitude", "reliability", "urgency", "score",
                "actionable", "detail", "falsifiability", "implication")


def confidence_grade(judged: DataFrame, anomaly_summary: DataFrame, roles: Roles,
                     by: Sequence[str] = ()) -> DataFrame:
    """100 minus penalties (rows, clean rate, missing roles, anomaly types per row,
    HIGH distortion, contradiction, concentrated trend), clamped; >= 75 HIGH, >= 45 MEDIUM."""
    by = list(by)
    j = attach(judged, anomaly_summary.select(*by, F.col("count").alias("_acount")), by, "left")
    n = F.col("rows")
    cr = F.col("clean_rate")
    dens = F.coalesce(F.col("_acount"), F.lit(0)) / F.greatest(n, F.lit(1))
    pen = (F.when(n < 10, 50).when(n < 30, 30).when(n < 100, 15).when(n < 500, 5).otherwise(0)
           + F.when(cr < 70, 40).when(cr < 85, 20).when(cr < 95, 8).otherwise(0)
           + F.lit(0 if roles.revenue else 20) + F.lit(0 if roles.date else 15)
           + F.when(dens > 0.2, 20).when(dens > 0.1, 10).otherwise(0)
           + F.when(F.col("skew_flag") | F.col("outlier_distortion") | F.col("trend_concentrated"), 15).otherwise(0)
           + F.when(F.col("contradiction"), 10).otherwise(0)
           + F.when(F.col("trend_concentrated"), 10).otherwise(0))
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.lit(100) - pen))
    return j.select(*by, score.alias("score"),
                    F.when(score >= 75, "HIGH").when(score >= 45, "MEDIUM").otherwise("LOW").alias("confidence"))
