"""Reporting tables (F3, F4, F6): KPI rows, chart series, narrative audit.

Long tables instead of rendered text: one row per KPI / chart point / narrative,
so any number of groups or reports are produced by one job.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import inr_display, number_text  # noqa: F401
from ..functions.sqlfns import inr_sql, numtext_sql
from ..functions.numbers import round_half_up
from .common import attach

KPI_COLS = ["section", "seq", "label", "value", "display", "direction"]


def _item(section: str, seq: int, label: str, value: str, shown: str = "inr", direction: str = "'neutral'",
          keep: str | None = None) -> str:
    """One KPI row as SQL text: a struct with how it is ``shown`` and a ``keep`` condition."""
    return (f"named_struct('section', '{section}', 'seq', {seq}, 'label', '{label}', "
            f"'value', CAST(({value}) AS DOUBLE), 'shown', '{shown}', 'direction', {direction}, "
            f"'keep', coalesce({keep or f'({value}) IS NOT NULL'}, false))")


# Labels of the skewness and of the clean rate.
_SKEW_LABEL = ("CASE WHEN abs(value) < 0.5 THEN 'approximately normal' WHEN value > 0 "
               "THEN 'right-skewed — outliers pulling mean up' ELSE 'left-skewed' END")
_QUALITY_LABEL = "CASE WHEN value >= 95 THEN 'CLEAN ✓' WHEN value >= 85 THEN 'MINOR ISSUES' ELSE 'NEEDS ATTENTION' END"
# one text of the value for whatever is shown: every formula stands in the plan once
_DISPLAY = (f"CASE shown WHEN 'inr' THEN {inr_sql('value')} WHEN 'count' THEN CAST(CAST(value AS BIGINT) AS STRING) "
            f"WHEN 'percent' THEN concat({numtext_sql('value')}, '%') "
            f"WHEN 'skew' THEN concat({numtext_sql('value', 3)}, ' (', {_SKEW_LABEL}, ')') "
            f"WHEN 'quality' THEN {_QUALITY_LABEL} END")


def kpi_table(metrics: DataFrame, stats: DataFrame | None = None, categories: DataFrame | None = None,
              quality: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """KPI cards (revenue, transactions, AOV, WoW with up/down, median), distribution rows
    (mean, median, std, min, max, range, p25, p75, IQR, skew), category shares and the
    quality label.  ``metrics`` columns: revenue, orders, aov, growth, median_order.

    The one-row-per-group inputs are combined once, every KPI row comes out of a single ``explode`` of an
    array of structs as a number, and one display column formats them all; only the category rows are a
    second branch."""
    by = list(by)
    row = metrics.select(*by, "revenue", "orders", "aov", "growth", "median_order")
    known = "revenue IS NOT NULL"
    items = [
        _item("kpi", 1, "Total Revenue", "revenue"),
        _item("kpi", 2, "Transactions", "orders", "count", keep=known),
        _item("kpi", 3, "Avg Order Value", "aov", keep=known),
        _item("kpi", 4, "WoW Growth", "growth", "percent", "CASE WHEN growth >= 0 THEN 'up' ELSE 'down' END",
              keep=f"{known} AND growth IS NOT NULL"),
        _item("kpi", 5, "Median Order", "median_order", keep=f"{known} AND median_order IS NOT NULL"),
    ]
    if stats is not None:
        cols = ["mean", "median", "std", "min", "max", "p25", "p75", "skew"]
        row = attach(row, stats.select(*by, *[F.col(c).alias(f"_s_{c}") for c in cols]), by, "left")
        dist = [("Mean", "_s_mean"), ("Median", "_s_median"), ("Std Dev", "_s_std"), ("Min", "_s_min"),
                ("Max", "_s_max"), ("Range", "_s_max - _s_min"), ("P25", "_s_p25"), ("P75", "_s_p75"),
                ("IQR", "_s_p75 - _s_p25")]
        items += [_item("distribution", i + 1, label, v) for i, (label, v) in enumerate(dist)]
        items.append(_item("distribution", 10, "Skewness", "_s_skew", "skew"))
    if quality is not None:
        row = attach(row, quality.select(*by, F.col("clean_rate").alias("_q_cr")), by, "left")
        items.append(_item("quality", 1, "Data quality verdict", "_q_cr", "quality"))
    out = row.selectExpr(*by, f"explode(array({', '.join(items)})) AS _k").where("_k.keep") \
        .selectExpr(*by, "_k.section", "_k.seq", "_k.label", "_k.value", "_k.shown", "_k.direction", "'' AS _more")
    if categories is not None:
        # shares are of the whole breakdown (up to 12 categories); the first 10 are listed
        tot = categories.groupBy(*by).agg(F.sum("val").alias("_tot"))
        c = attach(categories.where(F.col("rank") <= 10), tot, by, "left")
        pct = "CASE WHEN _tot > 0 THEN val / _tot * 100 ELSE 0.0D END"
        out = out.unionByName(c.selectExpr(
            *by, "'category' AS section", "CAST(rank AS INT) AS seq", "name AS label", "CAST(val AS DOUBLE) AS value",
            "'inr' AS shown", "'neutral' AS direction",
            f"concat(' (', {numtext_sql(pct)}, '% share, ', CAST(count AS STRING), ' transactions)') AS _more"))
    return out.selectExpr(*by, "section", "seq", "label", "value", f"concat({_DISPLAY}, _more) AS display", "direction")


def chart_series(categories: DataFrame | None, monthly: DataFrame | None, by: Sequence[str] = ()) -> DataFrame:
    """bar (top 8 categories), pie (same points, only with >= 3 categories) and line (first
    12 months, only with >= 2 months); names cut to 20 characters."""
    by = list(by)
    parts = []
    if categories is not None:
        top = categories.where(F.col("rank") <= 8)
        pt = lambda seq: F.col(seq).cast("int")
        full = F.coalesce(F.col("name"), F.lit("Other"))
        name = F.substring(full, 1, 20)
        # the tag text escapes quotes first and then cuts to 20 characters
        tag = F.substring(F.regexp_replace(full, '"', '\\\\"'), 1, 20)
        parts.append(top.select(*by, F.lit("bar").alias("chart"), pt("rank").alias("seq"), name.alias("name"),
                                tag.alias("tag_name"), round_half_up(F.col("val")).alias("val")))
        n = categories.groupBy(*by).agg(F.count("*").alias("_n"))
        pie = attach(top, n, by, "left").where(F.col("_n") >= 3)
        parts.append(pie.select(*by, F.lit("pie").alias("chart"), pt("rank").alias("seq"), name.alias("name"),
                                tag.alias("tag_name"), round_half_up(F.col("val")).alias("val")))
    if monthly is not None:
        w = Window.partitionBy(*by).orderBy("month")
        m = monthly.withColumn("_seq", F.row_number().over(w)) \
            .withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
        m = m.where((F.col("_seq") <= 12) & (F.col("_n") >= 2))
        month = F.coalesce(F.col("month"), F.lit(""))
        parts.append(m.select(*by, F.lit("line").alias("chart"), F.col("_seq").alias("seq"), month.alias("name"),
                              F.regexp_replace(month, '"', '\\\\"').alias("tag_name"),
                              round_half_up(F.col("val")).alias("val")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chart_tags(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F4 as the ``[CHART:kind|title|[points]]`` tags, one row per chart.  Points are
    ``{"name":"...","val":N}`` with quotes in names escaped and values printed as plain
    numbers (``1234``, ``1234.5``), in series order."""
    titles = {"bar": "Revenue by Category", "pie": "Category Distribution", "line": "Revenue Trend"}
    title = F.when(F.col("chart") == "bar", titles["bar"]).when(F.col("chart") == "pie", titles["pie"]) \
        .otherwise(titles["line"])
    point = F.concat(F.lit('{"name":"'), F.col("tag_name"), F.lit('","val":'),
                     number_text(F.col("val")), F.lit("}"))
    pts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", point.alias("p")))),
                                   lambda x: x["p"]), ",")
    g = series.groupBy(*by, "chart").agg(pts.alias("_p"))
    return g.select(*by, "chart", F.concat(F.lit("[CHART:"), F.col("chart"), F.lit("|"), title, F.lit("|["),
                                           F.col("_p"), F.lit("]]")).alias("tag"))


# Phrases blanked to the end of their line, a whole chart tag, the opening of one.
SUPPRESS = "(?i)(recommendation|action|next step|should)[^\\n]*"
CHART_TAG = "\\[CHART:[^\\]]+\\]"
CHART_OPENING = "\\[CHART:"


def audit_narratives(reports: DataFrame, text_col: str = "text", tier_col: str = "analysis_tier",
                     revenue_col: str = "revenue", orders_col: str = "orders", growth_col: str = "growth",
                     blocked_col: str = "quality_blocks_analysis", max_charts: int = 4) -> DataFrame:
    """audit generated texts against their metrics (one row per text).

    Flags a missing verdict (longer than 200 characters without 'VERDICT' or '◆'); for
    FACTS_ONLY blanks recommendation-like phrases to the end of the line; with more than four
    chart openings keeps the first four whole chart tags; prepends KPI tags when there are none,
    revenue is known and the analysis is not blocked.  An empty text stays empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    missing_verdict = ~t.contains("VERDICT") & ~t.contains("◆") & (F.length(t) > 200)
    facts_only = F.col(tier_col) == "FACTS_ONLY"
    suppressed = F.when(facts_only, F.regexp_count(t, F.lit(SUPPRESS))).otherwise(F.lit(0))
    t1 = F.when(facts_only, F.regexp_replace(t, SUPPRESS, "")).otherwise(t)
    charts = F.regexp_count(t1, F.lit(CHART_OPENING))
    # keep the first four tags: split on tags, re-join the pieces with the kept tags only
    pieces = F.split(t1, CHART_TAG, -1)
    tags = F.regexp_extract_all(t1, F.lit(f"({CHART_TAG})"), 1)
    kept = F.transform(tags, lambda x, i: F.when(i < max_charts, x).otherwise(F.lit("")))
    joined = F.concat(F.array_join(F.zip_with(pieces, F.concat(kept, F.array(F.lit(""))),
                                              lambda p, k: F.concat(p, F.coalesce(k, F.lit("")))), ""))
    t2 = F.when(charts > max_charts, joined).otherwise(t1)
    rev, orders, g = F.col(revenue_col), F.col(orders_col), F.col(growth_col)
    kpi_block = F.concat_ws("\n",
                            F.when(rev.isNotNull(), F.concat(F.lit("[KPI:Revenue|"), inr_display(rev), F.lit("||neutral]"))),
                            F.when(orders.isNotNull() & (orders != 0),
                                   F.concat(F.lit("[KPI:Transactions|"), orders.cast("string"), F.lit("||neutral]"))),
                            F.when(g.isNotNull(), F.concat(F.lit("[KPI:WoW Growth|"), number_text(g), F.lit("%||"),
                                                           F.when(g >= 0, "up").otherwise("down"), F.lit("]"))))
    inject = (F.regexp_count(t2, F.lit("\\[KPI:")) == 0) & rev.isNotNull() & ~F.coalesce(F.col(blocked_col), F.lit(False)) & (t != "")
    t3 = F.when(inject, F.concat(kpi_block, F.lit("\n\n"), t2)).otherwise(t2)
    return reports.select("*", missing_verdict.alias("missing_verdict"), suppressed.alias("suppressed"),
                          charts.alias("charts_found"),
                          F.when(charts > max_charts, F.least(F.size(tags), F.lit(max_charts))).otherwise(F.size(tags)).alias("charts_kept"),
                          inject.alias("kpi_injected"), t3.alias("validated_text"))


def audit_reports(reports: DataFrame, judged: DataFrame, metrics: DataFrame, by: Sequence[str] = (),
                  text_col: str = "text") -> DataFrame:
    """F6 for many reports: each meets the judgment and the metrics of its own group (an equi join on the keys;
    every report meets the one row there is without keys)."""
    by = list(by)
    state = attach(judged.select(*by, "analysis_tier", "quality_blocks_analysis"),
                   metrics.select(*by, "revenue", "orders", "growth"), by, "left")
    return audit_narratives(attach(reports, state, by, "left"), text_col)
