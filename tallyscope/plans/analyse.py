"""the whole battery as one set of lazy DataFrames.

roles -> clean -> judge -> metrics -> anomalies -> cohorts -> confidence -> findings.
Permission gates are semi-joins against the judgment frame, so the same plan
serves one dataset (``by=()``) or many tenants at once.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Sequence

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import AMOUNT, CATEGORY, PRODUCT, Roles
from ..operators.stats import describe_measure
from ..operators import anomalies as A
from ..operators import metrics as M
from ..operators.clean import build_facts
from ..operators.cohorts import cohort_retention
from ..operators.common import Facts, attach
from ..operators.findings import confidence_grade, ranked_findings
from ..operators.judge import judgment
from ..operators.profile import build_profile
from ..operators.roles import detect_roles
from ..session import ensure_checkpoint_dir
from ..session import land as land_table


def gate(df: DataFrame, judged: DataFrame, flag: Column, by: Sequence[str]) -> DataFrame:
    """Keep the rows of groups whose judgment ``flag`` is true."""
    by = list(by)
    ok = judged.where(flag).select(*by) if by else judged.where(flag).select(F.lit(1).alias("_ok"))
    if by:
        return attach(df, ok.withColumn("_ok", F.lit(1)), by, "inner").drop("_ok")
    return df.crossJoin(F.broadcast(ok)).drop("_ok")   # one row or none


OUTPUTS = ("quality", "judgment", "metrics", "anomalies", "anomaly_summary", "confidence", "findings",
           "facts", "daily_trend", "monthly_trend", "weekday_profile", "forecast", "categories", "products",
           "cohorts")


def analyse(df: DataFrame, roles: Roles | None = None, by: Sequence[str] = (), as_of=None,
            accuracy: int | None = None, land: bool = True, facts: Facts | None = None,
            outputs: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Run the battery.  With ``land`` the fact table (read by ~30 jobs) and the small
    per-group frames that fan out are written once as Parquet tables into the
    cluster's shared checkpoint folder: lineage is cut, plans stay small, and a lost
    executor does not force the dedup/quartile stages to rerun.

    ``outputs`` names the result tables wanted (default: all of ``OUTPUTS``); only they
    and what they depend on are built.  Outputs that do not apply (e.g. cohorts without
    a user role) are absent from the result."""
    by = list(by)
    if facts is None:
        roles = roles or detect_roles(df)
    cut = (lambda d: land_table(d, "analysis")) if land else (lambda d: d)
    if facts is None:
        facts = build_facts(df, roles, by, as_of, accuracy=accuracy, land=land)
    roles, by = facts.roles, list(facts.by)
    f = facts.df
    has_amt = bool(roles.revenue)
    not_blocked = ~F.col("quality_blocks_analysis")
    memo: dict[str, DataFrame | None] = {}

    def get(name: str) -> DataFrame | None:
        if name not in memo:
            memo[name] = build[name]()
        return memo[name]

    def stats():
        # one exact describe of the amounts feeds both the judgment and the headline
        return cut(describe_measure(f, AMOUNT, by, accuracy)) if has_amt else None

    def tails():
        return get("_profile").tails(get("stats")) if has_amt else None

    def metrics():
        total = get("_profile").totals
        null = F.lit(None).cast("double")
        if has_amt:
            head = M.headline_of(total, get("stats"), by)
        else:
            head = total.select(*by, null.alias("revenue"), F.col("rows").alias("orders"), null.alias("aov"),
                                null.alias("median_order"))
        m = attach(head, M.without_outliers_of(total, by), by, "left")
        daily = get("daily_trend")
        if daily is not None:
            m = attach(attach(m, M.week_over_week(daily, by).select(*by, "growth"), by, "left"),
                       M.annualised_growth(daily, by).select(*by, "cagr"), by, "left")
        else:
            m = m.withColumn("growth", null).withColumn("cagr", null)
        judged = get("judgment")
        users = get("_users")
        if users is not None:
            m = attach(m, gate(M.customers_of(users, by), judged, F.col("can_show_user_analysis"), by), by, "left")
        else:
            m = m.withColumn("unique_users", F.lit(None).cast("long")).withColumn("repeat_rate", null)
        if users is not None and has_amt:
            pareto = gate(M.pareto_of(users, by, accuracy=accuracy), judged, F.col("can_show_user_analysis"), by)
            m = attach(m, pareto.select(*by, F.col("top_share").alias("pareto_concentration")), by, "left")
        else:
            m = m.withColumn("pareto_concentration", null)
        return cut(m)

    def anomaly_parts():
        return A.anomaly_table(cut(A.detectors_of(get("_profile"), get("_tails"))), by)

    wanted = set(outputs or OUTPUTS)
    build = {
        "facts": lambda: f,
        "quality": lambda: facts.quality,
        "stats": stats,
        # the shared scans: all grouping sets at once, the tails, the users
        "_profile": lambda: build_profile(facts, "products" in wanted, cut),
        "_tails": tails,
        "_users": lambda: cut(M.user_totals(f, by)) if roles.user else None,
        "judgment": lambda: cut(judgment(facts, accuracy, get("stats"), get("_profile"), get("_tails"), cut)),
        "daily_trend": lambda: M.daily_of(get("_profile").days, by, has_amt) if roles.date else None,
        "monthly_trend": lambda: M.monthly_of(get("_profile").days, by, has_amt) if roles.date else None,
        "weekday_profile": lambda: M.weekdays_of(get("_profile").days, by, has_amt) if roles.date else None,
        "forecast": lambda: gate(M.linear_forecast(get("daily_trend"), by), get("judgment"),
                                 F.col("can_forecast"), by) if roles.date else None,
        "categories": lambda: gate(M.top_of(get("_profile").categories, CATEGORY, by, 12, "count"), get("judgment"),
                                   F.col("can_show_categories") & not_blocked, by) if roles.category else None,
        "products": lambda: M.top_of(get("_profile").products, PRODUCT, by, 10, "orders") if roles.product else None,
        "cohorts": lambda: cohort_retention(f, by) if roles.user and roles.date else None,
        "metrics": metrics,
        "_anomaly_parts": anomaly_parts,
        "anomalies": lambda: get("_anomaly_parts")[0],
        "anomaly_summary": lambda: get("_anomaly_parts")[1],
        "confidence": lambda: confidence_grade(get("judgment"), get("anomaly_summary"), roles, by),
        "findings": lambda: ranked_findings(get("anomalies"), get("judgment"), get("metrics"), by),
    }
    if land and wanted - {"facts", "quality"}:
        # scans that do not wait for each other run side by side
        first = {"daily_trend", "monthly_trend", "weekday_profile", "products"}
        ahead = ["_profile"] + (["stats", "_users"] if wanted - {"facts", "quality", "cohorts"} - first else [])
        with ThreadPoolExecutor(len(ahead)) as pool:
            for name, got in zip(ahead, pool.map(inheritable_thread_target(f.sparkSession)(lambda n: build[n]()), ahead)):
                memo[name] = got
    out = {}
    for name in (outputs or OUTPUTS):
        v = get(name)
        if v is not None:
            out[name] = v
    return out
