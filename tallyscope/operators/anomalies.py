"""Anomaly detectors (A1-A9).  Each returns at most one row per group:
``*by, type, severity, value, impact``; :func:`anomaly_table` unions and ranks them.

Hot-key safety: the per-user and gap detectors aggregate into fixed-width time
buckets first and only run windows over the (much smaller) bucket series, so a
user holding a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_key, epoch_micros
from ..functions.display import inr_display, number_text
from ..functions.numbers import round_half_up
from ..model import AMOUNT, TS, USER, Roles
from ..texts import FALSIFIABILITY, REASON
from .common import attach
from .profile import Profile, Z, totals_of

SEVERITY_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
MINUTE_US = 60_000_000
DAY_US = 86_400_000_000


def _finding(g: DataFrame, by: Sequence[str], fires: Column, kind: str, severity: str, value: Column, impact: Column,
             *args: Column, type_: Column | None = None, check: Sequence[Column] = ()) -> DataFrame:
    """One row for every group that ``fires``; ``args`` fill the reason, ``check`` the way to check it."""
    text = FALSIFIABILITY[kind]
    return g.where(fires).select(*by, (F.lit(kind) if type_ is None else type_).alias("type"), F.lit(severity).alias("severity"),
                                 value.cast("double").alias("value"), impact.cast("double").alias("impact"),
                                 F.format_string(REASON[kind], *args).alias("reason"),
                                 (F.format_string(text, *check) if check else F.lit(text)).alias("falsifiability"))


def negative_values(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A1: rows with a negative amount or quantity; impact = |sum of their amounts|; HIGH."""
    return negative_of(totals_of(facts, by, ["negatives", "negative_sum"]), by)


def negative_of(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    n = F.col("negatives")
    return _finding(totals, by, n > 0, "NEGATIVE_VALUES", "HIGH", n, round_half_up(F.abs(F.col("negative_sum"))), n)


def zscore_outliers(facts: DataFrame, by: Sequence[str] = (), z: float = Z) -> DataFrame:
    """A2: at least 10 amounts, population sigma > 0, |z| > 3.5; impact = their sum; MEDIUM."""
    by = list(by)
    moments = totals_of(facts, by, ["amounts", "mean", "deviation"]).where((F.col("amounts") >= 10) & (F.col("deviation") > 0))
    j = attach(facts.select(*by, AMOUNT), moments, by, "inner")
    out = F.abs((F.col(AMOUNT) - F.col("mean")) / F.col("deviation")) > z
    return zscore_of(j.groupBy(*by).agg(F.count_if(out).alias("far"), F.sum(F.when(out, F.col(AMOUNT))).alias("far_sum")), by)


def zscore_of(tails: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    n = F.col("far")
    return _finding(tails, by, n > 0, "STATISTICAL_OUTLIER", "MEDIUM", n, round_half_up(F.col("far_sum")), n)


def iqr_outliers(facts: DataFrame, by: Sequence[str] = (), max_share: float = 0.05) -> DataFrame:
    """A3: IQR-flagged rows when 0 < count < 5 % of rows; impact = their sum; LOW."""
    return iqr_of(totals_of(facts, by, ["outliers", "rows", "outlier_sum"]), by, max_share)


def iqr_of(totals: DataFrame, by: Sequence[str] = (), max_share: float = 0.05) -> DataFrame:
    n = F.col("outliers")
    fires = (n > 0) & (n < F.col("rows") * max_share)
    return _finding(totals, by, fires, "IQR_OUTLIER", "LOW", n, round_half_up(F.col("outlier_sum")), n)


def daily_spike(facts: DataFrame, by: Sequence[str] = (), z: float = 2.5) -> DataFrame:
    """A4: >= 7 amounts and >= 5 days, sigma > 0: among days with |z| > 2.5 the one furthest
    from the daily mean (ties: earliest day); SPIKE above the mean, DROP below; MEDIUM."""
    by = list(by)
    dated = facts.where(F.col(TS).isNotNull()).withColumn("day", day_key(TS))
    return spike_of(totals_of(facts, by, ["amounts"]), totals_of(dated, [*by, "day"], ["amounts", "amount_sum"]), by, z)


def spike_of(totals: DataFrame, days: DataFrame, by: Sequence[str] = (), z: float = 2.5) -> DataFrame:
    by = list(by)
    daily = days.where(F.col("amounts") > 0).select(*by, "day", F.col("amount_sum").alias("v"))
    dstats = daily.groupBy(*by).agg(F.count("*").alias("_days"), F.avg("v").alias("_dm"),
                                    F.stddev_pop("v").alias("_ds"))
    dstats = attach(dstats, totals.select(*by, F.col("amounts").alias("_vals")), by, "left").where(
        (F.col("_vals") >= 7) & (F.col("_days") >= 5) & (F.col("_ds") > 0))
    j = attach(daily, dstats, by, "inner")
    dev = F.abs(F.col("v") - F.col("_dm"))
    cand = j.where(F.abs((F.col("v") - F.col("_dm")) / F.col("_ds")) > z)
    top = cand.groupBy(*by).agg(F.max(F.struct(dev.alias("dev"), F.negative(F.unix_date(F.to_date("day"))).alias("nd"),
                                               F.col("day"), F.col("v"), F.col("_dm"))).alias("t"))
    spike = F.col("t.v") > F.col("t._dm")
    return _finding(top, by, F.col("t").isNotNull(), "DAILY", "MEDIUM", round_half_up(F.col("t.v")),
                    round_half_up(F.col("t.dev")), F.col("t.day"), F.when(spike, "spike").otherwise("drop"),
                    inr_display(F.col("t.dev")), inr_display(F.col("t._dm")),
                    type_=F.when(spike, "REVENUE_SPIKE").otherwise("REVENUE_DROP"), check=[F.col("t.day")])


def rapid_pairs(facts: DataFrame, by: Sequence[str] = (), gap_seconds: float = 60.0) -> DataFrame:
    """Count consecutive same-user timestamps less than ``gap_seconds`` apart, per group.

    Times are compared in whole milliseconds (the reference's clock resolution).
    Rows go into fixed buckets of ``gap_seconds``: inside one bucket every
    consecutive gap is shorter than the bucket, so a bucket of c rows holds
    c - 1 pairs; across buckets only the first row of a bucket and the last row
    of the user's previous non-empty bucket can pair.  The only window runs over
    a user's non-empty buckets, never over raw rows.
    """
    by = list(by)
    width = int(gap_seconds * 1000)
    ms = F.floor(epoch_micros(TS) / 1000)
    b = facts.where(F.col(USER).isNotNull() & F.col(TS).isNotNull()) \
        .select(*by, USER, ms.alias("_ms")).withColumn("_b", F.floor(F.col("_ms") / width))
    buckets = b.groupBy(*by, USER, "_b").agg(F.count("*").alias("_c"), F.min("_ms").alias("_lo"),
                                             F.max("_ms").alias("_hi"))
    return pairs_of_buckets(buckets, by, width)


def pairs_of_buckets(buckets: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """Pairs of non-empty buckets (user, ``_b``, count ``_c``, first and last ms ``_lo``, ``_hi``)."""
    w = Window.partitionBy(*by, USER).orderBy("_b")
    prev_hi = F.lag("_hi").over(w)
    edge = F.when(prev_hi.isNotNull() & (F.col("_lo") - prev_hi < width), 1).otherwise(0)
    per = buckets.select(*by, (F.col("_c") - 1 + edge).alias("_p"))
    return per.groupBy(*by).agg(F.sum("_p").alias("pairs"))


def rapid_repeat(facts: DataFrame, roles: Roles, by: Sequence[str] = ()) -> DataFrame:
    """A5: same-user pairs under 60 s apart; HIGH, impact 0."""
    if not (roles.user and roles.date):
        return _empty(facts, by)
    n = F.col("pairs")
    return _finding(rapid_pairs(facts, by), by, n > 0, "SUSPICIOUS_FREQUENCY", "HIGH", n, F.lit(0.0), n)


def zero_value_share(facts: DataFrame, by: Sequence[str] = (), max_share: float = 0.05) -> DataFrame:
    """amount == 0 in more than 5 % of rows; LOW."""
    return zero_of(totals_of(facts, by, ["zeros", "rows"]), by, max_share)


def zero_of(totals: DataFrame, by: Sequence[str] = (), max_share: float = 0.05) -> DataFrame:
    n = F.col("zeros")
    share = F.when(F.col("rows") > 0, n / F.col("rows") * 100)
    return _finding(totals.withColumn("_share", share), by, n > F.col("rows") * max_share, "ZERO_VALUE_TRANSACTIONS", "LOW", n,
                    F.lit(0.0), n, number_text(F.col("_share")))


def signature_key(roles: Roles) -> Column:
    """(user, amount, day) with a user role, else (amount, minute); missing parts are kept as tokens."""
    amt = F.coalesce(F.col(AMOUNT).cast("string"), F.lit("null"))
    if roles.user:
        return F.concat_ws("|", F.coalesce(F.col(USER), F.lit("")), amt,
                           F.coalesce(day_key(TS), F.lit("undefined")))
    return F.concat_ws("|", amt, F.coalesce(F.date_format(TS, "yyyy-MM-dd'T'HH:mm"), F.lit("undefined")))


def duplicate_signature(facts: DataFrame, roles: Roles, by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first with the same signature; MEDIUM, impact 0."""
    by = list(by)
    per_key = facts.groupBy(*by, signature_key(roles).alias("_k")).agg(F.count("*").alias("_c"))
    n = F.col("_d")
    return _finding(per_key.groupBy(*by).agg(F.sum(F.col("_c") - 1).alias("_d")), by, n > 0, "DUPLICATE_TRANSACTIONS", "MEDIUM",
                    n, F.lit(0.0), n)


def largest_gap(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest gap between consecutive timestamps that spans a UTC day boundary, plus span and rows."""
    dated = facts.where(F.col(TS).isNotNull()).withColumn("day", day_key(TS))
    return gap_of(totals_of(facts, by, ["rows"]), totals_of(dated, [*by, "day"], ["first_us", "last_us"]), by)


def gap_of(totals: DataFrame, days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The gap from each day's first row to the previous non-empty day's last row.  Any gap longer than a
    day crosses midnight, so the result is exact whenever the largest gap exceeds one day."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy("day")
    gaps = days.withColumn("_gap", F.col("first_us") - F.lag("last_us").over(w))
    g = gaps.groupBy(*by).agg(F.max("_gap").alias("max_gap_us"), F.min("first_us").alias("_first"),
                              F.max("last_us").alias("_last"))
    g = attach(totals.select(*by, "rows"), g, by, "left")
    return g.select(*by, "rows", "max_gap_us", (F.col("_last") - F.col("_first")).alias("span_us"))


def data_gap(facts: DataFrame, roles: Roles, by: Sequence[str] = (), min_gap_days: float = 3.0,
             ratio: float = 10.0) -> DataFrame:
    """More than 10 rows; largest gap > 3 days and > 10 x (span / rows); value in days (1 dp); LOW."""
    if not roles.date:
        return _empty(facts, by)
    return gap_finding(largest_gap(facts, by), by, min_gap_days, ratio)


def gap_finding(g: DataFrame, by: Sequence[str] = (), min_gap_days: float = 3.0, ratio: float = 10.0) -> DataFrame:
    gap = F.col("max_gap_us")
    fires = (F.col("rows") > 10) & (gap > F.lit(min_gap_days * DAY_US)) & \
        (gap > F.col("span_us") / F.col("rows") * ratio)
    days = round_half_up(gap / F.lit(float(DAY_US)), 1)
    return _finding(g.withColumn("_days", days), by, F.coalesce(fires, F.lit(False)), "DATA_GAP", "LOW", F.col("_days"),
                    F.lit(0.0), number_text(F.col("_days"), 1))


def _empty(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    return facts.select(*by, F.lit("").alias("type"), F.lit("").alias("severity"), F.lit(0.0).alias("value"),
                        F.lit(0.0).alias("impact"), F.lit("").alias("reason"), F.lit("").alias("falsifiability")).limit(0)


def _listed(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].withColumn("seq", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("seq", F.lit(i)))
    return out


def all_detectors(facts: DataFrame, roles: Roles, by: Sequence[str] = ()) -> DataFrame:
    """A1-A8 as one long frame, in detector order (``seq``), each by scans of its own."""
    by = list(by)
    parts = [negative_values(facts, by)]
    if roles.revenue:
        parts.append(zscore_outliers(facts, by))
    parts.append(iqr_outliers(facts, by))
    if roles.date and roles.revenue:
        parts.append(daily_spike(facts, by))
    return _listed(parts + [rapid_repeat(facts, roles, by), zero_value_share(facts, by),
                            duplicate_signature(facts, roles, by), data_gap(facts, roles, by)])


def detectors_of(profile: Profile, tails: DataFrame | None) -> DataFrame:
    """A1-A8 from the shared profile: only rapid repeats and duplicate signatures read the facts again."""
    by, roles, totals = profile.by, profile.roles, profile.totals
    parts = [negative_of(totals, by)]
    if tails is not None:
        parts.append(zscore_of(tails, by))
    parts.append(iqr_of(totals, by))
    if roles.date and roles.revenue:
        parts.append(spike_of(totals, profile.days, by))
    parts += [rapid_repeat(profile.facts, roles, by), zero_of(totals, by), duplicate_signature(profile.facts, roles, by)]
    if roles.date:
        parts.append(gap_finding(gap_of(totals, profile.days, by), by))
    return _listed(parts)


def severity_rank(c: Column) -> Column:
    return F.when(c == "HIGH", 0).when(c == "MEDIUM", 1).otherwise(2)


def anomaly_table(detected: DataFrame, by: Sequence[str] = (), k: int = 15) -> tuple[DataFrame, DataFrame]:
    """Order by severity (HIGH, MEDIUM, LOW) then impact desc, keep the top 15;
    summary per group: count (all), high_count, total_impact (2 dp)."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(severity_rank(F.col("severity")), F.col("impact").desc(), F.col("seq"))
    ranked = detected.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    summary = detected.groupBy(*by).agg(F.count("*").alias("count"),
                                        F.count_if(F.col("severity") == "HIGH").alias("high_count"),
                                        round_half_up(F.sum("impact")).alias("total_impact"))
    return ranked, summary
