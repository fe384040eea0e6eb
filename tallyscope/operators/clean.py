"""Cleaning (C1-C9): de-duplicate, type, filter and flag the rows of a business table.

The result is a :class:`Facts` bundle: a lazy fact DataFrame in the standard
column layout and a one-row-per-group data-quality record.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import to_timestamp_col, with_parsed_timestamp
from ..functions.numbers import finite_or_null, round_half_up, with_parsed_amount
from ..model import AMOUNT, CATEGORY, IQR_LOWER, IQR_UPPER, OUTLIER, PRODUCT, QTY, TS, USER, Roles
from ..session import ensure_checkpoint_dir
from ..session import land as land_table
from .common import Facts, attach
from .order_stats import disc, order_statistics


def js_number_text(c: Column) -> Column:
    """Text of a double as a browser prints it for the common cases (12000, 1.5)."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e18), c.cast("long").cast("string")) \
        .otherwise(c.cast("string"))


def _nonempty(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s != "", s)


NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")
TIME = ("timestamp", "timestamp_ntz", "date")


def typed_rows(df: DataFrame, roles: Roles, by: Sequence[str] = (), as_of=None,
               dedup: bool = True) -> DataFrame:
    """Distinct source rows (with their multiplicity ``_mult``) and typed role columns.

    Typed sources (numbers, timestamps) are cast; text sources go through the staged
    parsers so each parse runs once per row."""
    dtypes = dict(df.dtypes)
    by = list(by)
    if dedup:
        d = df.groupBy(*df.columns).agg(F.count("*").alias("_mult"))
    else:
        d = df.withColumn("_mult", F.lit(1).cast("long"))
    null_d = F.lit(None).cast("double")

    def numeric(role, out):
        nonlocal d
        if not role:
            return null_d.alias(out)
        t = dtypes[role]
        if t in NUMERIC or t.startswith("decimal"):
            return finite_or_null(F.col(role)).alias(out)
        d = with_parsed_amount(d, role, out)
        return F.col(out)

    amount = numeric(roles.revenue, AMOUNT)
    qty = numeric(roles.quantity, QTY)
    if not roles.date:
        ts = F.lit(None).cast("timestamp").alias(TS)
    elif dtypes[roles.date] in TIME:
        ts = to_timestamp_col(roles.date, dtypes[roles.date], as_of).alias(TS)
    else:
        d = with_parsed_timestamp(d, roles.date, TS, as_of)
        ts = F.col(TS)
    cols = [F.col(k) for k in by] + [
        amount, ts, qty,
        (_nonempty(F.col(roles.user)) if roles.user else F.lit(None).cast("string")).alias(USER),
        (F.col(roles.category).cast("string") if roles.category else F.lit(None).cast("string")).alias(CATEGORY),
        (F.col(roles.product).cast("string") if roles.product else F.lit(None).cast("string")).alias(PRODUCT),
        F.col("_mult"),
    ]
    return d.select(*cols)


def keep_rows(roles: Roles) -> Column:
    """C4 + C5: drop rows without an amount (if that role exists), then without a date."""
    cond = F.lit(True)
    if roles.revenue:
        cond = cond & F.col(AMOUNT).isNotNull()
    if roles.date:
        cond = cond & F.col(TS).isNotNull()
    return cond


def iqr_bounds(facts_df: DataFrame, by: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """C7 quartiles as order statistics ``sorted[floor(n/4)]``, ``sorted[floor(3n/4)]``; n >= 4."""
    q = order_statistics(facts_df, AMOUNT, by, [disc("q1", 0.25), disc("q3", 0.75)], accuracy)
    iqr = F.col("q3") - F.col("q1")
    ok = F.col("n") >= 4
    return q.select(*by, F.col("n").alias("_iqr_n"), F.when(ok, F.col("q1")).alias("q1"),
                    F.when(ok, F.col("q3")).alias("q3"),
                    F.when(ok, F.col("q1") - 1.5 * iqr).alias(IQR_LOWER),
                    F.when(ok, F.col("q3") + 1.5 * iqr).alias(IQR_UPPER))


def flag_outliers(rows: DataFrame, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    j = attach(rows, bounds.select(*by, IQR_LOWER, IQR_UPPER), by, "left")
    a = F.col(AMOUNT)
    flag = F.coalesce(a.isNotNull() & ((a < F.col(IQR_LOWER)) | (a > F.col(IQR_UPPER))), F.lit(False))
    return j.withColumn(OUTLIER, flag)


def build_facts(df: DataFrame, roles: Roles, by: Sequence[str] = (), as_of=None,
                dedup: bool = True, accuracy: int | None = None, land: bool = False) -> Facts:
    """C1-C9 in the reference's order: dedup, amount, date, quantity, IQR flag, diversity, report.

    With ``land`` the de-duplicated typed rows and the final fact table are each written
    once as Parquet into the shared checkpoint folder (``session.land``): the full-row dedup
    shuffle then runs once instead of once per reader (quartile passes, flag join,
    quality counts, every downstream job), and lineage stays short.
    """
    by = tuple(by)
    typed = typed_rows(df, roles, by, as_of, dedup)
    if land:
        ensure_checkpoint_dir(df.sparkSession)
        typed = land_table(typed, "typed")
    keep = keep_rows(roles)
    facts = typed.where(keep).drop("_mult")
    if roles.revenue:
        bounds = iqr_bounds(facts, by, accuracy)
        if land and by:
            # a size that is known when the join is planned: a few groups are broadcast, the rows are not dealt by group
            bounds = land_table(bounds, "bounds")
        facts = flag_outliers(facts, bounds, by)
    else:
        facts = facts.withColumn(IQR_LOWER, F.lit(None).cast("double")) \
            .withColumn(IQR_UPPER, F.lit(None).cast("double")).withColumn(OUTLIER, F.lit(False))
    if land:
        facts = land_table(facts, "facts")

    def quality() -> DataFrame:
        report = quality_report(typed, facts, roles, by)  # one row a group; reads typed rows and facts once more
        return land_table(report, "quality") if land else report

    return Facts(facts, quality, roles, by)


def quality_report(typed: DataFrame, facts: DataFrame, roles: Roles, by: Sequence[str]) -> DataFrame:
    """C8 + C9: rows before/after, clean rate (2 dp, 100 if empty) and the ordered issue list."""
    by = list(by)
    amount_missing = F.col(AMOUNT).isNull() if roles.revenue else F.lit(False)
    date_missing = (~amount_missing) & F.col(TS).isNull() if roles.date else F.lit(False)
    counts = typed.groupBy(*by).agg(
        F.coalesce(F.sum("_mult"), F.lit(0)).alias("rows_before"),
        F.count("*").alias("rows_distinct"),
        F.count_if(amount_missing).alias("amount_dropped"),
        F.count_if(date_missing).alias("date_dropped"))
    fact_aggs = facts.groupBy(*by).agg(
        F.count_if(F.col(OUTLIER)).alias("iqr_outliers"),
        F.count(AMOUNT).alias("amount_values"),
        F.count_distinct(AMOUNT).alias("distinct_amounts"),
        F.min(AMOUNT).alias("_any_amount"))
    q = attach(counts, fact_aggs, by, "left") if by else counts.crossJoin(fact_aggs)
    for c in ("iqr_outliers", "amount_values", "distinct_amounts"):
        q = q.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    q = q.withColumn("duplicates_removed", F.col("rows_before") - F.col("rows_distinct")) \
        .withColumn("rows_after", F.col("rows_distinct") - F.col("amount_dropped") - F.col("date_dropped"))
    q = q.withColumn("clean_rate", F.when(F.col("rows_before") > 0, round_half_up(
        F.col("rows_after") / F.col("rows_before") * 100)).otherwise(F.lit(100.0)))
    rev_name = roles.revenue or ""
    has_rev = F.lit(bool(roles.revenue))
    diversity = F.when(has_rev & (F.col("rows_after") >= 5) & (F.col("distinct_amounts") == 1),
                       F.format_string("WARNING: All %d revenue values are identical (%s) — possible template or test data",
                                       F.col("amount_values"), js_number_text(F.col("_any_amount")))) \
        .when(has_rev & (F.col("rows_after") >= 5) & (F.col("distinct_amounts") < F.col("amount_values") * 0.05),
              F.format_string("WARNING: Revenue has only %d unique values across %d rows — data may be aggregated or artificial",
                              F.col("distinct_amounts"), F.col("amount_values")))
    issues = F.array_compact(F.array(
        F.when(F.col("duplicates_removed") > 0,
               F.format_string("Removed %d exact duplicate rows", F.col("duplicates_removed"))),
        F.when(F.col("amount_dropped") > 0,
               F.format_string("Dropped %d rows with unparseable %s", F.col("amount_dropped"), F.lit(rev_name))),
        F.when(F.col("date_dropped") > 0,
               F.format_string("Dropped %d rows with invalid or future dates", F.col("date_dropped"))),
        F.when(F.col("iqr_outliers") > 0,
               F.format_string("Flagged %d IQR outliers (retained for analysis)", F.col("iqr_outliers"))),
        diversity))
    return q.select(*by, "rows_before", "duplicates_removed", "amount_dropped", "date_dropped",
                    "rows_after", "clean_rate", "iqr_outliers", "distinct_amounts",
                    issues.alias("issues"))
