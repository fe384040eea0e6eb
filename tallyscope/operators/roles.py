"""Column roles and dataset profiling.

R1 and R3 run as table jobs over a column catalogue ``(table, ordinal, name)``,
so the roles of any number of tables are inferred in one pass; the alias
vocabulary is a fixed ~140-row dimension and is broadcast.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import parse_amount
from ..functions.text import intent_flags, intent_primary
from ..model import COLUMN_ALIASES, DOMAIN_KEYWORDS, Roles


def normalize_header(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_")


def alias_dimension(spark: SparkSession) -> DataFrame:
    rows = [(ri, role, ai, alias) for ri, (role, aliases) in enumerate(COLUMN_ALIASES.items())
            for ai, alias in enumerate(aliases)]
    return spark.createDataFrame(rows, "role_ord int, role string, alias_ord int, alias string")


def alias_matches(h: Column, a: Column) -> Column:
    """Header equals the alias, starts with ``alias_``, ends with ``_alias``, or (alias longer
    than 4 characters) contains it."""
    return (h == a) | h.startswith(F.concat(a, F.lit("_"))) | h.endswith(F.concat(F.lit("_"), a)) | \
        ((F.length(a) > 4) & h.contains(a))


def catalogue(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Column catalogue of the given DataFrames (schema metadata only)."""
    rows = [(t, i + 1, c) for t, df in tables.items() for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "table string, ordinal int, name string")


def infer_roles(columns: DataFrame) -> DataFrame:
    """``(table, role, column)`` -- per role the first header (in column order) that matches
    any alias; one header may fill several roles."""
    dim = alias_dimension(columns.sparkSession)
    h = normalize_header(F.col("name"))
    j = columns.crossJoin(F.broadcast(dim)).where(alias_matches(h, F.col("alias")))
    return j.groupBy("table", "role_ord", "role").agg(F.min_by("name", "ordinal").alias("column")) \
        .select("table", "role", "column")


def roles_of(headers: list[str]) -> Roles:
    """R1 on one header list, on the driver (schema metadata, no data)."""
    norm = [re.sub(r"[^a-z0-9_]", "_", h.lower()) for h in headers]
    found = {}
    for role, aliases in COLUMN_ALIASES.items():
        for h, orig in zip(norm, headers):
            if any(h == a or h.startswith(a + "_") or h.endswith("_" + a) or (len(a) > 4 and a in h)
                   for a in aliases):
                found[role] = orig
                break
    return Roles.from_dict(found)


def amount_columns(tables: dict[str, DataFrame], sample_rows: int = 20, min_positive: int = 5) -> DataFrame:
    """R2: (table, column): the first column with at least 5 positive parseable values among the first
    20 rows of each table, null without one; one aggregate per table."""
    def one(t: str, df: DataFrame) -> DataFrame:
        first = F.coalesce(*[F.when(F.count_if(parse_amount(F.col(c)) > 0) >= min_positive, F.lit(c))
                             for c in df.columns])
        return df.limit(sample_rows).agg(first.alias("column")).select(F.lit(t).alias("table"), "column")

    return reduce(DataFrame.unionAll, [one(t, df) for t, df in tables.items()])


def infer_amount_column(df: DataFrame, sample_rows: int = 20, min_positive: int = 5) -> str | None:
    """R2 for one table."""
    return amount_columns({"": df}, sample_rows, min_positive).first()["column"]


def detect_roles(df: DataFrame) -> Roles:
    roles = roles_of(df.columns)
    if not roles.revenue:
        amt = infer_amount_column(df)
        if amt:
            roles = roles.with_(revenue=amt)
    return roles


def domain_expr(joined_headers: Column, has_user_id: Column, has_revenue: Column, has_date: Column) -> Column:
    h = F.lower(joined_headers)
    out = None
    for name, words in DOMAIN_KEYWORDS:
        cond = None
        for w in words:
            cond = h.contains(w) if cond is None else (cond | h.contains(w))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return (out.when(has_user_id & has_revenue & has_date, "ecommerce")
            .when(has_revenue & has_date, "transactional")
            .when(has_revenue, "revenue")
            .otherwise("generic"))


def infer_domain(columns: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """``(table, domain)`` from ordered keyword tests over the space-joined headers, then
    from the inferred roles."""
    roles = roles if roles is not None else infer_roles(columns)
    w = Window.partitionBy("table").orderBy("ordinal").rowsBetween(Window.unboundedPreceding,
                                                                   Window.unboundedFollowing)
    headers = columns.withColumn("_all", F.concat_ws(" ", F.collect_list("name").over(w))) \
        .groupBy("table").agg(F.first("_all").alias("headers"))
    flags = roles.groupBy("table").agg(
        F.max(F.col("role") == "user_id").alias("_u"), F.max(F.col("role") == "revenue").alias("_r"),
        F.max(F.col("role") == "date").alias("_d"))
    j = headers.join(flags, "table", "left")
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    return j.select("table", domain_expr(F.col("headers"), f("_u"), f("_r"), f("_d")).alias("domain"))


def classify_questions(df: DataFrame, text_col: str, domain: Column | str | None = None) -> DataFrame:
    """Nine keyword flags and the primary intent of each question."""
    flags = intent_flags(F.col(text_col))
    return df.select("*", *[v.alias(k) for k, v in flags.items()],
                     intent_primary(flags, domain).alias("primary_intent"))
