"""Session-scoped SQL functions for the formulas used on every report column.

Each formula is written once as SQL text (``*_sql`` builders).  Column callers go
through a temporary SQL function (``CREATE TEMPORARY FUNCTION ... RETURN <expr>``),
which the analyzer inlines as an ordinary expression -- same codegen as writing the
expression out -- while building the plan costs one call instead of hundreds of
driver round trips.  Arguments of such a function are evaluated before its body,
so callers pass value columns, not expressions guarded by an outer condition.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

def rhu_sql(x: str, digits: int = 2) -> str:
    """Half-up rounding of SQL expression ``x`` to ``digits`` places; non-finite -> 0."""
    s = float(10 ** digits)
    v = f"CAST(({x}) AS DOUBLE)"
    return (f"(CASE WHEN {v} IS NULL THEN CAST(NULL AS DOUBLE) "
            f"WHEN isnan({v}) OR abs({v}) = double('inf') THEN 0.0D "
            f"WHEN abs({v} * {s}D + 0.5D) >= 9.0E15 THEN ({v} * {s}D + 0.5D) / {s}D "
            f"ELSE CAST(floor({v} * {s}D + 0.5D) AS DOUBLE) / {s}D END)")


def numtext_sql(x: str, digits: int = 2) -> str:
    """Shortest text of ``x`` rounded half-up to ``digits`` places (1.5 -> '1.5', 2.0 -> '2')."""
    s = f"regexp_replace(format_number({rhu_sql(x, digits)}, {digits}), ',', '')"
    return s if digits == 0 else f"regexp_replace({s}, '[.]?0+$', '')"


def inr_sql(x: str) -> str:
    """Rupee display of ``x``: crore / lakh / grouped thousands / plain, 'N/A' if not finite."""
    v = f"CAST(({x}) AS DOUBLE)"
    a = f"abs({v})"
    whole = rhu_sql(a, 0)
    return (f"(CASE WHEN {v} IS NULL OR isnan({v}) OR {a} = double('inf') THEN 'N/A' ELSE concat("
            f"CASE WHEN {v} < 0 THEN '-' ELSE '' END, '₹', "
            f"CASE WHEN {a} >= 1.0E7 THEN concat({numtext_sql(a + ' / 1.0E7')}, 'Cr') "
            f"WHEN {a} >= 1.0E5 THEN concat({numtext_sql(a + ' / 1.0E5')}, 'L') "
            f"WHEN {a} >= 1.0E3 THEN CASE WHEN {whole} >= 100000 THEN '1,00,000' ELSE format_number({whole}, 0) END "
            f"ELSE {numtext_sql(a)} END) END)")


def _defs() -> dict[str, tuple[str, str]]:
    out = {"tally_inr": ("x DOUBLE", "STRING", inr_sql("x"))}
    for d in range(0, 5):
        out[f"tally_numtext_{d}"] = ("x DOUBLE", "STRING", numtext_sql("x", d))
    return out


_DEFS = _defs()


def call(name: str, *cols: Column) -> Column:
    """Call session function ``name``, creating it in the active session on first use."""
    spark = SparkSession.getActiveSession()
    if not spark.catalog.functionExists(name):
        params, ret, body = _DEFS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")
    return F.call_function(name, *cols)
