"""DuckDB SQL of the display texts (test oracles only)."""

from __future__ import annotations

from .oracle import R


def numtext_sql(x: str, digits: int = 2) -> str:
    text = f"printf('%.{digits}f', {R(x, digits)})"
    return text if digits == 0 else f"regexp_replace({text}, '[.]?0+$', '')"


def inr_sql(v: str) -> str:
    a = f"abs({v})"
    whole = R(a, 0)
    return (f"(CASE WHEN {v} IS NULL OR NOT isfinite({v}) THEN 'N/A' ELSE "
            f"(CASE WHEN {v} < 0 THEN '-' ELSE '' END) || '₹' || "
            f"CASE WHEN {a} >= 1e7 THEN {numtext_sql(a + ' / 1e7')} || 'Cr' "
            f"WHEN {a} >= 1e5 THEN {numtext_sql(a + ' / 1e5')} || 'L' "
            f"WHEN {a} >= 1e3 THEN (CASE WHEN {whole} >= 100000 THEN '1,00,000' ELSE format('{{:,}}', CAST({whole} AS BIGINT)) END) "
            f"ELSE {numtext_sql(a)} END END)")
