"""Display strings: plain number text and the rupee display (crore / lakh / grouped)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of
from .sqlfns import call, inr_sql, numtext_sql


def number_text(c, digits: int = 2) -> Column:
    """Shortest text of a value rounded to ``digits`` places: 1.5 -> '1.5', 2.0 -> '2'.

    A Column argument goes through a session SQL function, whose argument is evaluated
    eagerly: pass a value column, not an expression that relies on an outer guard."""
    if isinstance(c, str):
        return F.expr(numtext_sql(c, digits))
    return call(f"tally_numtext_{digits}", col_of(c).cast("double"))


def inr_display(c) -> Column:
    """Rupee display: >= 1e7 -> '₹1.23Cr', >= 1e5 -> '₹1.23L', >= 1e3 -> '₹12,345', else '₹999.5'.

    Same argument contract as :func:`number_text`."""
    if isinstance(c, str):
        return F.expr(inr_sql(c))
    return call("tally_inr", col_of(c).cast("double"))
