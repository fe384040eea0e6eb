"""String expressions: markup stripping and question-intent flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import INTENT_PATTERNS
from ._util import col_of

_WS = "\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


def js_trim(c) -> Column:
    """Trim every Unicode space (``F.trim`` only removes ASCII blanks)."""
    return F.regexp_replace(col_of(c), f"^[{_WS}]+|[{_WS}]+$", "")


def strip_markup(c) -> Column:
    """Remove script blocks, tags, ``javascript:`` and inline ``on...=`` handlers, then trim."""
    s = col_of(c).cast("string")
    s = F.regexp_replace(s, "(?is)<script[\\s\\S]*?</script>", "")
    s = F.regexp_replace(s, "<[^>]*>", "")
    s = F.regexp_replace(s, "(?i)javascript:", "")
    s = F.regexp_replace(s, "(?i)on\\w+\\s*=", "")
    return js_trim(s)


def intent_flags(c) -> dict[str, Column]:
    """The intent patterns are alternations of plain words, so each flag is an OR of
    substring tests (a byte search, cheaper than a regex scan over long texts)."""
    low = F.lower(F.coalesce(col_of(c).cast("string"), F.lit("")))
    out = {}
    for name, pat in INTENT_PATTERNS.items():
        cond = None
        for word in pat.split("|"):
            t = low.contains(word)
            cond = t if cond is None else (cond | t)
        out[name] = cond
    return out


def intent_primary(flags: dict[str, Column], domain: Column | str | None = None) -> Column:
    dom = F.lit(domain) if isinstance(domain, str) or domain is None else domain
    return (F.when(flags["focus_anomaly"], "anomaly")
            .when(flags["focus_trend"], "trend")
            .when(flags["focus_user"], "user")
            .when(flags["focus_category"], "category")
            .when(flags["focus_stats"], "distribution")
            .when(flags["focus_quality"], "quality")
            .when(dom == "saas", "saas")
            .when(dom == "hr", "hr")
            .otherwise("overview"))
