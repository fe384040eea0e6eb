"""Sentences of the results.

Fixed values: every text here must equal the reference's, in its order.  ``%s`` and ``%d`` stand for
numbers and names.
"""

from __future__ import annotations

# Reason of each anomaly type.
REASON = {
    "NEGATIVE_VALUES": "%d transactions with negative values — likely refunds, reversals, or data entry errors",
    "STATISTICAL_OUTLIER": "%d transactions with Z-score >3.5σ — extreme deviations from the distribution",
    "IQR_OUTLIER": "%d transactions outside 1.5×IQR — significant but non-extreme",
    "DAILY": "%s: %s of %s vs daily average of %s",
    "SUSPICIOUS_FREQUENCY": "%d transaction pairs within 60 seconds from the same user — possible bot activity or double-charge",
    "ZERO_VALUE_TRANSACTIONS": "%d zero-value transactions (%s%%) — verify if deliberate promotions or data errors",
    "DUPLICATE_TRANSACTIONS": "%d possible duplicate signatures (same user, amount, and date)",
    "DATA_GAP": "%s-day gap in data — check for tracking outage or data collection failure",
}

# How each anomaly type can be checked.
FALSIFIABILITY = {
    "NEGATIVE_VALUES": "Check source system for refund/reversal codes. If no such codes exist, this is a data entry error.",
    "STATISTICAL_OUTLIER": "Verify in source system whether these represent legitimate high-value transactions or data errors.",
    "IQR_OUTLIER": "Review individually to classify as legitimate high/low value transactions or errors.",
    "DAILY": "Check %s in source system for: bulk orders, system errors, promotional events, or data duplication.",
    "SUSPICIOUS_FREQUENCY": "Verify in payment processor logs whether these resulted in duplicate charges to customers.",
    "ZERO_VALUE_TRANSACTIONS": "Check whether these correspond to free tiers, 100% discounts, or data entry errors in the source system.",
    "DUPLICATE_TRANSACTIONS": "Cross-reference transaction IDs in the source system to confirm whether these are duplicates or legitimate same-day repeat purchases.",
    "DATA_GAP": "Verify whether transactions occurred during this gap period but were not captured.",
}

# Quality warning of a degraded table (share excluded, share kept).
QUALITY_WARNING = ("%s%% of rows were excluded during cleaning. All metrics reflect only the %s%% that passed validation "
                   "and may not represent the full dataset.")

# Preamble sentences.
PREAMBLE = {
    "CRITICAL": "DATA INTEGRITY CRITICAL: Only %s%% of rows passed quality checks (%s of %s usable). Analysis is not reliable. "
                "A minimum of 85%% clean data is required for downstream conclusions. Issues: %s",
    "DEGRADED": "DATA QUALITY WARNING: %s of %s rows excluded. Metrics below reflect %s%% of original data.",
    "DENSITY": "ANOMALY DENSITY ALERT: %s%% of rows are statistical outliers (%s of %s rows). This density indicates a "
               "structural data issue, not normal business variation. Summary metrics are unreliable until this is investigated.",
}

# Details of judgments.
DETAIL = {
    "SKEW": "Mean (%s) is %s by extreme values. Median (%s) is the representative figure. "
            "Excluding top 5%% of transactions, mean drops to %s.",
    "OUTLIER": "Total revenue including outliers: %s. Excluding IQR outliers: %s. Outliers account for %s%% of reported total.",
    "TREND": "The apparent trend is driven by a single period (%s: %s) which is %s%% above the %s baseline. "
             "Excluding this period, the trend changes significantly.",
    "DOMINANCE": "%s accounts for %s%% of total revenue. This concentration creates single-point-of-failure risk.",
    "CONTRADICTION": "Revenue trend is positive (slope: %s/period) while transaction volume trend is negative (slope: %s/period). "
                     "This pattern indicates price inflation masking volume decline — a warning sign that top-line growth is not "
                     "sustainable.",
    "GROWTH": "%s%s%% week-over-week revenue change%s",
    "GROWTH_NOTE": " — NOTE: this trend is concentrated in the period %s and may not represent sustained change",
    "RETENTION": "%s%% repeat purchase rate against a 30%% benchmark. %s customers have purchased only once.",
}

# What a contradiction implies, and how each kind of finding can be checked.
IMPLICATION = "Revenue may fall sharply if pricing power is lost or price-sensitive customers churn"
CHECK = {
    "CONTRADICTION": "Resolve by tracking transaction count and revenue separately over the next 30 days.",
    "DISTORTION": "Verified by comparing inclusive vs exclusive outlier calculations.",
    "CONCENTRATION_RISK": "Monitor revenue when this category experiences a 10% volume drop.",
    "TREND": "If this trend is real, the pattern should persist in next week's data. A reversal would indicate a one-time event.",
    "RETENTION": "Track repeat rate monthly. A rising trend confirms acquisition is working but retention needs investment.",
}


def sql_text(s: str) -> str:
    """A text as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def filled(template: str, *args: str) -> str:
    """``format_string`` over SQL expressions."""
    return f"format_string({', '.join([sql_text(template), *args])})"
