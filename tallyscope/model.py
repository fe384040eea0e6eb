"""Shared vocabulary: column roles, thresholds and the standard fact columns."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Judgment thresholds, in the reference's order.
# ---------------------------------------------------------------------------
THRESHOLDS = {
    "MIN_ROWS_FOR_PATTERNS": 5,
    "MIN_ROWS_FOR_TRENDS": 3,
    "MIN_ROWS_FOR_SEASONAL": 12,
    "MIN_ROWS_FOR_FORECAST": 12,
    "MIN_ROWS_FOR_STANDARD": 20,
    "MIN_ROWS_FOR_FULL": 50,
    "MIN_CLEAN_RATE_FOR_ANALYSIS": 85,
    "MIN_CLEAN_RATE_HARD_REFUSE": 70,
    "MAX_ANOMALY_DENSITY_PCT": 15,
    "OUTLIER_DISTORTION_THRESHOLD": 0.20,
    "MIN_R2_FOR_LINEAR_FORECAST": 0.50,
    "MIN_CATEGORY_INSTANCES": 1,
    "SKEW_DISTORTION_THRESHOLD": 2.0,
    "CONCENTRATION_DOMINANCE_PCT": 40,
}

# Request-gate limits (requests allowed per window, window in seconds).
RATE_LIMITS = {
    "auth": {"max": 10, "window": 60},
    "analyze": {"max": 30, "window": 60},
    "general": {"max": 100, "window": 60},
}
HOURLY_QUOTA = 500          # requests per client per epoch hour before a ban
BAN_SECONDS = 86400         # automatic and default manual ban length
ACTIVITY_TTL_DAYS = 7       # activity log retention

# Role aliases, in the reference's role order and alias order.
COLUMN_ALIASES = {
    "revenue": ["amount", "revenue", "sales", "price", "total", "final_amount", "sale_price",
                "total_amount", "grand_total", "net_amount", "value", "income", "earning", "payment",
                "invoice_amount", "order_value", "gmv", "transaction_amount", "subtotal", "unit_price",
                "mrr", "arr", "billing", "fee", "charge", "proceeds"],
    "date": ["date", "timestamp", "created_at", "order_date", "transaction_date", "signup_date",
             "purchase_date", "time", "datetime", "created", "updated_at", "order_time", "sale_date",
             "invoice_date", "event_date", "date_time", "order_created", "period", "month", "year"],
    "user_id": ["user_id", "customer_id", "cust_id", "client_id", "uid", "userid", "customerid",
                "buyer_id", "account_id", "member_id", "contact_id", "user", "customer", "sub_id"],
    "email": ["email", "email_address", "user_email", "customer_email"],
    "category": ["category", "type", "group", "department", "segment", "product_type", "item_type",
                 "channel", "source", "product_category", "region", "country", "city", "brand",
                 "vertical", "division", "subcategory", "industry", "market"],
    "product": ["product", "product_name", "item", "item_name", "sku", "product_id", "description",
                "name", "title", "product_title", "item_description", "sku_id"],
    "quantity": ["quantity", "qty", "units", "count", "volume", "items", "num_items", "pieces"],
    "status": ["status", "state", "stage", "order_status", "payment_status", "txn_status"],
    "cost": ["cost", "expenses", "cogs", "expenditure", "spending", "purchase_price", "buy_price"],
    "profit": ["profit", "margin", "earnings", "net_income", "ebitda", "net_profit", "gross_profit"],
    "channel": ["channel", "source", "medium", "campaign", "platform", "utm_source"],
    "region": ["region", "country", "state", "city", "postcode", "zip", "location", "territory"],
}

# Dataset-type keywords, first hit wins, tested on the joined lower-case headers.
DOMAIN_KEYWORDS = [
    ("saas", ["mrr", "churn", "arr", "subscription"]),
    ("hr", ["salary", "employee", "attrition"]),
    ("finance", ["stock", "ticker", "dividend"]),
    ("marketing", ["campaign", "ctr", "impression", "roas"]),
    ("operations", ["inventory", "warehouse", "shipment"]),
]

# Question-intent patterns (case-insensitive regular expressions).
INTENT_PATTERNS = {
    "focus_anomaly": "anomal|outlier|unusual|spike|suspicious|fraud|duplic|weird|wrong",
    "focus_trend": "trend|over time|growth|month|week|daily|period|forecast|future",
    "focus_user": "user|customer|repeat|retention|cohort|loyal|churn|segment|who",
    "focus_category": "categ|segment|product|channel|group|break|split|top|best|worst",
    "focus_quality": "clean|quality|miss|corrupt|valid|error|duplicate|issue|problem",
    "focus_stats": "distribut|median|percentile|std|variance|outlier|stat|min|max|avg",
    "needs_action": "recommend|should|action|improve|fix|next|what to do|suggest|advice",
    "needs_comparison": "compare|vs|versus|difference|better|worse|against",
    "has_premise": "why is|what caused|because of|due to|reason for",
}

# Finding weights.
RELIABILITY_WEIGHT = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.25}
URGENCY_WEIGHT = {"HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.4}

# Standard column names of the cleaned fact table.
AMOUNT = "amount"
TS = "event_ts"
QTY = "qty"
USER = "user_key"
CATEGORY = "category"
PRODUCT = "product"
OUTLIER = "is_iqr_outlier"
IQR_LOWER = "iqr_lower"
IQR_UPPER = "iqr_upper"


@dataclass(frozen=True)
class Roles:
    """Which source column plays which role; ``None`` means the role is absent."""

    revenue: str | None = None
    date: str | None = None
    user_id: str | None = None
    email: str | None = None
    category: str | None = None
    product: str | None = None
    quantity: str | None = None
    status: str | None = None
    cost: str | None = None
    profit: str | None = None
    channel: str | None = None
    region: str | None = None

    @property
    def user(self) -> str | None:
        return self.user_id or self.email

    def with_(self, **kw) -> "Roles":
        return replace(self, **kw)

    def as_dict(self) -> dict[str, str]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name)}

    @staticmethod
    def from_dict(d: dict[str, str | None]) -> "Roles":
        names = {f.name for f in fields(Roles)}
        return Roles(**{k: v for k, v in d.items() if k in names})
