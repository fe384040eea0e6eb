"""A small subscription table end to end: read, roles, all analyses, against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tallyscope.operators.roles import catalogue, detect_roles, infer_domain
from tallyscope.plans.analyse import analyse
from tallyscope.sources.tables import read_table

# Revenue of each month's four rows, January to December.
ENTERPRISE = [45000, 48000, 52000, 55000, 60000, 64000, 68000, 72000, 75000, 80000, 85000, 95000]
ENGINEERING = [12000, 12500, 13000, 13200, 13500, 14000, 14500, 15000, 15500, 16000, 16500, 17000]
SUPPORT = [8000, 8200, 8500, 8500, 8800, 9000, 9200, 9500, 9800, 10000, 10500, 11000]
SMB = [15000, 16500, 18000, 19500, 21000, 22500, 24000, 26000, 28000, 30000, 32000, 35000]
MONTH_END = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("golden") / "table.csv"
    lines = ["Date,Department,Subscription_Type,Expense_Category,Revenue_USD,Customer_Segment,CAC,LTV,Churn_Rate"]
    for m in range(12):
        day = f"2023-{m + 1:02d}-{MONTH_END[m]}"
        lines += [f"{day},Sales,Enterprise Subscription,Marketing,{ENTERPRISE[m]},Enterprise,{500 - m},12000,0.02",
                  f"{day},Engineering,None,Infrastructure,{ENGINEERING[m]},N/A,0,0,0",
                  f"{day},Support,None,Salaries,{SUPPORT[m]},N/A,0,0,0",
                  f"{day},Sales,SMB Subscription,Marketing,{SMB[m]},SMB,150,1800,0.05"]
    path.write_text("\n".join(lines) + "\n")
    df = read_table(spark, str(path))
    roles = detect_roles(df)
    assert roles.as_dict() == {"revenue": "Revenue_USD", "date": "Date", "user_id": "Customer_Segment", "category": "Department"}
    assert infer_domain(catalogue(spark, {"t": df})).first().domain == "saas"
    return analyse(df, as_of="2026-12-01")


def test_cleaning(out):
    q = out["quality"].first()
    assert (q.rows_before, q.rows_after, q.clean_rate, q.duplicates_removed) == (48, 48, 100.0, 0)
    assert q.issues == ["Flagged 1 IQR outliers (retained for analysis)"]
    f = out["facts"].first()
    assert (f.iqr_lower, f.iqr_upper) == (-37500.0, 94500.0)
    assert [r.amount for r in out["facts"].where("is_iqr_outlier").collect()] == [95000.0]


def test_metrics(out):
    m = out["metrics"].first()
    assert (m.revenue, m.orders, m.aov, m.median_order) == (1370200.0, 48, 28545.83, 16500.0)
    assert (m.revenue_excluding_outliers, m.aov_excluding_outliers) == (1275200.0, 27131.91)
    assert (m.growth, m.cagr, m.unique_users, m.repeat_rate, m.pareto_concentration) == (None, None, 3, 100.0, 58.31)
    want = [80000, 85200, 91500, 96200, 103300, 109500, 115700, 122500, 128300, 136000, 144000, 158000]
    assert [r.val for r in out["daily_trend"].orderBy("day").collect()] == want
    assert [r.val for r in out["monthly_trend"].orderBy("month").collect()] == want
    week = {r["name"]: (r.val, r["count"]) for r in out["weekday_profile"].collect()}
    assert week == {"Sun": (254200, 8), "Mon": (115700, 4), "Tue": (301200, 12), "Wed": (103300, 4), "Thu": (266500, 8),
                    "Fri": (201000, 8), "Sat": (128300, 4)}
    assert [(r.val, r.r2) for r in out["forecast"].orderBy("step").collect()] == [(164611.70, 0.9881), (171335.48, 0.9881), (178059.26, 0.9881)]
    assert [(r["name"], r.val, r["count"]) for r in out["categories"].orderBy("rank").collect()] == [
        ("Sales", 1086500, 24), ("Engineering", 172700, 12), ("Support", 111000, 12)]
    assert "products" not in out and out["cohorts"].count() == 0


def test_judgment(out):
    j = out["judgment"].first()
    assert (j.analysis_tier, j.quality_verdict, j.density_flag, j.outlier_density) == ("STANDARD", "CLEAN", False, 2.08)
    assert (j.skew_flag, j["skew"], j.outlier_distortion, j.trend_concentrated) == (False, 1.274, False, False)
    assert (j.data_points, j.frequency, j.r2, j.is_linear_fit) == (12, "monthly", 0.9881, True)
    assert j.can_show_seasonal and j.can_forecast and j.can_show_categories and j.can_show_user_analysis and not j.full_analysis
    assert (j.dominant_category, j.dominant_pct, j.dominant_value, j.contradiction) == ("Sales", 79.29, 1086500.0, False)
    assert j.mandatory_preamble == [] and j.quality_warnings == []
    assert j.dominance_detail == ("Sales accounts for 79.29% of total revenue. "
                                  "This concentration creates single-point-of-failure risk.")


def test_anomalies_and_findings(out):
    a = out["anomalies"].orderBy("rank").collect()
    assert [(r.type, r.value, r.impact) for r in a] == [("SUSPICIOUS_FREQUENCY", 12.0, 0.0), ("IQR_OUTLIER", 1.0, 95000.0)]
    s = out["anomaly_summary"].first()
    assert (s["count"], s.high_count, s.total_impact) == (2, 1, 95000.0)
    c = out["confidence"].first()
    assert (c.score, c.confidence) == (85, "HIGH")
    f = out["findings"].orderBy("rank").select("type", "subtype", F.round("magnitude", 2).alias("m"), F.round("score", 2).alias("s")).collect()
    assert [tuple(r) for r in f] == [("ANOMALY", "SUSPICIOUS_FREQUENCY", 342549.96, 342549.96),
                                     ("CONCENTRATION_RISK", "CATEGORY_CONCENTRATION", 325950.0, 228165.0),
                                     ("ANOMALY", "IQR_OUTLIER", 95000.0, 9500.0)]
