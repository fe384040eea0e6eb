"""Threshold boundaries (FIXTURES.md section 3) and the time-series formulas vs brute force."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyscope.model import Roles
from tallyscope.operators import metrics as M
from tallyscope.operators.clean import build_facts
from tallyscope.operators.judge import analysis_tier, judgment

ROLES = Roles(revenue="amount", date="day")


def _table(spark, values, start=dt.date(2024, 1, 1), step_days=1):
    rows = [(float(v), (start + dt.timedelta(days=i * step_days)).isoformat()) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "amount double, day string")


def _rhu(v, d=2):
    return math.floor(v * 10 ** d + 0.5) / 10 ** d


@pytest.mark.parametrize("rows,tier", [(4, "FACTS_ONLY"), (5, "DIRECTIONAL"), (19, "DIRECTIONAL"),
                                       (20, "STANDARD"), (49, "STANDARD"), (50, "FULL")])
def test_tier_boundaries(spark, rows, tier):
    df = spark.range(1).select(F.lit(rows).alias("rows"))
    assert df.select(analysis_tier(F.col("rows"))).first()[0] == tier


def test_quartiles_need_four_rows(spark):
    three = build_facts(_table(spark, [1, 2, 1000]), ROLES, (), "2026-12-01")
    assert three.df.where("is_iqr_outlier").count() == 0
    assert three.df.where("iqr_lower IS NOT NULL").count() == 0
    four = build_facts(_table(spark, [1, 2, 3, 1000]), ROLES, (), "2026-12-01")
    # sorted[1] = 2, sorted[3] = 1000 -> IQR 998, nothing outside
    assert four.df.where("is_iqr_outlier").count() == 0
    five = build_facts(_table(spark, [1, 2, 3, 4, 1000]), ROLES, (), "2026-12-01")
    # sorted[1] = 2, sorted[3] = 4 -> upper 7: 1000 flagged
    assert [r[0] for r in five.df.where("is_iqr_outlier").select("amount").collect()] == [1000.0]


def _brute_fit(ys):
    n = len(ys)
    sx, sy = sum(range(n)), sum(ys)
    sxy, sx2 = sum(i * y for i, y in enumerate(ys)), sum(i * i for i in range(n))
    slope = (n * sxy - sx * sy) / (n * sx2 - sx * sx)
    icpt = (sy - slope * sx) / n
    return _rhu(slope), _rhu(icpt)


def test_forecast_matches_formula(spark):
    ys = [100 + 10 * i + (3 if i % 2 else -2) for i in range(15)]
    facts = build_facts(_table(spark, ys), ROLES, (), "2026-12-01").df
    got = [r["val"] for r in M.linear_forecast(M.daily_trend(facts)).orderBy("step").collect()]
    slope, icpt = _brute_fit([_rhu(y) for y in ys])
    assert got == [_rhu(max(0.0, slope * (len(ys) + i) + icpt)) for i in (1, 2, 3)]


def test_forecast_needs_twelve_points(spark):
    ys = [100 + 10 * i for i in range(11)]
    facts = build_facts(_table(spark, ys), ROLES, (), "2026-12-01").df
    assert M.linear_forecast(M.daily_trend(facts)).count() == 0


@pytest.mark.parametrize("points", [13, 14])
def test_week_over_week_boundary(spark, points):
    ys = [10.0 + i for i in range(points)]
    facts = build_facts(_table(spark, ys), ROLES, (), "2026-12-01").df
    g = M.week_over_week(M.daily_trend(facts)).first()["growth"]
    if points < 14:
        assert g is None
    else:
        l7, p7 = sum(ys[-7:]), sum(ys[-14:-7])
        assert g == _rhu((l7 - p7) / p7 * 100)


@pytest.mark.parametrize("points", [30, 31])
def test_cagr_boundary(spark, points):
    ys = [50.0 + i for i in range(points)]
    facts = build_facts(_table(spark, ys), ROLES, (), "2026-12-01").df
    c = M.annualised_growth(M.daily_trend(facts)).first()["cagr"]
    if points <= 30:
        assert c is None
    else:
        assert c == _rhu(((ys[-1] / ys[0]) ** (365 / points) - 1) * 100)


def test_trend_needs_three_days_and_frequency(spark):
    two = build_facts(_table(spark, [5, 6]), ROLES, (), "2026-12-01")
    assert M.daily_trend(two.df).count() == 0
    weekly = build_facts(_table(spark, [5, 6, 7, 8], step_days=7), ROLES, (), "2026-12-01")
    j = judgment(weekly).first()
    # trend permission needs >= 3 days only; the FACTS_ONLY tier (4 rows) does not clear it
    assert (j["data_points"], j["frequency"], j["can_show_trends"]) == (4, "weekly", True)
    assert (j["analysis_tier"], j["can_show_recommendations"]) == ("FACTS_ONLY", False)


def test_preamble_sentences(spark):
    # 10 rows, 3 without an amount -> clean rate 70 (DEGRADED); 4 outliers of 7 -> density alert
    vals = ["1", "1", "1", "1000", "2000", "3000", "4000", "x", "y", "z"]
    days = ["2024-01-%02d" % (i + 1) for i in range(10)]
    df = spark.createDataFrame(list(zip(vals, days)), "amount string, day string")
    j = judgment(build_facts(df, ROLES, (), "2026-12-01")).first()
    assert j["quality_verdict"] == "DEGRADED"
    assert j["mandatory_preamble"][0] == ("DATA QUALITY WARNING: 3 of 10 rows excluded. "
                                          "Metrics below reflect 70% of original data.")
