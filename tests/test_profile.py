"""The shared profile: equal to the single analyses, few scans, groups, absent roles and empty tables."""

import re

import pytest
from pyspark.sql import functions as F

from tallyscope import session
from tallyscope.model import AMOUNT, CATEGORY, PRODUCT, Roles
from tallyscope.operators import anomalies as A
from tallyscope.operators import judge as J
from tallyscope.operators import metrics as M
from tallyscope.operators import order_stats, profile
from tallyscope.operators.clean import build_facts
from tallyscope.operators.findings import ranked_findings
from tallyscope.plans import analyse as P
from tallyscope.plans import queries_judge as Q

from .conftest import SF


def rows_of(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def same(a, b):
    assert rows_of(a.select(*sorted(a.columns))) == rows_of(b.select(*sorted(b.columns)))


@pytest.fixture(scope="module", params=[(), ("l_returnflag",)], ids=["one", "groups"])
def fx(request, spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("user", F.col("l_orderkey") % 50)
    roles = Roles(revenue="l_extendedprice", quantity="l_quantity", date="l_shipdate", user_id="user", category="l_linestatus",
                  product="l_partkey")
    return build_facts(li, roles, request.param, "2026-12-01", land=True)


def test_views_equal_single_analyses(fx):
    by, f = list(fx.by), fx.df
    p = profile.build_profile(fx, products=True, cut=session.land)
    same(M.daily_of(p.days, by), M.daily_trend(f, by))
    same(M.monthly_of(p.days, by), M.monthly_trend(f, by))
    same(M.weekdays_of(p.days, by), M.weekday_profile(f, by))
    same(M.top_of(p.categories, CATEGORY, by, 12, "count"), M.category_breakdown(f, by))
    same(M.top_of(p.products, PRODUCT, by, 10, "orders"), M.top_products(f, by))
    same(M.without_outliers_of(p.totals, by), M.headline_without_outliers(f, by))
    same(J.dominance_of(p.totals, p.categories, by, 1.0), J.dominance(f, fx.roles, by, 1.0))
    stats = session.land(M.headline(f, by))
    assert stats.count() == p.totals.count()
    tails = p.tails(session.land(J.describe_measure(f, AMOUNT, by)))
    same(A.detectors_of(p, tails), A.all_detectors(f, fx.roles, by))


def test_judgment_scans_the_facts_five_times(spark, fx, monkeypatch):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    path = re.search(r"facts-[0-9a-f]{12}", fx.df.inputFiles()[0])[0]
    plans = []
    real_land = session.land

    def counted(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real_land(df, name)

    collected = order_stats._first_round

    def seen(*a):
        found = collected(*a)
        if not a[1]:  # without groups the brackets are collected, not landed
            plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(order_stats, "land", counted)
    monkeypatch.setattr(order_stats, "_first_round", seen)
    plans.append(J.judgment(fx, cut=counted)._jdf.queryExecution().executedPlan().toString())
    assert 1 < sum(p.count(path) for p in plans) <= 5


def test_all_outputs_with_groups(spark):
    tenants = Q._tenant_facts(spark, SF)
    out = P.analyse(None, facts=tenants, as_of="2026-12-01")
    assert set(out) == set(P.OUTPUTS) - {"products"}
    counts = {k: v.count() for k, v in out.items()}
    assert counts["judgment"] == counts["metrics"] == counts["confidence"] == counts["quality"] == 5
    assert counts["weekday_profile"] == 35 and counts["cohorts"] >= 0 and counts["facts"] == tenants.df.count()
    one = P.analyse(None, facts=build_facts(Q.tenants(spark, SF).where("tenant = 'purchase'"), Q.TENANT_ROLES, [], "2026-12-01", land=True),
                    outputs=["findings", "metrics", "judgment", "anomalies", "daily_trend"])
    for k, v in one.items():
        same(v.drop("seq"), out[k].where("tenant = 'purchase'").drop("tenant", "seq"))


@pytest.mark.parametrize("roles", [Roles(), Roles(revenue="v"), Roles(date="t"), Roles(category="c", user_id="u"), Roles(revenue="v", date="t")])
def test_absent_roles_and_empty_tables(spark, roles):
    df = spark.createDataFrame([("2024-01-01", 1.5, "a", "x"), (None, None, None, None), ("2024-03-01", 2.5, "", "y")],
                               "t string, v double, c string, u string")
    for rows in (df, df.limit(0)):
        out = P.analyse(rows, roles, as_of="2026-12-01")
        j = out["judgment"].collect()
        assert len(j) == 1 and j[0].analysis_tier == "FACTS_ONLY" and j[0].contradiction is False
        assert out["metrics"].count() == 1 and out["confidence"].count() == 1
        assert {"detail", "falsifiability", "implication"} <= set(out["findings"].columns)
        out["findings"].collect()


def test_texts_print_numbers_as_the_reference_does(spark):
    f = spark.createDataFrame([(0.0,)] * 2 + [(5.0,)] * 6, "amount double").selectExpr(
        "amount", "CAST(NULL AS TIMESTAMP) AS event_ts", "CAST(NULL AS DOUBLE) AS qty", "false AS is_iqr_outlier")
    assert A.zero_value_share(f).first().reason.startswith("2 zero-value transactions (25%)")
    g = spark.createDataFrame([(20, 4 * A.DAY_US, 5 * A.DAY_US)], "rows int, max_gap_us long, span_us long")
    assert A.gap_finding(g).first().reason.startswith("4-day gap")


def test_findings_keep_ties_in_order(spark):
    by = ["g"]
    anomalies = spark.createDataFrame([("a", "HIGH", 1.0, 0.0, "r", "c", 1, "X"), ("a", "HIGH", 1.0, 0.0, "r", "c", 2, "Y")],
                                      "g string, severity string, value double, impact double, reason string, falsifiability string, rank int, type string")
    judged = Q.judgment(Q._tenant_facts(spark, SF)).where("tenant = 'click'").drop("tenant").withColumn("g", F.lit("a"))
    metrics = spark.createDataFrame([("a", 100.0, 1e9, -7.0, 12.5, 8)], "g string, revenue double, aov double, growth double, "
                                    "repeat_rate double, unique_users long")
    got = ranked_findings(anomalies, judged, metrics, by).orderBy("rank").collect()
    assert [r.subtype for r in got][:2] == ["X", "Y"] and len(got) == 5
