"""Physical-plan properties that the scale design relies on."""

import __spark_entry__ as E

from tallyscope.model import Roles
from tallyscope.operators.clean import build_facts
from tallyscope.operators.stats import describe_measure

from .conftest import SF


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()          # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_uses_partial_group_limit(spark):
    for name in ("top_products_by_returnflag", "rate_limit_rejections"):
        assert "WindowGroupLimit" in _plan(E.queries()[name](spark, SF)), name


def test_activity_log_prunes_partitions(spark):
    df = E.queries()["activity_log_roundtrip"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan


def test_exact_quantiles_avoid_whole_group_percentile(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    fx = build_facts(ev, Roles(revenue="value", date="ts", category="event_type"), ["event_type"], "2026-12-01")
    plan = _plan(describe_measure(fx.df, "amount", ["event_type"]))
    assert "percentile" not in plan


def test_rate_limit_scan_prunes_columns(spark):
    plan = _plan(E.queries()["rate_limit_windows"](spark, SF))
    schema = plan[plan.index("ReadSchema: "):].split("\n")[0]
    assert "props" not in schema and "value" not in schema and "user_id" in schema
