"""Operators against brute-force Python on small fixtures and on the sf0.001 tables."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from tallyscope.model import Roles
from tallyscope.streaming import jobs as S
from tallyscope.operators import anomalies as A
from tallyscope.operators import metrics as M
from tallyscope.operators.clean import build_facts
from tallyscope.operators.gate import hourly_quota_bans, rate_limit_windows
from tallyscope.operators.order_stats import disc, order_statistics
from tallyscope.operators.stats import describe_measure, linear_trend

from .conftest import SF


def _brute_pct(xs, p):
    s = sorted(xs)
    idx = p * (len(s) - 1)
    lo, hi = int(idx // 1), -int(-idx // 1)
    return s[lo] + (s[hi] - s[lo]) * (idx - lo)


def test_order_statistics_exact_any_accuracy(spark):
    rnd = random.Random(7)
    rows = [(g, float(rnd.randint(0, 50))) for g in "abc" for _ in range(rnd.randint(1, 300))]
    df = spark.createDataFrame(rows, "g string, v double")
    for acc in (1, 3, 50, 10_000):
        got = {r["g"]: (r["n"], r["q1"], r["q3"]) for r in
               order_statistics(df, "v", ["g"], [disc("q1", .25), disc("q3", .75)], acc).collect()}
        for g in "abc":
            xs = sorted(v for k, v in rows if k == g)
            n = len(xs)
            assert got[g] == (n, xs[int(n * .25)], xs[int(n * .75)]), (acc, g)


def test_describe_matches_brute_force(spark):
    rnd = random.Random(3)
    xs = [round(rnd.lognormvariate(3, 1), 2) for _ in range(997)]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    r = describe_measure(df, "v", rounded=False).first()
    assert r["n"] == len(xs)
    for p in (5, 10, 25, 75, 90, 95, 99):
        assert abs(r[f"p{p}"] - _brute_pct(xs, p / 100)) < 1e-9
    assert abs(r["median"] - _brute_pct(xs, .5)) < 1e-9


def test_by_groups_equal_single_runs(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    roles = Roles(revenue="value", date="ts", user_id="user_id", category="event_type")
    grouped = build_facts(ev, roles, ["event_type"], "2026-12-01")
    g = {r["event_type"]: r.asDict() for r in describe_measure(grouped.df, "amount", ["event_type"]).collect()}
    for t in ("click", "view"):
        one = build_facts(ev.where(F.col("event_type") == t), roles, [], "2026-12-01")
        s = describe_measure(one.df, "amount").first().asDict()
        assert {k: v for k, v in g[t].items() if k != "event_type"} == s


def test_rapid_pairs_bucketing_equals_sorted_scan(spark):
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for u in range(20):
        t = base
        for _ in range(rnd.randint(1, 40)):
            t = t + dt.timedelta(seconds=rnd.choice([0, 1, 30, 59.999, 60, 61, 119, 3600]))
            rows.append((str(u), t))
    df = spark.createDataFrame(rows, "user_key string, event_ts timestamp")
    got = A.rapid_pairs(df).first()["pairs"]
    want = 0
    for u in set(r[0] for r in rows):
        ts = sorted(t for k, t in rows if k == u)
        want += sum(1 for a, b in zip(ts, ts[1:]) if (b - a).total_seconds() < 60)
    assert got == want


def test_linear_trend_constant_and_short(spark):
    s = spark.createDataFrame([("2024-01-0%d" % i, 5.0) for i in range(1, 6)], "day string, val double")
    r = linear_trend(s, "val", "day").first()
    assert (r["slope"], r["r2"], r["usable"]) == (0.0, 0.0, False)
    one = spark.createDataFrame([("2024-01-01", 5.0)], "day string, val double")
    r = linear_trend(one, "val", "day").first()
    assert (r["points"], r["slope"], r["intercept"], r["usable"]) == (1, 0.0, 0.0, False)


def test_weekday_profile_has_seven_rows(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    fx = build_facts(ev, Roles(revenue="value", date="ts"), [], "2026-12-01")
    rows = M.weekday_profile(fx.df).orderBy("dow").collect()
    assert [r["name"] for r in rows] == ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def _brute_quota(events, quota, ban_s):
    bans, by_ip = [], {}
    for ip, ts, i in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        by_ip.setdefault(ip, []).append((ts, i))
    for ip, evs in by_ip.items():
        ban_end, counts = None, {}
        for ts, _ in evs:
            if ban_end is not None and ts < ban_end:
                continue
            h = int(ts.timestamp()) // 3600
            counts[h] = counts.get(h, 0) + 1
            if counts[h] > quota:
                ban_end = ts + dt.timedelta(seconds=ban_s)
                bans.append((ip, ts, ban_end))
    return sorted(bans)


def test_hourly_quota_bans_vs_brute_force(spark):
    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    events, i = [], 0
    for ip in ("a", "b", "c"):
        t = base
        for _ in range(300):
            t += dt.timedelta(seconds=rnd.choice([1, 5, 60, 600, 3000]))
            events.append((ip, t, i))
            i += 1
    df = spark.createDataFrame([(ip, t.replace(tzinfo=None), i) for ip, t, i in events],
                               "ip string, ts timestamp, id long")
    got = sorted((r["ip"], r["ban_start"], r["ban_end"]) for r in
                 hourly_quota_bans(df, quota=5, ban_seconds=7200).collect())
    want = [(ip, s.replace(tzinfo=None), e.replace(tzinfo=None)) for ip, s, e in _brute_quota(events, 5, 7200)]
    assert got == want and len(want) > 0


def test_rate_limit_window_edge(spark):
    base = dt.datetime(2024, 1, 1, 0, 0, 0)
    inside = [("analyze", "x", base + dt.timedelta(seconds=s / 2)) for s in range(31)]
    edge = [("analyze", "y", base + dt.timedelta(seconds=30 + s)) for s in range(31)]
    df = spark.createDataFrame(inside + edge, "type string, ip string, ts timestamp")
    rows = {r["ip"]: r["rejected"] for r in rate_limit_windows(df).collect()}
    assert rows == {"x": 1}


def test_analyse_on_small_table(spark):
    from tallyscope.plans.analyse import analyse
    ev = spark.read.parquet(f"{SF}/events.parquet")
    out = analyse(ev, Roles(revenue="value", date="ts", user_id="user_id", category="event_type"),
                  as_of="2026-12-01")
    assert out["confidence"].count() == 1
    assert out["findings"].count() <= 5
    assert out["weekday_profile"].count() == 7
    j = out["judgment"].first()
    assert j["analysis_tier"] == "FULL" and j["quality_verdict"] == "CLEAN"


def test_empty_input(spark):
    df = spark.createDataFrame([], "amount string, date string")
    fx = build_facts(df, Roles(revenue="amount", date="date"), [], "2026-12-01")
    q = fx.quality.first()
    assert q["rows_before"] == 0 and q["clean_rate"] == 100.0
    assert M.daily_trend(fx.df).count() == 0


def test_quota_stream_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    batch = sorted(tuple(r) for r in q["hourly_quota_bans"](spark, SF).collect())
    stream = sorted(tuple(r) for r in q["hourly_quota_bans_stream"](spark, SF).collect())
    assert stream == batch


def test_chart_tags_escape_then_cut(spark):
    from tallyscope.operators.report import chart_series, chart_tags
    cats = spark.createDataFrame([(1, 'Big "Q" Category Name!!', 1234.0, 3), (2, "b", 99.5, 1), (3, "c", 0.25, 1)],
                                 "rank int, name string, val double, count long")
    tags = {r["chart"]: r["tag"] for r in chart_tags(chart_series(cats, None)).collect()}
    assert tags["bar"] == ('[CHART:bar|Revenue by Category|[{"name":"Big \\"Q\\" Category N","val":1234},'
                           '{"name":"b","val":99.5},{"name":"c","val":0.25}]]')
    assert "pie" in tags


def test_analyse_by_groups_equals_single_runs(spark):
    from tallyscope.plans.analyse import analyse
    ev = spark.read.parquet(f"{SF}/events.parquet")
    roles = Roles(revenue="value", date="ts", user_id="user_id", category="event_type")
    want = ["judgment", "metrics", "anomaly_summary", "confidence"]
    grouped = analyse(ev, roles, by=["event_type"], as_of="2026-12-01", outputs=want)
    for t in ("click", "purchase"):
        single = analyse(ev.where(F.col("event_type") == t), roles, as_of="2026-12-01", outputs=want)
        for name in want:
            g = [r.asDict() for r in grouped[name].where(F.col("event_type") == t).drop("event_type").collect()]
            s = [r.asDict() for r in single[name].collect()]
            assert g == s, (t, name)


def test_rapid_stream_counts_late_rows(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = "user_key string, event_ts timestamp, amount double"
    # batches in this order: 0 s and 1000 s, then 500 s (late), then 30 s (late, pairs with 0 s)
    for i, secs in enumerate(([0, 1000], [500], [30])):
        rows = [("u", base + dt.timedelta(seconds=x), 1.0) for x in secs]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = S.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    out = S.run_to_table(S.rapid_repeat_stream(stream), "rapid-late", "update", str(tmp_path / "run"))
    assert S.rapid_repeat_pairs(out).first()["pairs"] == 1
