"""The gate: brute force, hot clients, batch against stream, state that empties, replayed batches."""

import datetime as dt
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import gate as G
from tallyscope.streaming import jobs as S
from tallyscope.streaming import sink

BASE = dt.datetime(2024, 1, 1)
LOG = "id long, ts timestamp, ip string, type string"
BANS = "ip string, start timestamp, duration int"
LIMITS = {"auth": {"max": 2, "window": 60}, "analyze": {"max": 3, "window": 60}, "general": {"max": 5, "window": 60}}


def us_of(t):
    return round((t - BASE).total_seconds() * 1e6)


def brute(rows, bans, quota, ban_s, limits=LIMITS):
    """The gate as a loop over requests in order of time and id."""
    out, hour, until, window = {}, {}, {}, {}
    for i, t, ip, kind in sorted(rows, key=lambda r: (r[1], r[0]) if r[1] else (BASE, r[0])):
        if ip is None or t is None:
            out[i] = "passed"
            continue
        us = us_of(t)
        if any(b == ip and s is not None and us_of(s) <= us < us_of(s) + (d if d is not None else ban_s) * 1_000_000 for b, s, d in bans) \
                or us < until.get(ip, -1):
            out[i] = "banned"
            continue
        key = (ip, us // 3_600_000_000)
        hour[key] = hour.get(key, 0) + 1
        if hour[key] > quota:
            until[ip], hour[key] = us + ban_s * 1_000_000, 0  # counting begins anew after the ban
            out[i] = "quota"
            continue
        w = (kind, ip, us // 60_000_000)
        if window.get(w, 0) + 1 > limits.get(kind, limits["general"])["max"]:
            out[i] = "limited"
            continue
        window[w] = window.get(w, 0) + 1
        out[i] = "passed"
    return out


def some_log(seed, n=900, whole=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        spell = rnd.choice([0, 0, 5000, 9000, 90_000])
        t = BASE + dt.timedelta(seconds=spell + rnd.choice([rnd.random() * 300, rnd.random() * 7200, 3599.999999, 3600]))
        rows.append((i, t, rnd.choice("aaaabbc"), rnd.choice(["auth", "analyze", "general", "other"])))
    if not whole:
        rows += [(n, None, "a", "auth"), (n + 1, BASE, None, "auth")]
    rnd.shuffle(rows)
    bans = [("a", BASE + dt.timedelta(seconds=9100), 30), ("b", BASE, 10), ("b", BASE + dt.timedelta(seconds=10), 5),
            ("b", BASE + dt.timedelta(seconds=3), 2), ("c", BASE + dt.timedelta(seconds=90_000), None), ("zz", BASE, 50)]
    if not whole:
        bans += [(None, BASE, 5), ("a", None, 5), ("a", BASE, 0), ("a", BASE + dt.timedelta(seconds=1), -5)]
    return rows, bans


@pytest.mark.parametrize("seed,quota,ban_s", [(1, 20, 1800), (2, 5, 40), (3, 1, 3600), (4, 60, 86_400)])
def test_gate_equals_brute_force(spark, seed, quota, ban_s):
    rows, bans = some_log(seed)
    log, table = spark.createDataFrame(rows, LOG), spark.createDataFrame(bans, BANS)
    got = G.gate_decisions(log, table, quota=quota, ban_seconds=ban_s, limits=LIMITS)
    want = brute(rows, bans, quota, ban_s)
    assert {r.id: r.decision for r in got.collect()} == want
    if seed == 1:
        assert set(want.values()) == {"banned", "quota", "limited", "passed"}
    alone = {r.id for r in G.gate_decisions(log, None, quota=quota, ban_seconds=ban_s, limits=LIMITS).where("decision = 'quota'").collect()}
    only = {i for i, d in brute(rows, [], quota, ban_s).items() if d == "quota"}
    assert alone == only and G.hourly_quota_bans(log, quota=quota, ban_seconds=ban_s).count() == len(only)


def test_rounds_grow_with_the_logarithm_of_the_bans(spark, monkeypatch):
    landed = []
    real = G.land
    monkeypatch.setattr(G, "land", lambda df, name="table": landed.append(name) or real(df, name))
    rows = [(i, BASE + dt.timedelta(seconds=5 * i), "a", "auth") for i in range(1500)]
    bans = G.hourly_quota_bans(spark.createDataFrame(rows, LOG), quota=1, ban_seconds=60)
    assert bans.count() == sum(d == "quota" for d in brute(rows, [], 1, 60).values()) > 64
    assert landed.count("quota-reached") - 1 <= 8  # log2 of the bans, and one that finds no more


def test_manual_bans_meet_in_time_bins(spark):
    rows, bans = some_log(9)
    log = spark.createDataFrame(rows, LOG).withColumn("start_us", F.lit("mine"))
    kept = G.apply_manual_bans(log, spark.createDataFrame(bans, BANS), default_seconds=100)
    want = {i for i, t, ip, _ in rows if t is None or not any(
        ip and b == ip and s is not None and s <= t < s + dt.timedelta(seconds=100 if d is None else d) for b, s, d in bans)}
    got = kept.collect()
    assert {r.id for r in got} == want and len(got) == len(want) and kept.columns == log.columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("hashpartitioning(ip" in line and "_bin" in line for line in plan.splitlines())
    for width in (1, 7, 100_000):
        assert {r.id for r in G.apply_manual_bans(log, spark.createDataFrame(bans, BANS), default_seconds=100, bin_seconds=width).collect()} == want


def test_intervals_merge(spark):
    rows = [("a", 0, 10), ("a", 10, 12), ("a", 3, 4), ("a", 14, 20), ("a", 13, 13), ("b", 5, 6), ("b", 5, 9)]
    got = G.merged_intervals(spark.createDataFrame(rows, "ip string, start_us long, end_us long")).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 12), ("a", 14, 20), ("b", 5, 9)]


def test_bans_last(spark):
    with pytest.raises(ValueError):
        G.hourly_quota_bans(spark.createDataFrame([], LOG), ban_seconds=0)


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG)
    assert G.hourly_quota_bans(log).collect() == [] and G.gate_decisions(log, spark.createDataFrame([], BANS)).collect() == []


def test_stream_equals_batch_and_its_state_empties(spark, tmp_path):
    rows, bans = some_log(6, whole=True)
    log, table = spark.createDataFrame(rows, LOG), spark.createDataFrame(bans, BANS)
    want = sorted(map(tuple, G.gate_summary(G.gate_decisions(log, table, quota=20, ban_seconds=1800, limits=LIMITS)).collect()))
    path = S.arrivals(log, "ts", 5, 600, closing={"ip": "", "id": -1, "type": "general"})
    stream = S.file_stream(spark, path, log.schema, 1)
    root = str(tmp_path / "gate")
    out = S.run_to_table(S.gate_stream(stream, table, 20, 1800, LIMITS, watermark="11 minutes"), "gate", "append", root, rocksdb=True)
    got = [tuple(r) for r in out.where("ip <> ''").collect()]
    assert sorted(got) == want and len(got) == len(set(got))
    left = spark.read.format("statestore").option("stateVarName", "counted").option("operatorId", 1).load(os.path.join(root, "checkpoint"))
    assert {r.key.ip for r in left.select("key").collect()} <= {""}


def test_stream_drops_rows_beyond_the_watermark_and_keeps_order_within(spark, tmp_path):
    path = str(tmp_path / "in")
    for part in ([(1, 0, "a"), (2, 30, "a")], [(3, 400, "a"), (4, 10, "a")], [(5, 4000, "z")], [(8, 4001, "z")], [(6, 20, "a")], [(7, 90_000_000, "z")]):
        rows = [(i, BASE + dt.timedelta(seconds=s), ip, "auth") for i, s, ip in part]
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)
    stream = S.file_stream(spark, path, spark.read.parquet(path).schema, 1)
    out = S.run_to_table(S.quota_stream(stream, quota=2, ban_seconds=100, watermark="10 minutes"), "quota", "append", rocksdb=True)
    got = {r.id: r.decision for r in out.where("ip = 'a'").collect()}
    # 4 came late but in time and is the second request; 6 came after its minute was closed
    assert got == {1: "counted", 4: "counted", 2: "quota", 3: "counted"}


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("mode,every", [("append", 16), ("update", 2), ("complete", 16)])
def test_replayed_batches_change_nothing(spark, tmp_path, mode, every):
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        rows = [("u%d" % (i % 3), BASE + dt.timedelta(seconds=40 * i + k), float(i % 2)) for i in range(30)]
        spark.createDataFrame(rows, "user_key string, event_ts timestamp, amount double").coalesce(1).write.mode("append").parquet(path)

    def run():
        events = S.file_stream(spark, path, spark.read.parquet(path).schema, 1)
        job = {"append": S.dedup_stream, "update": S.rapid_repeat_stream, "complete": S.daily_trend_stream}[mode](events)
        return S.run_to_table(job, mode, mode, root, S.newest_buckets if mode == "update" else None, every)

    first = run()
    want = _rows(first)
    # the last batch was written, but the query died before it could say so
    commits = os.path.join(root, "checkpoint", "commits")
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(os.path.join(commits, name))
    assert _rows(run()) == want
    # half of a batch that never ended is not read
    half = os.path.join(root, "data", f"batch={last + 1}")
    shutil.copytree(os.path.join(root, "data", "batch=0"), half)
    assert _rows(sink.read_sink(spark, root)) == want
    if mode == "update":
        batches = sink._entries(spark, root)
        assert batches[max(batches)] > 0  # earlier batches are merged
        assert S.rapid_repeat_pairs(first).first().pairs > 0


def test_state_store_setting_comes_back(spark):
    before = spark.conf.get(sink._PROVIDER, None)
    with sink._state_store(spark):
        assert spark.conf.get(sink._PROVIDER) == sink._ROCKSDB
    assert spark.conf.get(sink._PROVIDER, None) == before


def test_quiet_hours_do_not_reach_the_keyed_state(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, BASE + dt.timedelta(seconds=rnd.random() * 40_000), f"q{i % 40}", "auth") for i in range(400)]
    rows += [(1000 + i, BASE + dt.timedelta(seconds=rnd.random() * 40_000), "hot", "auth") for i in range(500)]
    log = spark.createDataFrame(rows, LOG)
    stream = S.file_stream(spark, S.arrivals(log, "ts", 3, 60, closing={"ip": "", "id": -1}), log.schema, 1)
    job, seen = S.hourly_quota_stream(stream, quota=20, ban_seconds=5000, watermark="2 minutes"), []
    with sink._state_store(spark):
        q = job.writeStream.outputMode("append").foreachBatch(lambda b, i: sink.write_batch(b, i, str(tmp_path / "out"))) \
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    for p in q.recentProgress:
        seen += [o["numRowsUpdated"] for o in p["stateOperators"] if o["operatorName"].startswith("transformWithState")]
    got = sorted((r.ip, r.ban_start_us - 1_704_067_200_000_000) for r in sink.read_sink(spark, str(tmp_path / "out")).collect())
    decided = brute(rows, [], 20, 5000)
    assert got == sorted((ip, us_of(t)) for i, t, ip, _ in rows if decided[i] == "quota")
    assert {ip for ip, _ in got} == {"hot"}
    # one client in few batches: before, each of 900 requests was a timer and a slice of its own
    assert 0 < sum(seen) < 60


def test_stream_of_bans_within_a_slice_equals_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, BASE + dt.timedelta(seconds=rnd.choice([rnd.random() * 90, 3590 + rnd.random() * 20, 3600])), rnd.choice("ab"), None)
            for i in range(300)]
    log, decided = spark.createDataFrame(rows, LOG), brute(rows, [], 4, 7)
    stream = S.file_stream(spark, S.arrivals(log, "ts", 4, 20, closing={"ip": "", "id": -1}), log.schema, 1)
    out = S.run_to_table(S.quota_stream(stream, quota=4, ban_seconds=7, watermark="1 minute"), "quota", "append", rocksdb=True)
    got = {r.id: r.decision for r in out.where("ip <> ''").collect()}
    assert {i: d for i, d in got.items() if d != "counted"} == {i: d for i, d in decided.items() if d in ("quota", "banned")}
    assert set(got) == set(decided)


def test_retention_counts_back_from_the_newest_row(spark, tmp_path):
    import __spark_entry__ as E
    rows = [(i, dt.datetime(2020, 5, 1) + dt.timedelta(days=i), i, "view", 1.0, "") for i in range(20)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    assert _rows(E.queries()["activity_retention"](spark, str(tmp_path))) == [("view", 7)]
