"""Registered queries of the request gate and the streaming jobs.

The events table is the request log.  ``burst`` is the same log in other clothes, row by row: three spells
of three hours, two days apart, every hour's requests within its first two minutes and two thirds of
them from one client, so that the real limits (10, 30 and 100 a minute, 500 an hour, 24 hours) are reached.
Streams replay the log as files in order of arrival, out of order within the watermark.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gate as G
from ..session import land
from ..streaming import jobs as S
from .oracle import R
from .queries import SQL, _LANDED, _stamp, load, register


def _log(spark, sf):
    e = load(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("user_id").cast("string").alias("ip"), F.col("event_type").alias("type"))


@register("rate_limit_windows", """SELECT event_type AS type, CAST(user_id AS VARCHAR) AS ip,
  make_timestamp(CAST(floor(epoch_us(ts) / 60000000) * 60000000 AS BIGINT)) AS window_start, count(*) AS requests,
  least(count(*), 1) AS allowed, greatest(count(*) - 1, 0) AS rejected
FROM events GROUP BY 1, 2, floor(epoch_us(ts) / 60000000) HAVING count(*) > 1""")
def q_rate_windows(spark, sf):
    return G.rate_limit_windows(_log(spark, sf), max_col=F.lit(1)).withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("limit_", F.lit(1)).drop("limit_")


_BANS_SQL = "(SELECT CAST(user_id AS VARCHAR) AS ip, min(ts) AS start, 3600 AS duration FROM events WHERE event_type = 'error' GROUP BY user_id)"


@register("apply_manual_bans", f"""SELECT type, count(*) AS allowed FROM (
  SELECT event_type AS type FROM events e WHERE NOT EXISTS (
    SELECT 1 FROM {_BANS_SQL} b WHERE b.ip = CAST(e.user_id AS VARCHAR) AND e.ts >= b.start
      AND e.ts < b.start + to_seconds(b.duration))) GROUP BY type""")
def q_bans(spark, sf):
    log = _log(spark, sf)
    bans = log.where(F.col("type") == "error").groupBy("ip").agg(F.min("ts").alias("start")) \
        .withColumn("duration", F.lit(3600))
    return G.apply_manual_bans(log, bans).groupBy("type").agg(F.count("*").alias("allowed"))


@register("activity_retention", """SELECT type, count(*) AS kept FROM (
  SELECT event_type AS type FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY) GROUP BY type""")
def q_retention(spark, sf):
    log = _log(spark, sf)
    dated = log.crossJoin(F.broadcast(log.agg(F.max("ts").alias("newest"))))  # one row
    return G.activity_retention(dated, F.col("newest")).groupBy("type").agg(F.count("*").alias("kept"))


@register("recent_activity", """SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS ip, event_type AS type
FROM events ORDER BY ts DESC, event_id DESC LIMIT 200""")
def q_recent(spark, sf):
    return G.recent_activity(_log(spark, sf), "ts", "id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_PATH = "CASE event_type WHEN 'error' THEN '/api/auth/google' WHEN 'purchase' THEN '/api/analyze' ELSE '/api/' || event_type END"


@register("request_class", f"""SELECT event_id AS id, CASE path WHEN '/api/auth/google' THEN 'auth' WHEN '/api/analyze' THEN 'analyze'
  ELSE 'general' END AS type FROM (SELECT event_id, {_PATH} AS path FROM events)""")
def q_request_class(spark, sf):
    e = load(spark, sf, "events").selectExpr("event_id AS id", f"{_PATH} AS path")
    return e.select("id", G.request_class(F.col("path")).alias("type"))


@register("request_class_pages", """SELECT page_id, CASE WHEN path = '/api/auth/google' THEN 'auth' WHEN path = '/api/analyze'
  THEN 'analyze' ELSE 'general' END AS type FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def q_request_class_pages(spark, sf):
    p = load(spark, sf, "pages")
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    return p.select("page_id", G.request_class(path).alias("type"))


def _quota_sql(q: int) -> str:
    """W2 as a recursive CTE: each step finds every client's next trigger after its last ban."""
    step = f"""SELECT ip, us, us + 86400000000 FROM (
    SELECT ip, us, h, row_number() OVER (PARTITION BY ip, h ORDER BY us, id) AS rn,
           min(CASE WHEN c > {q} THEN h END) OVER (PARTITION BY ip) AS first_h
    FROM (SELECT {{cols}}, {{hour}} AS h, count(*) OVER (PARTITION BY {{ip}}, {{hour}}) AS c FROM {{src}}))
  WHERE h = first_h AND rn = {q + 1}"""
    first = step.format(cols="ip, us, id", hour="us // 3600000000", ip="ip", src="ev")
    nxt = step.format(cols="e.ip, e.us, e.id", hour="e.us // 3600000000", ip="e.ip",
                      src="ev e JOIN bans b ON e.ip = b.ip AND e.us >= b.ban_end_us")
    return f"""WITH RECURSIVE ev AS (
  SELECT CAST(user_id AS VARCHAR) AS ip, epoch_us(CAST(ts AS TIMESTAMP)) AS us, event_id AS id FROM events),
bans(ip, ban_start_us, ban_end_us) AS (
  {first}
  UNION ALL
  {nxt})
SELECT ip, make_timestamp(ban_start_us) AS ban_start, make_timestamp(ban_end_us) AS ban_end FROM bans"""


@register("hourly_quota_bans", _quota_sql(2))
def q_quota(spark, sf):
    b = G.hourly_quota_bans(_log(spark, sf), quota=2)
    return b.select("ip", F.col("ban_start").cast("timestamp_ntz").alias("ban_start"),
                    F.col("ban_end").cast("timestamp_ntz").alias("ban_end"))


# ---------------------------------------------------------------- the burst log, the real limits
_BASE_US = 1704067200_000000


def _burst(us: str, div: str) -> str:
    """SQL of the time in microseconds; ``div`` is integer division."""
    x = f"({us} - {_BASE_US})"
    spell = f"({x} {div} 864000000000)"
    within = f"(({x} % 864000000000) {div} 80)"
    return f"({_BASE_US} + {spell} * 172800000000 + ({within} {div} 3600000000) * 3600000000 + ({within} % 3600000000) {div} 30)"


_KIND = "CASE event_type WHEN 'error' THEN 'auth' WHEN 'click' THEN 'analyze' WHEN 'view' THEN 'analyze' ELSE 'general' END"
BURST_SQL = f"""SELECT event_id AS id, {_burst('epoch_us(CAST(ts AS TIMESTAMP))', '//')} AS us,
  CASE WHEN user_id % 3 < 2 THEN 'hot' ELSE 'u' || (user_id % 7) END AS ip, {_KIND} AS type FROM events"""
# bans of a minute and a touching one in the first spell, a whole spell for one client
BURST_BANS_SQL = """SELECT ip, min(us) + 20000000 AS s, min(us) + 60000000 AS e FROM log WHERE ip <> 'hot' GROUP BY ip
  UNION ALL SELECT ip, min(us) + 60000000, min(us) + 75000000 FROM log WHERE ip <> 'hot' GROUP BY ip
  UNION ALL SELECT 'u1', 1704240000000000, 1704240000000000 + 86400000000"""


def _burst_log(spark, sf):
    us = _burst("unix_micros(CAST(ts AS TIMESTAMP))", "div")
    return load(spark, sf, "events").selectExpr(
        "event_id AS id", f"timestamp_micros({us}) AS ts",
        "CASE WHEN user_id % 3 < 2 THEN 'hot' ELSE concat('u', user_id % 7) END AS ip", f"{_KIND} AS type")


def _burst_bans(spark, sf):
    first = _burst_log(spark, sf).where("ip <> 'hot'").groupBy("ip").agg(F.min("ts").alias("m"))
    short = first.selectExpr("ip", "m + INTERVAL 20 SECONDS AS start", "40 AS duration")
    touching = first.selectExpr("ip", "m + INTERVAL 60 SECONDS AS start", "15 AS duration")
    spell = spark.sql("SELECT 'u1' AS ip, timestamp_micros(1704240000000000) AS start, CAST(NULL AS INT) AS duration")
    return short.unionByName(touching).unionByName(spell)


def _limit(kind: str) -> str:
    return f"CASE {kind} WHEN 'auth' THEN 10 WHEN 'analyze' THEN 30 ELSE 100 END"


@register("rate_limit_windows_burst", f"""SELECT type, ip, make_timestamp(us // 60000000 * 60000000) AS window_start, count(*) AS requests,
  {_limit('type')} AS allowed, count(*) - {_limit('type')} AS rejected FROM ({BURST_SQL})
GROUP BY type, ip, us // 60000000 HAVING count(*) > {_limit('type')}""")
def q_windows_burst(spark, sf):
    return G.rate_limit_windows(_burst_log(spark, sf)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("rate_limit_rejections", f"""SELECT id, make_timestamp(us) AS ts, ip, type FROM (SELECT *, row_number() OVER (
    PARTITION BY type, ip, us // 60000000 ORDER BY us, id) AS rn FROM ({BURST_SQL})) WHERE rn > {_limit('type')}""")
def q_rate_rows(spark, sf):
    return G.rate_limit_rejections(_burst_log(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _gate_ctes() -> str:
    """W3, W2 and W1 in this order as CTE ``decided`` (id, us, ip, type, decision)."""
    step = """SELECT ip, us, id FROM (SELECT ip, us, id, h, row_number() OVER (PARTITION BY ip, h ORDER BY us, id) AS rn,
      min(CASE WHEN c > 500 THEN h END) OVER (PARTITION BY ip) AS first_h
    FROM (SELECT o.ip, o.us, o.id, o.us // 3600000000 AS h, count(*) OVER (PARTITION BY o.ip, o.us // 3600000000) AS c FROM {src}))
  WHERE h = first_h AND rn = 501"""
    return f"""WITH RECURSIVE log AS MATERIALIZED ({BURST_SQL}),
manual AS ({BURST_BANS_SQL}),
flagged AS MATERIALIZED (SELECT *, EXISTS (SELECT 1 FROM manual m WHERE m.ip = l.ip AND l.us >= m.s AND l.us < m.e) AS held FROM log l),
open_ AS (SELECT ip, us, id FROM flagged WHERE NOT held),
trig(ip, us, id) AS ({step.format(src='open_ o')}
  UNION ALL {step.format(src='open_ o JOIN trig t ON o.ip = t.ip AND o.us >= t.us + 86400000000')}),
counted AS (SELECT f.id, f.us, f.ip, f.type, CASE WHEN held THEN 'banned'
    WHEN EXISTS (SELECT 1 FROM trig t WHERE t.id = f.id) THEN 'quota'
    WHEN EXISTS (SELECT 1 FROM trig t WHERE t.ip = f.ip AND (f.us, f.id) > (t.us, t.id) AND f.us < t.us + 86400000000) THEN 'banned'
    ELSE 'counted' END AS d FROM flagged f),
decided AS (SELECT id, us, ip, type, CASE WHEN d <> 'counted' THEN d WHEN row_number() OVER (
    PARTITION BY d, type, ip, us // 60000000 ORDER BY us, id) > {_limit('type')} THEN 'limited' ELSE 'passed' END AS decision FROM counted)"""


_SUMMARY_SQL = _gate_ctes() + """
SELECT type, ip, make_timestamp(us // 60000000 * 60000000) AS window_start, count(*) AS requests,
  count(*) FILTER (WHERE decision = 'banned') AS banned, count(*) FILTER (WHERE decision = 'quota') AS over_quota,
  count(*) FILTER (WHERE decision = 'limited') AS limited, count(*) FILTER (WHERE decision = 'passed') AS passed
FROM decided GROUP BY type, ip, us // 60000000"""


@register("gate_decisions", _gate_ctes() + "\nSELECT id, ip, type, make_timestamp(us) AS ts, decision FROM decided")
def q_gate(spark, sf):
    out = G.gate_decisions(_burst_log(spark, sf), _burst_bans(spark, sf))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("gate_summary", _SUMMARY_SQL)
def q_gate_summary(spark, sf):
    out = G.gate_summary(G.gate_decisions(_burst_log(spark, sf), _burst_bans(spark, sf)))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("hourly_quota_bans_burst", _gate_ctes().replace("WHERE m.ip = l.ip", "WHERE FALSE AND m.ip = l.ip") + """
SELECT ip, make_timestamp(us) AS ban_start, make_timestamp(us + 86400000000) AS ban_end FROM trig""")
def q_quota_burst(spark, sf):
    b = G.hourly_quota_bans(_burst_log(spark, sf))
    return b.select("ip", F.col("ban_start").cast("timestamp_ntz").alias("ban_start"), F.col("ban_end").cast("timestamp_ntz").alias("ban_end"))


# ---------------------------------------------------------------- replayed streams
def _arrived(spark, sf, name, table, batches, jitter, closing=None):
    """The folder of a table's arrivals, made once a session, as a stream of one file a batch."""
    key = (spark.sparkContext.applicationId, id(spark), sf, "arrivals", name, _stamp(load(spark, sf, "events")))
    if key not in _LANDED:
        _LANDED[key] = S.arrivals(table, "ts", batches, jitter, name, closing)
    return S.file_stream(spark, _LANDED[key], table.schema, 1)


def _burst_stream(spark, sf):
    return _arrived(spark, sf, "burst", _burst_log(spark, sf), 4, 45, {"ip": "", "id": -1, "type": "general"})


def _stamped(df, *cols):
    return df.where("ip <> ''").withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@register("gate_stream", _SUMMARY_SQL)
def q_gate_stream(spark, sf):
    bans = land(_burst_bans(spark, sf), "bans")  # every batch reads them
    out = S.run_to_table(S.gate_stream(_burst_stream(spark, sf), bans, watermark="1 minute"), "gate", "append", rocksdb=True)
    return _stamped(out, "window_start")


@register("rate_limit_stream", SQL["rate_limit_windows_burst"])
def q_rate_stream(spark, sf):
    out = S.run_to_table(S.rate_limit_stream(_burst_stream(spark, sf), watermark="1 minute"), "rates", "append")
    return _stamped(out, "window_start")


def _log_stream(spark, sf, closing=True):
    log = load(spark, sf, "events").selectExpr("event_id AS id", "CAST(ts AS TIMESTAMP) AS ts", "CAST(user_id AS STRING) AS ip",
                                               "event_type AS type", "value", "user_id")
    return _arrived(spark, sf, "log" if closing else "log-open", log, 4, 6 * 3600, {"ip": "", "id": -1} if closing else None)


# ---------------------------------------------------------------- streaming (W6-W8): batch SQL as oracle
def _event_stream(spark, sf):
    ev = load(spark, sf, "events")
    stream = S.file_stream(spark, f"{sf}/events*.parquet", ev.schema)
    return S.typed_events(stream, "value", "ts", "user_id")


_STREAM_BASE = "(SELECT CASE WHEN isfinite(value) THEN value END AS amount, CAST(ts AS TIMESTAMP) AS event_ts, CAST(user_id AS VARCHAR) AS user_key FROM events WHERE ts IS NOT NULL)"


@register("daily_trend_stream", f"""SELECT strftime(event_ts, '%Y-%m-%d') AS day, {R('sum(coalesce(amount, 0.0))')} AS val,
  count(*) AS count FROM {_STREAM_BASE} GROUP BY 1""")
def q_daily_stream(spark, sf):
    return S.run_to_table(S.daily_trend_stream(_event_stream(spark, sf)), "daily", "complete")


@register("monthly_trend_stream", f"""SELECT strftime(event_ts, '%Y-%m') AS month, {R('sum(coalesce(amount, 0.0))')} AS val,
  count(*) AS count FROM {_STREAM_BASE} GROUP BY 1""")
def q_monthly_stream(spark, sf):
    return S.run_to_table(S.monthly_trend_stream(_event_stream(spark, sf)), "monthly", "complete")


@register("dedup_stream", f"""SELECT day, count(*) AS kept FROM (SELECT DISTINCT user_key, coalesce(CAST(amount AS VARCHAR), 'null') AS a,
  strftime(event_ts, '%Y-%m-%d') AS day FROM {_STREAM_BASE}) GROUP BY day""")
def q_dedup_stream(spark, sf):
    return S.run_to_table(S.dedup_stream(_event_stream(spark, sf)), "dedup", "append").groupBy("day").agg(F.count("*").alias("kept"))


@register("hourly_quota_bans_stream", _quota_sql(2))
def q_quota_stream(spark, sf):
    out = S.run_to_table(S.hourly_quota_stream(_log_stream(spark, sf), quota=2, watermark="7 hours"), "quota", "append", rocksdb=True)
    return out.select("ip", F.timestamp_micros("ban_start_us").cast("timestamp_ntz").alias("ban_start"),
                      F.timestamp_micros("ban_end_us").cast("timestamp_ntz").alias("ban_end"))


@register("rapid_repeat_stream", f"""SELECT count(*) AS pairs FROM (
  SELECT epoch_ms(event_ts) - lag(epoch_ms(event_ts)) OVER (PARTITION BY user_key ORDER BY event_ts) AS gap
  FROM {_STREAM_BASE} WHERE user_key IS NOT NULL) WHERE gap < 60000""")
def q_rapid_stream(spark, sf):
    out = S.run_to_table(S.rapid_repeat_stream(_event_stream(spark, sf)), "rapid", "update")
    return S.rapid_repeat_pairs(out).select(F.coalesce(F.col("pairs"), F.lit(0)).cast("long").alias("pairs"))


def _arriving_events(spark, sf):
    return S.typed_events(_log_stream(spark, sf, closing=False), "value", "ts", "user_id")


@register("daily_trend_arrivals", SQL["daily_trend_stream"])
def q_daily_arrivals(spark, sf):
    return S.run_to_table(S.daily_trend_stream(_arriving_events(spark, sf)), "daily", "complete")


@register("dedup_arrivals", SQL["dedup_stream"])
def q_dedup_arrivals(spark, sf):
    return S.run_to_table(S.dedup_stream(_arriving_events(spark, sf)), "dedup", "append").groupBy("day").agg(F.count("*").alias("kept"))


@register("rapid_repeat_arrivals", SQL["rapid_repeat_stream"])
def q_rapid_arrivals(spark, sf):
    out = S.run_to_table(S.rapid_repeat_stream(_arriving_events(spark, sf)), "rapid", "update", merge=S.newest_buckets, every=2)
    return S.rapid_repeat_pairs(out).select(F.coalesce(F.col("pairs"), F.lit(0)).cast("long").alias("pairs"))
