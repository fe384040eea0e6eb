"""Request gate over a request log (W1-W5, M13), each part alone and all in their order.

The log is any DataFrame with a timestamp, a client key (``ip``), a request
class (``type``) and a stable row id for tie-breaks.  Windows are epoch-aligned
like the counters they replace.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import as_of_col, epoch_micros
from ..session import ensure_checkpoint_dir, land
from ..model import ACTIVITY_TTL_DAYS, BAN_SECONDS, HOURLY_QUOTA, RATE_LIMITS

SEC_US = 1_000_000
MINUTE_US = 60 * SEC_US
HOUR_US = 3600 * SEC_US
#: Time bins in which requests and bans of a client meet.
BIN_SECONDS = 3600


def request_class(path: Column) -> Column:
    """Which limit applies to a request path."""
    return F.when(path == "/api/auth/google", "auth").when(path == "/api/analyze", "analyze").otherwise("general")


def limit_for(type_: Column, limits: dict = RATE_LIMITS) -> Column:
    out = None
    for k, v in limits.items():
        out = F.when(type_ == k, F.lit(v["max"])) if out is None else out.when(type_ == k, F.lit(v["max"]))
    return out.otherwise(F.lit(limits.get("general", {"max": 100})["max"]))


def rate_limit_windows(log: DataFrame, ts: str = "ts", ip: str = "ip", type_: str = "type",
                       window_s: int = 60, limits: dict = RATE_LIMITS, max_col: Column | None = None) -> DataFrame:
    """Per (type, ip, epoch window) the first ``max`` requests pass and the rest are
    rejected (rejected requests are not counted).  An aggregate: no per-window sort."""
    mx = max_col if max_col is not None else limit_for(F.col(type_), limits)
    w = F.floor(epoch_micros(ts) / (window_s * SEC_US))
    g = log.groupBy(F.col(type_).alias("type"), F.col(ip).alias("ip"), w.alias("window")) \
        .agg(F.count("*").alias("requests"))
    g = g.withColumn("limit", mx if max_col is not None else limit_for(F.col("type"), limits))
    return g.select("type", "ip", F.timestamp_seconds(F.col("window") * window_s).alias("window_start"),
                    "requests", F.least("requests", "limit").alias("allowed"),
                    F.greatest(F.col("requests") - F.col("limit"), F.lit(0)).alias("rejected")) \
        .where(F.col("rejected") > 0)


def rate_limit_rejections(log: DataFrame, ts: str = "ts", ip: str = "ip", type_: str = "type",
                          id_col: str = "id", window_s: int = 60, limits: dict = RATE_LIMITS,
                          max_requests: int | None = None) -> DataFrame:
    """W1 row form: the rejected requests themselves.

    The allowed requests are the first ``max`` of each (type, ip, window): a per-window
    top-k whose literal bound lets Spark keep only k rows per window in every map task
    before the shuffle, so a hot client's window never lands whole in one task.  The
    rejected requests are then every other request (anti join on the request id)."""
    top = max_requests if max_requests is not None else max(v["max"] for v in limits.values())
    mx = F.lit(max_requests) if max_requests is not None else limit_for(F.col(type_), limits)
    w = F.floor(epoch_micros(ts) / (window_s * SEC_US))
    keyed = log.select(type_, ip, ts, id_col, w.alias("_w"), mx.alias("_max"))
    win = Window.partitionBy(type_, ip, "_w").orderBy(ts, id_col)
    allowed = keyed.withColumn("_rn", F.row_number().over(win)).where(F.col("_rn") <= top) \
        .where(F.col("_rn") <= F.col("_max")).select(id_col)
    return log.join(allowed, id_col, "left_anti")


def merged_intervals(bans: DataFrame) -> DataFrame:
    """(ip, start_us, end_us) without overlaps: intervals of one client that touch become one."""
    w = Window.partitionBy("ip").orderBy("start_us", "end_us")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    b = bans.where(F.col("end_us") > F.col("start_us")).withColumn(
        "_new", F.coalesce(F.col("start_us") > F.max("end_us").over(before), F.lit(True)).cast("int"))
    b = b.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("ip", "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_island")


def within(rows: DataFrame, intervals: DataFrame, bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """Left join of ``rows`` (ip, us) with the disjoint ``intervals`` [start_us, end_us) that hold them.

    Both sides meet on the client and a time bin: an interval stands in every bin it touches, so a client
    with many requests and many bans is many keys, each with a few intervals."""
    width = bin_seconds * SEC_US
    cols = [c for c in intervals.columns if c != "ip"]
    bins = F.sequence(F.floor(F.col("start_us") / width), F.floor((F.col("end_us") - 1) / width))
    b = intervals.select(F.col("ip").alias("_bip"), *cols, F.explode(bins).alias("_bbin"))
    r = rows.withColumn("_bin", F.floor(F.col("us") / width))
    cond = (r["ip"] == b["_bip"]) & (r["_bin"] == b["_bbin"]) & (r["us"] >= b["start_us"]) & (r["us"] < b["end_us"])
    return r.join(b, cond, "left").drop("_bip", "_bbin", "_bin")


def ban_intervals(bans: DataFrame, ip: str = "ip", default_seconds: int = BAN_SECONDS) -> DataFrame:
    """Manual bans (client, ``start`` and, or else ``default_seconds``, ``duration``) as merged intervals."""
    seconds = F.coalesce(F.col("duration"), F.lit(default_seconds)) if "duration" in bans.columns else F.lit(default_seconds)
    start = epoch_micros("start")
    return merged_intervals(bans.where(F.col(ip).isNotNull() & F.col("start").isNotNull()).select(
        F.col(ip).cast("string").alias("ip"), start.alias("start_us"), (start + seconds.cast("bigint") * SEC_US).alias("end_us")))


def apply_manual_bans(log: DataFrame, bans: DataFrame, ts: str = "ts", ip: str = "ip",
                      default_seconds: int = BAN_SECONDS, bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """Drop requests from a banned client during [start, start + duration): an interval join on client
    and time bin.  Requests without client or time are kept."""
    rows = log.select(F.struct(*[F.col(f"`{c}`") for c in log.columns]).alias("_row"), F.col(ip).cast("string").alias("ip"),
                      epoch_micros(ts).alias("us"))
    kept = within(rows, ban_intervals(bans, ip, default_seconds), bin_seconds).where(F.col("start_us").isNull())
    return kept.select("_row.*")


def activity_retention(log: DataFrame, as_of=None, ts: str = "ts", days: int = ACTIVITY_TTL_DAYS) -> DataFrame:
    """Keep log rows newer than ``as_of - 7 days``."""
    return log.where(F.col(ts) > as_of_col(as_of) - F.expr(f"INTERVAL {days} DAYS"))


def recent_activity(log: DataFrame, ts: str = "ts", id_col: str | None = None, k: int = 200) -> DataFrame:
    """The newest 200 log rows (a top-k: per-partition top-k, then one merge)."""
    order = [F.col(ts).desc()] + ([F.col(id_col).desc()] if id_col else [])
    return log.orderBy(*order).limit(k)


def _positions(log: DataFrame, quota: int) -> tuple[DataFrame, DataFrame]:
    """Requests of the busy hours (more than ``quota``) with their position in the hour, and the hours' minutes.

    Positions are counted by minutes first, so that a hot client's hour is sixty keys and no window holds it
    whole: (ip, hour, pos, us, id) and, for all sixty minutes of a busy hour, (ip, hour, minute, before, total)."""
    rows = log.withColumn("minute", F.floor(F.col("us") / MINUTE_US))
    per_minute = rows.groupBy("ip", "minute").agg(F.count("*").alias("n"))
    hours = per_minute.groupBy("ip", F.floor(F.col("minute") / 60).alias("hour")).agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("minute", "n"))).alias("of"))  # at most 60
    w = Window.partitionBy("ip", "hour").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = hours.where(F.col("total") > quota).select(
        "ip", "hour", "total", "of", F.explode(F.sequence(F.col("hour") * 60, F.col("hour") * 60 + 59)).alias("minute"))
    minutes = minutes.withColumn("n", F.coalesce(F.col("of")[F.col("minute")], F.lit(0))).withColumn(
        "before", F.coalesce(F.sum("n").over(w), F.lit(0))).select("ip", "hour", "minute", "before", "total")
    minutes = land(minutes, "quota-minutes")
    own = Window.partitionBy("ip", "minute").orderBy("us", "id")
    found = rows.join(minutes, ["ip", "minute"]).select(
        "ip", "hour", (F.col("before") + F.row_number().over(own)).alias("pos"), "us", "id")
    return land(found, "quota-positions"), minutes


def _next_triggers(positions: DataFrame, minutes: DataFrame, quota: int, ban_us: int) -> DataFrame:
    """(ip, us, id, next_us, next_id): for every request that could start a ban, the one that starts the next.

    The ban of a request ends at ``us + ban``, where counting begins anew.  If more than ``quota`` requests of
    that hour come later, the next trigger is the (quota+1)-th of them; else it is the (quota+1)-th request of
    the next busy hour."""
    nodes = positions.where(F.col("pos") > quota).select("ip", "us", "id", (F.col("us") + ban_us).alias("end_us"))
    nodes = nodes.withColumns({"minute": F.floor(F.col("end_us") / MINUTE_US), "end_hour": F.floor(F.col("end_us") / HOUR_US)})
    fresh = positions.where(F.col("pos") == quota + 1).select("ip", F.col("hour").alias("next_hour"), F.col("us").alias("fresh_us"),
                                                              F.col("id").alias("fresh_id"))

    # requests before the end of the ban in the minute it ends in: ends and requests of a minute in one order
    marks = positions.select("ip", F.floor(F.col("us") / MINUTE_US).alias("minute"), F.col("us").alias("at"), F.lit(1).alias("n")) \
        .unionByName(nodes.select("ip", "minute", F.col("end_us").alias("at"), F.lit(0).alias("n")).distinct())
    order = Window.partitionBy("ip", "minute").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    earlier = marks.withColumn("earlier", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("n") == 0).select(
        "ip", F.col("at").alias("end_us"), "minute", "earlier")
    ends = earlier.join(minutes, ["ip", "minute"]).select(
        "ip", "end_us", "hour", (F.col("before") + F.col("earlier") + 1 + quota).alias("pos"))
    same = ends.join(positions.select("ip", "hour", "pos", F.col("us").alias("same_us"), F.col("id").alias("same_id")),
                     ["ip", "hour", "pos"]).select("ip", "end_us", "same_us", "same_id")

    # next busy hour after the hour the ban ends in: hours of a client, not requests
    hours = fresh.select("ip", F.col("next_hour").alias("h"), F.lit(True).alias("busy")).unionByName(
        nodes.select("ip", F.col("end_hour").alias("h"), F.lit(False).alias("busy")).distinct())
    after = Window.partitionBy("ip").orderBy("h").rangeBetween(1, Window.unboundedFollowing)
    later = hours.withColumn("next_hour", F.min(F.when(F.col("busy"), F.col("h"))).over(after)).where(~F.col("busy")).select(
        "ip", F.col("h").alias("end_hour"), "next_hour").join(fresh, ["ip", "next_hour"])
    found = nodes.join(same, ["ip", "end_us"], "left").join(later.select("ip", "end_hour", "fresh_us", "fresh_id"),
                                                            ["ip", "end_hour"], "left")
    here = F.col("same_us").isNotNull()
    return found.select("ip", "us", "id", F.when(here, F.col("same_us")).otherwise(F.col("fresh_us")).alias("next_us"),
                        F.when(here, F.col("same_id")).otherwise(F.col("fresh_id")).alias("next_id")) \
        .where(F.col("next_us").isNotNull())


def quota_triggers(log: DataFrame, quota: int = HOURLY_QUOTA, ban_seconds: int = BAN_SECONDS) -> DataFrame:
    """W2 by jump pointers over a log (ip, us, id): the requests (ip, us, id) that start a ban.

    Every request that could start a ban points to the one that would start the next.  Pointers are doubled
    round by round while the requests reached from a client's first trigger double too, so a client of b bans
    takes log2(b) rounds, whatever the other clients do; the driver reads one flag a round."""
    if ban_seconds < 1:
        raise ValueError("a ban lasts a second at least")
    ensure_checkpoint_dir(log.sparkSession)
    positions, minutes = _positions(log, quota)
    jump = land(_next_triggers(positions, minutes, quota, ban_seconds * SEC_US), "quota-jumps")
    first = positions.where(F.col("pos") == quota + 1).groupBy("ip").agg(F.min(F.struct("us", "id")).alias("t"))
    reached = land(first.select("ip", "t.us", "t.id"), "quota-reached")
    while True:
        far = reached.join(jump, ["ip", "us", "id"]).select("ip", F.col("next_us").alias("us"), F.col("next_id").alias("id"))
        wider = land(reached.withColumn("_far", F.lit(False)).unionByName(far.withColumn("_far", F.lit(True))), "quota-reached")
        reached = wider.drop("_far")
        if wider.where("_far").isEmpty():
            return reached
        second = jump.select("ip", F.col("us").alias("next_us"), F.col("id").alias("next_id"),
                             F.col("next_us").alias("far_us"), F.col("next_id").alias("far_id"))
        jump = land(jump.join(second, ["ip", "next_us", "next_id"]).select(
            "ip", "us", "id", F.col("far_us").alias("next_us"), F.col("far_id").alias("next_id")), "quota-jumps")


def _keyed(log: DataFrame, ts: str, ip: str, id_col: str) -> DataFrame:
    return log.select(F.col(ip).cast("string").alias("ip"), epoch_micros(ts).alias("us"), F.col(id_col).alias("id")).where(
        "ip IS NOT NULL AND us IS NOT NULL")


def hourly_quota_bans(log: DataFrame, ts: str = "ts", ip: str = "ip", quota: int = HOURLY_QUOTA,
                      ban_seconds: int = BAN_SECONDS, id_col: str = "id") -> DataFrame:
    """Over ``quota`` counted requests of one client in an epoch hour -> banned for ``ban_seconds``
    from that request; requests while banned are refused and not counted.  ``ip, ban_start, ban_end``."""
    found = quota_triggers(_keyed(log, ts, ip, id_col), quota, ban_seconds)
    return found.select("ip", F.timestamp_micros("us").alias("ban_start"),
                        F.timestamp_micros(F.col("us") + ban_seconds * SEC_US).alias("ban_end"))


def gate_decisions(log: DataFrame, bans: DataFrame | None = None, ts: str = "ts", ip: str = "ip", type_: str = "type",
                   id_col: str = "id", quota: int = HOURLY_QUOTA, ban_seconds: int = BAN_SECONDS, limits: dict = RATE_LIMITS,
                   window_s: int = 60) -> DataFrame:
    """The whole gate in its order: ``id, ip, type, ts, decision`` of every request.

    ``banned``: within a manual ban (W3) or a quota ban (W2), not counted by what follows; ``quota``: the request
    that starts a ban; ``limited``: beyond its class's limit in the window (W1), counted by the hour only;
    ``passed``.  Requests without client or time are ``passed``; ids tell requests of the same time apart."""
    rows = log.select(F.col(id_col).alias("id"), F.col(ip).cast("string").alias("ip"), F.col(type_).alias("type"),
                      F.col(ts).alias("ts"), epoch_micros(ts).alias("us"))
    if bans is not None:
        rows = within(rows, ban_intervals(bans, default_seconds=ban_seconds)).withColumn("manual", F.col("start_us").isNotNull()) \
            .drop("start_us", "end_us")
    else:
        rows = rows.withColumn("manual", F.lit(False))
    rows = land(rows, "gate-rows")
    found = quota_triggers(rows.where("NOT manual AND ip IS NOT NULL AND us IS NOT NULL").select("ip", "us", "id"), quota, ban_seconds)
    own = found.select("ip", F.col("us").alias("start_us"), (F.col("us") + ban_seconds * SEC_US).alias("end_us"),
                       F.col("id").alias("trigger_id"))
    met = within(rows, own, max(BIN_SECONDS, ban_seconds // 8))
    after = (F.col("us") > F.col("start_us")) | (F.col("id") > F.col("trigger_id"))
    met = met.withColumn("decision", F.when(F.col("manual"), "banned").when(F.col("id") == F.col("trigger_id"), "quota")
                         .when(F.col("trigger_id").isNotNull() & after, "banned")).select("id", "ip", "type", "ts", "us", "decision")
    met = land(met, "gate-counted")
    # the first requests of a window pass: a top-k with a fixed bound, cut in every task before the shuffle
    most = max(v["max"] for v in limits.values())
    first = Window.partitionBy("type", "ip", "_w").orderBy("us", "id")
    open_ = met.where("decision IS NULL AND ip IS NOT NULL AND us IS NOT NULL").withColumn("_w", F.floor(F.col("us") / (window_s * SEC_US)))
    allowed = open_.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= most).where(
        F.col("_rn") <= limit_for(F.col("type"), limits)).select("id", F.lit(True).alias("_ok"))
    done = met.join(allowed, "id", "left")
    free = F.col("_ok").isNotNull() | F.col("ip").isNull() | F.col("us").isNull()
    return done.select("id", "ip", "type", "ts", F.coalesce("decision", F.when(free, "passed").otherwise("limited")).alias("decision"))


def gate_summary(decisions: DataFrame, ts: str = "ts", window_s: int = 60) -> DataFrame:
    """Requests by class, client and window: how many were banned, over quota, limited and passed."""
    w = F.floor(epoch_micros(ts) / (window_s * SEC_US))
    counts = [F.count_if(F.col("decision") == d).alias(n) for d, n in (("banned", "banned"), ("quota", "over_quota"),
                                                                       ("limited", "limited"), ("passed", "passed"))]
    g = decisions.groupBy("type", "ip", w.alias("_w")).agg(F.count("*").alias("requests"), *counts)
    return g.select("type", "ip", F.timestamp_seconds(F.col("_w") * window_s).alias("window_start"), "requests", "banned",
                    "over_quota", "limited", "passed")
