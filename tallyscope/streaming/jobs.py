"""Structured Streaming forms of the gate, trend, dedup and rapid-repeat jobs.

Sources are file streams; results go through the replayable sink of :mod:`sink`, and checkpoints make
every query restartable after executor or driver loss.  State is bounded by watermarks: a window, a
signature, a bucket or a client leaves the state when the watermark has passed it.
"""

from __future__ import annotations

import os
import uuid
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import day_key, epoch_micros, month_key
from ..functions.numbers import finite_or_null, round_half_up
from ..model import BAN_SECONDS, HOURLY_QUOTA, RATE_LIMITS
from ..operators.anomalies import pairs_of_buckets
from ..operators.gate import ban_intervals, limit_for, within
from ..session import ensure_checkpoint_dir
from .sink import run_to_table  # noqa: F401  (the runner of all jobs)


def file_stream(spark: SparkSession, pattern: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.format("parquet").schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(pattern)


def arrivals(df: DataFrame, ts: str, batches: int, jitter_seconds: int, name: str = "arrivals", closing: dict | None = None) -> str:
    """Write a table as files in the order its rows arrive, for a replay as a stream of ``batches`` batches.

    A row arrives up to ``jitter_seconds`` after its time (by a hash of the row), so batches hold rows out of
    order.  ``closing``: column values of a last row, ten days after all others, whose file moves the watermark
    past them."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:8]}")
    late = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(jitter_seconds * 1_000_000 + 1))
    dealt = df.withColumn("_at", epoch_micros(ts) + late)
    cuts = [i / batches for i in range(1, batches)]
    at = dealt.agg(F.percentile_approx("_at", cuts, 1000).alias("c"), F.max(ts).alias("end")).first()
    for i, (lo, hi) in enumerate(zip([None, *(at.c or [])], [*(at.c or []), None])):
        part = dealt.where(F.lit(True) if lo is None else F.col("_at") > lo).where(F.lit(True) if hi is None else F.col("_at") <= hi)
        part.drop("_at").repartition(1).write.mode("append").parquet(path)  # one file, though all tasks read for it
    if closing is not None:
        last = {ts: F.lit(at.end) + F.expr("INTERVAL 10 DAYS"), **{k: F.lit(v) for k, v in closing.items()}}
        spark.range(1).select(*[last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema]).coalesce(1) \
            .write.mode("append").parquet(path)
    return path


def typed_events(stream: DataFrame, amount: str, ts: str, user: str | None = None) -> DataFrame:
    cols = [finite_or_null(amount).alias("amount"), F.col(ts).cast("timestamp").alias("event_ts")]
    if user:
        cols.append(F.col(user).cast("string").alias("user_key"))
    return stream.select(*cols).where(F.col("event_ts").isNotNull())


def daily_trend_stream(events: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Running per-UTC-day sums (complete mode keeps every day current)."""
    return events.withWatermark("event_ts", watermark).groupBy(F.window("event_ts", "1 day").alias("w")) \
        .agg(F.sum(F.coalesce(F.col("amount"), F.lit(0.0))).alias("_v"), F.count("*").alias("count")) \
        .select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), round_half_up(F.col("_v")).alias("val"),
                "count")


def monthly_trend_stream(events: DataFrame) -> DataFrame:
    """Running per-month sums (complete mode)."""
    return events.groupBy(month_key("event_ts").alias("month")) \
        .agg(F.sum(F.coalesce(F.col("amount"), F.lit(0.0))).alias("_v"), F.count("*").alias("count")) \
        .select("month", round_half_up(F.col("_v")).alias("val"), "count")


def dedup_stream(events: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Drop signature repeats (user, amount, day).  A signature holds one day, so it leaves the state when the
    watermark has passed that day by as much again: rows up to ``watermark`` late are told apart exactly."""
    sig = events.withColumn("day", day_key("event_ts")) \
        .withColumn("_amt", F.coalesce(F.col("amount").cast("string"), F.lit("null")))
    return sig.withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark(["user_key", "_amt", "day"]) \
        .drop("_amt")


def rapid_repeat_stream(events: DataFrame, gap_seconds: float = 60.0, watermark: str | None = "2 days") -> DataFrame:
    """Running count, first and last millisecond of each user's buckets of ``gap_seconds``
    (update mode); ``rapid_repeat_pairs`` counts the pairs of what was written.

    Rows may arrive in any order and in any batch, and a hot user is split by bucket.  Buckets older than
    the watermark leave the state and rows older than it are not counted; without one (None) every
    non-empty bucket stays in state and no row is ever too late.
    """
    keyed = events.where(F.col("user_key").isNotNull())
    if watermark:
        keyed = keyed.withWatermark("event_ts", watermark)
    ms = F.floor(epoch_micros("event_ts") / 1000)
    bucket = F.window("event_ts", f"{int(gap_seconds * 1000)} milliseconds").alias("w")
    return keyed.groupBy("user_key", bucket).agg(F.count("*").alias("_c"), F.min(ms).alias("_lo"), F.max(ms).alias("_hi")) \
        .select("user_key", F.col("w.start").alias("_b"), "_c", "_lo", "_hi")


def newest_buckets(written: DataFrame) -> DataFrame:
    """One row a bucket of what ``rapid_repeat_stream`` wrote (and the merger of its sink's compactions): a bucket's
    count only grows, so its newest state is its largest."""
    return written.groupBy("user_key", "_b").agg(F.max("_c").alias("_c"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))


def rapid_repeat_pairs(written: DataFrame, gap_seconds: float = 60.0) -> DataFrame:
    """Pairs in the rows that ``rapid_repeat_stream`` wrote."""
    return pairs_of_buckets(newest_buckets(written), [], int(gap_seconds * 1000))


# --------------------------------------------------------------------------- W1
def rate_limit_stream(log: DataFrame, ts: str = "ts", ip: str = "ip", type_: str = "type", window_s: int = 60,
                      limits: dict = RATE_LIMITS, watermark: str = "10 minutes") -> DataFrame:
    """W1 streaming (append mode): a window's counts appear once, when the watermark has passed its end, if
    requests were rejected in it.  Only windows not yet passed are in state."""
    w = F.window("ts", f"{window_s} seconds").alias("w")
    g = log.select(F.col(type_).alias("type"), F.col(ip).alias("ip"), F.col(ts).cast("timestamp").alias("ts")) \
        .withWatermark("ts", watermark).groupBy("type", "ip", w).agg(F.count("*").alias("requests"))
    limit = limit_for(F.col("type"), limits)
    return g.where(F.col("requests") > limit).select(
        "type", "ip", F.col("w.start").alias("window_start"), "requests", limit.cast("bigint").alias("allowed"),
        (F.col("requests") - limit).alias("rejected"))


# --------------------------------------------------------------------------- W2, W3 and the gate
DECIDED = "ip string, type string, us bigint, id bigint, decision string, slot timestamp"
TALLIED = "ip string, type string, slot timestamp, requests bigint, banned bigint, quota bigint, counted bigint"
_DECISIONS = ("banned", "quota", "counted")
_COUNTED = "hour bigint, count bigint, ban_end_us bigint"
#: Rows of one frame that a processor returns.
_FRAME = 1 << 17
HOUR_US = 3_600_000_000


def _quota_processor(quota: int, ban_us: int, slice_us: int, report: str):
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    def decide(us: np.ndarray, manual: np.ndarray, counted: tuple) -> tuple[np.ndarray, tuple]:
        """Decisions (index in ``_DECISIONS``) of a client's next requests in their order, and its hour, count and ban after
        them.  A loop step is an hour or a ban, not a request."""
        hour, count, ban_end = counted
        out = np.zeros(len(us), np.int8)
        rows = np.flatnonzero(~manual)
        at = us[rows]
        pos = 0 if ban_end is None else int(np.searchsorted(at, ban_end))
        while pos < len(at):
            if at[pos] // HOUR_US != hour:
                hour, count = int(at[pos] // HOUR_US), 0
            end = int(np.searchsorted(at, (hour + 1) * HOUR_US))
            over = pos + quota - count  # the request that starts a ban, if it is of this hour
            out[rows[pos:min(over, end)]] = 2
            if over >= end:
                count, pos = count + end - pos, end
                continue
            out[rows[over]] = 1
            ban_end, count = int(at[over]) + ban_us, 0  # counting begins anew after the ban
            pos = max(over + 1, int(np.searchsorted(at, ban_end)))
        return out, (hour, count, ban_end)

    class HourlyQuota(StatefulProcessor):
        """Per client: the hour that counts, its count and the ban.  Rows are whole slices that the watermark has
        passed, so a batch of them is decided at once in the order of its requests, for a few calls of the state
        however many requests and slices it has.  A client leaves the state when its hour and its ban are over, the
        slice in which the ban ends included."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.counted = handle.getValueState("counted", _COUNTED)

        def _keep(self, counted: tuple, passed_us: int) -> bool:
            hour, _, ban_end = counted
            over = max(-(-(ban_end or 0) // slice_us) * slice_us, 0 if hour is None else (hour + 1) * HOUR_US)
            if passed_us < over:
                self.handle.registerTimer(-(-over // 1000))
            return passed_us < over

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            us, ids, kind, kinds = [], [], [], {}
            for batch in rows:
                for name, manual, u, i in zip(*(batch[c].tolist() for c in ("type", "manual", "us", "id"))):
                    us.append(np.asarray(u, np.int64))
                    ids.append(np.asarray(i, np.int64))
                    kind.append(np.full(len(us[-1]), 2 * kinds.setdefault(name, len(kinds)) + manual, np.int32))
            if not us:
                return iter(())
            us, ids, kind = np.concatenate(us), np.concatenate(ids), np.concatenate(kind)
            order = np.lexsort((ids, us))
            us, ids, kind = us[order], ids[order], kind[order]
            done, counted = decide(us, (kind & 1) > 0, self.counted.get() or (None, 0, None))
            if self._keep(counted, timerValues.getCurrentWatermarkInMs() * 1000):
                self.counted.update(counted)
            else:
                self.counted.clear()
            return self._report(key[0], us, ids, kind >> 1, np.array(list(kinds), object), done)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            counted = self.counted.get()
            if counted and not self._keep(counted, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000):
                self.counted.clear()
            return iter(())

        def _report(self, ip, us, ids, kind, kinds, done) -> Iterator[pd.DataFrame]:
            # a slice's last moment, which no watermark had passed before
            slot = (us // slice_us + 1) * slice_us - 1
            if report == "tallies":
                # one row a slice and class
                cell, where = np.unique(slot * len(kinds) + kind, return_inverse=True)
                n = np.bincount(where * 3 + done, minlength=3 * len(cell)).reshape(-1, 3)
                found = pd.DataFrame({"ip": ip, "type": kinds[cell % len(kinds)], "slot": pd.to_datetime(cell // len(kinds), unit="us"),
                                      "requests": n.sum(1)} | {d: n[:, j] for j, d in enumerate(_DECISIONS)})
                yield found
                return
            if report == "bans":
                kept = done == _DECISIONS.index("quota")
                us, ids, kind, slot, done = us[kept], ids[kept], kind[kept], slot[kept], done[kept]
            names = np.array(_DECISIONS, object)
            for i in range(0, len(us), _FRAME):
                j = slice(i, i + _FRAME)
                yield pd.DataFrame({"ip": ip, "type": kinds[kind[j]], "us": us[j], "id": ids[j], "decision": names[done[j]],
                                    "slot": pd.to_datetime(slot[j], unit="us")})

        def close(self) -> None:
            pass

    return HourlyQuota()


def _requests(log: DataFrame, ts: str, ip: str, type_: str | None, id_col: str, watermark: str) -> DataFrame:
    rows = log.select(
        F.col(ip).cast("string").alias("ip"), F.col(ts).cast("timestamp").alias("ts"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("id"),
        (F.col(type_) if type_ else F.lit(None)).cast("string").alias("type")).withWatermark("ts", watermark)
    return rows.withColumn("us", epoch_micros("ts"))


def _slices(rows: DataFrame, by: Sequence[str], slice_s: int) -> DataFrame:
    """The requests of a client's slice (and of each value of ``by``) side by side, once the watermark has passed it."""
    g = rows.groupBy("ip", *by, F.window("ts", f"{slice_s} seconds").alias("w")).agg(F.collect_list(F.struct("us", "id")).alias("_of"))
    return g.select("ip", *by, F.window_time("w").alias("ts"), F.col("_of.us").alias("us"), F.col("_of.id").alias("id"))


def _decided(slices: DataFrame, quota: int, ban_seconds: int, slice_s: int, report: str) -> DataFrame:
    """The keyed state over passed slices (ip, type, manual, us, id): what ``report`` names of their decisions,
    ``rows``, ``bans`` (the rows that start one) or ``tallies`` (counts by class and slice)."""
    return slices.groupBy("ip").transformWithStateInPandas(
        statefulProcessor=_quota_processor(quota, ban_seconds * 1_000_000, slice_s * 1_000_000, report),
        outputStructType=TALLIED if report == "tallies" else DECIDED,
        outputMode="Append", timeMode="EventTime", eventTimeColumnName="slot")


def quota_stream(log: DataFrame, bans: DataFrame | None = None, quota: int = HOURLY_QUOTA, ban_seconds: int = BAN_SECONDS,
                 ts: str = "ts", ip: str = "ip", type_: str | None = "type", id_col: str = "id", watermark: str = "10 minutes",
                 slice_s: int = 60, report: str = "rows") -> DataFrame:
    """W3 and W2 streaming (append mode): every request once with ``counted``, ``quota`` (it starts a ban) or
    ``banned``, when the watermark has passed its slice; with ``report`` "tallies" their counts by class and slice.

    Rows up to ``watermark`` late are decided in their order.  A windowed aggregate gathers the slices not yet
    passed, so a busy client is many keys there; the keyed state is a client's hour and ban until both are over.
    ``bans`` is a static table of manual bans."""
    rows = _requests(log, ts, ip, type_, id_col, watermark)
    if bans is None:
        rows = rows.withColumn("manual", F.lit(False))
    else:
        rows = within(rows, ban_intervals(bans, default_seconds=ban_seconds)).withColumn("manual", F.col("start_us").isNotNull())
    keyed = rows.where("ip IS NOT NULL AND us IS NOT NULL").select("ip", "ts", "us", "id", "type", "manual")
    return _decided(_slices(keyed, ["type", "manual"], slice_s), quota, ban_seconds, slice_s, report)


def hourly_quota_stream(log: DataFrame, quota: int = HOURLY_QUOTA, ban_seconds: int = BAN_SECONDS, ts: str = "ts", ip: str = "ip",
                        id_col: str = "id", watermark: str = "10 minutes") -> DataFrame:
    """W2 streaming: the bans of :func:`quota_stream`, ``ip, ban_start_us, ban_end_us``, each once.

    Only an hour of more than ``quota`` requests can start a ban, as counting begins anew with the hour and a ban only
    lowers it.  So the slices are hours here, and the busy ones alone go on to the keyed state."""
    rows = _requests(log, ts, ip, None, id_col, watermark).where("ip IS NOT NULL AND us IS NOT NULL")
    busy = _slices(rows, [], 3600).where(F.size("us") > quota).withColumns(
        {"type": F.lit(None).cast("string"), "manual": F.lit(False)})
    decided = _decided(busy, quota, ban_seconds, 3600, "bans")
    return decided.select("ip", F.col("us").alias("ban_start_us"), (F.col("us") + ban_seconds * 1_000_000).alias("ban_end_us"))


def gate_stream(log: DataFrame, bans: DataFrame | None = None, quota: int = HOURLY_QUOTA, ban_seconds: int = BAN_SECONDS,
                limits: dict = RATE_LIMITS, window_s: int = 60, **kw) -> DataFrame:
    """The whole gate as one stream: manual bans (W3), then the quota's keyed state (W2), then the class limits by
    window (W1), stateful operators chained in one query.  Append mode: one row a class, client and window,
    as :func:`tallyscope.operators.gate.gate_summary` gives it, once the watermark has passed it."""
    tallies = quota_stream(log, bans, quota, ban_seconds, slice_s=window_s, report="tallies", **kw)
    g = tallies.groupBy("type", "ip", F.window("slot", f"{window_s} seconds").alias("w")).agg(
        F.sum("requests").alias("requests"), *[F.sum(d).alias(f"_{d}") for d in _DECISIONS])
    limit = limit_for(F.col("type"), limits).cast("bigint")
    return g.select("type", "ip", F.col("w.start").alias("window_start"), "requests", F.col("_banned").alias("banned"),
                    F.col("_quota").alias("over_quota"), F.greatest(F.col("_counted") - limit, F.lit(0)).alias("limited"),
                    F.least(F.col("_counted"), limit).alias("passed"))
