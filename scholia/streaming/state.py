"""Per-key state machines, and the same rules over a batch.

State is a handful of values per key. In a batch, keys are cut where their past cannot matter any
more, partitions are sorted by key and time, and rows stream through one at a time: no key is gathered.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT_OUT = "key string, event_id long, ts timestamp, accepted boolean"


def admit(recent: list[float], now: float, most: int, window: float) -> tuple[list[float], bool]:
    """Drop accepted times that are ``window`` old; accept while fewer than ``most`` are left."""
    recent = [t for t in recent if t > now - window]
    if len(recent) >= most:
        return recent, False
    return recent + [now], True


def seconds_of(col: pd.Series) -> list[float]:
    """Seconds since 1970 with microseconds, from zoned or plain time stamps; 0 for none."""
    t = col.dt.tz_convert("UTC").dt.tz_localize(None) if col.dt.tz is not None else col
    return [v / 1e6 for v in t.astype("datetime64[us]").fillna(pd.Timestamp(0)).astype("int64")]


def moments(seconds: list[float], index: pd.Index | None = None) -> pd.Series:
    """The time stamps of such seconds."""
    return pd.Series([pd.Timestamp(round(s * 1e6), unit="us") if s else None for s in seconds], dtype="datetime64[us]", index=index)


def _seconds(ts: datetime.datetime) -> float:
    """Seconds since 1970 of a row's time stamp, which carries the worker's local zone."""
    return ts.timestamp()


def _moment(seconds: float) -> datetime.datetime | None:
    return None if seconds == 0.0 else datetime.datetime.fromtimestamp(round(seconds * 1e6) / 1e6)


class Alarm:
    """The one timer of a key, kept next to it so that setting it anew lists no timers."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.at = handle, handle.getValueState("alarm", T.StructType([T.StructField("ms", T.LongType())]))

    def set(self, seconds: float | None, rung: bool = False) -> None:
        now = self.at.get()
        ms = None if seconds is None else math.ceil(seconds * 1000)
        if now and not rung and now[0] != ms:
            self.handle.deleteTimer(now[0])
        if ms is None:
            self.at.clear()
        elif rung or not now or now[0] != ms:
            self.handle.registerTimer(ms)
            self.at.update((ms,))

    def no_later_than(self, seconds: float) -> None:
        now = self.at.get()
        if not now or now[0] > math.ceil(seconds * 1000):
            self.set(seconds)


WAITING = T.StructType([T.StructField("t", T.DoubleType()), T.StructField("event_id", T.LongType()), T.StructField("most", T.IntegerType()), T.StructField("window", T.DoubleType())])


class RateLimiter(StatefulProcessor):
    """Requests wait in state until the watermark has passed them and are then judged in the order of their times, whichever batch brought them.

    A key is forgotten once nothing waits and its accepted requests have left the window. Works on rows: a key gets a handful per batch, for which a
    frame each would cost more than the work.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", T.StructType([T.StructField("t", T.ArrayType(T.DoubleType()))]))
        self.waiting, self.alarm = handle.getListState("waiting", WAITING), Alarm(handle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(_seconds(r.ts), r.event_id, r.most, r.window) for r in rows]
        self.waiting.appendList(new)
        self.alarm.no_later_than(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        state = self.accepted.get()
        recent, window = list(state[0]) if state else [], 0.0
        waiting = sorted(tuple(w) for w in self.waiting.get())
        ready = [w for w in waiting if w[0] <= passed]
        for now, event_id, most, window in ready:
            recent, ok = admit(recent, now, most, window)
            yield Row(key=key[0], event_id=event_id, ts=_moment(now), accepted=ok)
        rest = waiting[len(ready):]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.accepted.update((recent,))
            self.alarm.set(rest[0][0], rung=True)
        elif ready and recent and recent[-1] + window > passed:
            self.accepted.update((recent,))
            self.alarm.set(recent[-1] + window, rung=True)
        else:
            self.accepted.clear()
            self.alarm.set(None, rung=True)

    def close(self) -> None:
        pass


def limited(requests: DataFrame, policy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (client, path, event_id, ts) of paths that ``policy`` (path, most, window in seconds) names, keyed by client and path; and the others."""
    ruled = F.broadcast(policy) if policy.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1" else policy
    key = F.concat_ws(":", F.col("client").cast("string"), "path").alias("key")
    both = requests.join(ruled.select("path", F.col("most").cast("int").alias("most"), F.col("window").cast("double").alias("window")), "path", "left")
    both = both.select(key, "event_id", "ts", "most", "window")
    return both.filter("most is not null"), both.filter("most is null").select("key", "event_id", "ts", F.lit(True).alias("accepted"))


def rate_limit(requests: DataFrame, policy: DataFrame, late: str = "1 day") -> DataFrame:
    """Accept or reject each request of a stream; only accepted ones count. Paths without a policy pass. Requests may come up to ``late`` after newer ones."""
    ruled, free = limited(requests.withWatermark("ts", late), policy)
    judged = ruled.groupBy("key").transformWithState(
        statefulProcessor=RateLimiter(), outputStructType=LIMIT_OUT, outputMode="append", timeMode="EventTime")
    return judged.unionByName(free)


def quiet_segments(rows: DataFrame) -> DataFrame:
    """Adds ``segment``: parts of a key with an empty stretch of at least its ``window`` between them.

    Times fall into bins of the window's length. After an empty bin nothing older can matter, so a new
    segment starts; only distinct (key, bin) pairs are put in order.
    """
    bins = rows.withColumn("_bin", F.floor(F.unix_micros("ts") / (F.col("window") * 1e6)))
    pairs = bins.select("key", "_bin").distinct()
    starts = pairs.join(pairs.select("key", (F.col("_bin") + 1).alias("_bin")), ["key", "_bin"], "left_anti").withColumn("_s", F.col("_bin"))
    w = Window.partitionBy("key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = pairs.join(starts, ["key", "_bin"], "left").select("key", "_bin", F.max("_s").over(w).alias("segment"))
    return bins.join(placed, ["key", "_bin"]).drop("_bin")


def rate_limit_batch(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """The same over a table."""
    ruled, free = limited(requests, policy)
    parts = quiet_segments(ruled).repartition("key", "segment").sortWithinPartitions("key", "segment", "ts", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, recent = None, []
        for f in frames:
            flags = []
            for key, seg, now, most, window in zip(f["key"], f["segment"], seconds_of(f["ts"]), f["most"], f["window"]):
                if (key, seg) != at:
                    at, recent = (key, seg), []
                recent, ok = admit(recent, now, most, window)
                flags.append(ok)
            yield pd.DataFrame({"key": f["key"], "event_id": f["event_id"], "ts": f["ts"], "accepted": flags})

    return parts.mapInPandas(run, LIMIT_OUT).unionByName(free)


def hung_tasks(updates: DataFrame, seconds: int = 3600, late: str = "1 day") -> DataFrame:
    """task_id, hung_at: pending or running tasks that were silent for more than ``seconds``.

    Updates no further apart than that are one session of the task, so a task hangs at the end of a session whose last update leaves it active.
    Updates may come up to ``late`` after newer ones; what is reported lags behind as much. State holds open sessions only.
    """
    active = F.coalesce(F.col("status").isin("pending", "running"), F.lit(False))
    sessions = updates.withWatermark("ts", late).groupBy("task_id", F.session_window("ts", f"{seconds} seconds").alias("w"))
    return sessions.agg(F.max_by(active, F.struct("ts", "event_id")).alias("active")).filter("active").select("task_id", F.col("w.end").alias("hung_at"))
