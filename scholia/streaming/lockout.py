"""Log-in lock-out judged over account and address together.

An attempt is refused while its address is locked, else while its account is; a refused attempt counts for neither. Any other counts for both: a
failure adds to both counts and locks a scope at its limit, a success clears both. Time alone clears no count. So accounts and addresses
that ever met form one state that no key can split.

It is solved in rounds. Each scope is judged on its own, by key and in time order, with the refusals of the other scope as known so far; keys whose
input has changed are judged anew until nothing changes. A verdict depends on earlier attempts only, so whatever settles is the verdict of a replay of
all attempts in order. Rounds touch the changed keys alone and are few: as many as refusals hand on from one scope to the other.

Scale: two shuffles a round, of the rows of changed keys; a key's rows pass through a task one by one with two numbers of state. On a stream, attempts wait for
the watermark and are then judged batch by batch from the counts that earlier batches left in a bucketed table; scopes without a
count or lock are not in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.sources.writers import create_buckets, read_buckets, replace_buckets
from scholia.streaming.state import moments, seconds_of

ATTEMPT = "event_id bigint, ts timestamp, user bigint, ip string, ok boolean"
STATES = "key string, failures int, locked timestamp"
SCOPES = ("ip", "user")


def step(failures: int, locked: float, now: float, ok: bool, refused_elsewhere: bool, first: bool, most: int, seconds: float) -> tuple[int, float, bool]:
    """Count, lock and whether this scope refuses. ``first``: this scope is asked before the other."""
    if locked > now and (first or not refused_elsewhere):
        return failures, locked, True
    if refused_elsewhere:
        return failures, locked, False
    if ok:
        return 0, 0.0, False
    failures += 1
    return failures, (now + seconds if failures >= most else locked), False


def scope_key(scope: str) -> Column:
    """``ip:`` or ``user:`` and the value; null where the attempt names none, which then has no such scope."""
    return F.concat(F.lit(f"{scope}:"), F.col(scope).cast("string"))


def judged(rows: DataFrame, scope: str, starts: DataFrame, most: int, seconds: float) -> DataFrame:
    """``rows`` with the scope's refused, failures and locked after each attempt, from its key's start and the other scope's refusals."""
    other = "user" if scope == "ip" else "ip"
    names = [f"{scope}_refused", f"{scope}_failures", f"{scope}_locked"]
    keyed = rows.drop(*names).withColumn("_key", scope_key(scope))
    begin = starts.join(keyed.select(F.col("_key").alias("key")).distinct(), "key", "left_semi")
    # A key's start comes before its attempts: it has no time.
    begin = begin.select(F.col("key").alias("_key"), F.col("failures").alias("_failures"), F.col("locked").alias("_locked"))
    both = keyed.filter("_key is not null").unionByName(begin, allowMissingColumns=True)
    parts = both.repartition("_key").sortWithinPartitions("_key", F.col("ts").asc_nulls_first(), "event_id")
    kept = [c for c in keyed.columns if c != "_key"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, failures, locked = None, 0, 0.0
        for f in frames:
            out, start = [], f["ts"].isna()
            times, ends = seconds_of(f["ts"]), seconds_of(f["_locked"])
            for key, begins, now, ok, elsewhere, count, end in zip(f["_key"], start, times, f["ok"], f[f"{other}_refused"], f["_failures"], ends):
                if key != at:
                    at, failures, locked = key, 0, 0.0
                if begins:
                    failures, locked = int(count), end
                    continue
                failures, locked, refused = step(failures, locked, now, bool(ok), bool(elsewhere), scope == "ip", most, seconds)
                out.append((refused, failures, locked))
            f = f.loc[~start, kept]
            yield f.assign(**{names[0]: [x[0] for x in out], names[1]: [x[1] for x in out], names[2]: moments([x[2] for x in out], f.index)})

    types = ", ".join(f"`{c}` {t}" for c, t in keyed.dtypes if c != "_key")
    done = parts.mapInPandas(run, f"{types}, {names[0]} boolean, {names[1]} int, {names[2]} timestamp")
    nobody = keyed.filter("_key is null").select(*kept, F.lit(False).alias(names[0]), F.lit(None).cast("int").alias(names[1]), F.lit(None).cast("timestamp").alias(names[2]))
    return done.unionByName(nobody)


def settle(attempts: DataFrame, starts: DataFrame, keep: Callable[[DataFrame], DataFrame], user_max: int = 5, ip_max: int = 10, minutes: int = 30) -> DataFrame:
    """Every attempt (``ATTEMPT``) with refused, failures and locked of both scopes. ``starts`` (``STATES``) says where scopes begin, ``keep`` writes a
    table once and reads it back."""
    most, seconds = {"ip": ip_max, "user": user_max}, minutes * 60.0
    no = F.lit(False)
    rows = attempts.select("event_id", "ts", "user", "ip", "ok", no.alias("ip_refused"), no.alias("user_refused"))
    for scope in SCOPES:
        rows = judged(rows, scope, starts, most[scope], seconds)
    rows = keep(rows.withColumn("_changed", F.col("user_refused")))
    scope = "ip"
    while True:
        # The other scope's refusals of these keys have changed.
        keys = keep(rows.filter("_changed").select(scope_key(scope).alias("_k")).filter("_k is not null").distinct())
        if keys.isEmpty():
            return rows.drop("_changed")
        mine = rows.withColumn("_k", scope_key(scope))
        again = mine.join(keys, "_k", "left_semi").drop("_k").withColumn("_before", F.col(f"{scope}_refused"))
        again = judged(again, scope, starts, most[scope], seconds).withColumn("_changed", F.col(f"{scope}_refused") != F.col("_before")).drop("_before")
        rest = mine.join(keys, "_k", "left_anti").drop("_k").withColumn("_changed", no)
        rows = keep(rest.unionByName(again))
        scope = "user" if scope == "ip" else "ip"


def verdicts(rows: DataFrame) -> DataFrame:
    """event_id, ts, user, ip, outcome (ip_locked, user_locked, failure, success), and count and lock of both scopes after the attempt."""
    outcome = F.when(F.col("ip_refused"), "ip_locked").when(F.col("user_refused"), "user_locked").when(F.col("ok"), "success").otherwise("failure")
    return rows.select("event_id", "ts", "user", "ip", outcome.alias("outcome"), "user_failures", F.col("user_locked").alias("user_locked_until"),
                       "ip_failures", F.col("ip_locked").alias("ip_locked_until"))


def lockout_batch(attempts: DataFrame, keep: Callable[[DataFrame], DataFrame], **limits: int) -> DataFrame:
    """Verdicts of a whole table, from no counts."""
    nothing = attempts.sparkSession.createDataFrame([], STATES)
    return verdicts(settle(attempts, nothing, keep, **limits))


class LockoutTable:
    """Folder with what a stream of attempts has come to: verdicts/, states/ (buckets), waiting/ and newest/ by batch.

    ``apply`` is the stream's batch function; a batch that is run again writes the same folders again. An attempt that comes more than ``late`` after a
    newer one is judged when it comes, from the counts of that moment.
    """

    def __init__(self, spark: SparkSession, path: str, late: str = "1 day", buckets: int = 32, **limits: int) -> None:
        self.path, self.late, self.buckets, self.limits = path, late, buckets, limits
        create_buckets(spark, f"{path}/states", STATES)

    def _kept(self, batch_id: int) -> Callable[[DataFrame], DataFrame]:
        n = iter(range(10**9))

        def keep(df: DataFrame) -> DataFrame:
            path = f"{self.path}/rounds/batch={batch_id}/{next(n)}"
            df.write.mode("overwrite").parquet(path)
            return df.sparkSession.read.schema(df.schema).parquet(path)
        return keep

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, batch_id - 1
        came = batch.select("event_id", "ts", "user", "ip", "ok")
        newest = came.agg(F.max("ts").alias("newest"))
        if batch_id:
            came = came.unionByName(spark.read.schema(ATTEMPT).parquet(f"{self.path}/waiting/{before}"))
            newest = newest.unionByName(spark.read.parquet(f"{self.path}/newest/{before}")).agg(F.max("newest").alias("newest"))
        newest.write.mode("overwrite").parquet(f"{self.path}/newest/{batch_id}")
        mark = spark.read.parquet(f"{self.path}/newest/{batch_id}").select((F.col("newest") - F.expr(f"interval {self.late}")).alias("mark")).first()["mark"]
        ripe = F.col("ts") <= F.lit(mark)
        keep = self._kept(batch_id)
        came = keep(came)
        came.filter(~F.coalesce(ripe, F.lit(False))).write.mode("overwrite").parquet(f"{self.path}/waiting/{batch_id}")
        starts = read_buckets(spark, f"{self.path}/states", STATES, batch_id).drop("bucket")
        rows = settle(came.filter(ripe), starts, keep, **self.limits)
        verdicts(rows).write.mode("overwrite").parquet(f"{self.path}/verdicts/batch={batch_id}")
        last = lambda scope: (rows.select(scope_key(scope).alias("key"), "ts", "event_id", F.col(f"{scope}_failures").alias("failures"), F.col(f"{scope}_locked").alias("locked"))
                              .filter("key is not null").groupBy("key").agg(F.max_by(F.struct("failures", "locked"), F.struct("ts", "event_id")).alias("s")))
        ends = keep(last("ip").unionByName(last("user")).select("key", "s.failures", "s.locked"))
        replace_buckets(f"{self.path}/states", ends.filter("failures > 0 or locked is not null"), ends.select("key"), "key", batch_id, self.buckets)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/verdicts").drop("batch")
