"""Streaming queries over the events and documents tables, run to the end of the input."""

from pyspark.sql import functions as F

from scholia.plans.registry import query, view
from scholia.session import scratch_path
from scholia.sources.writers import create_buckets, read_buckets
from scholia.streaming import state as S
from scholia.streaming import windows as W
from scholia.streaming.lockout import LockoutTable
from scholia.streaming.run import Feed, drain, plain_time, stream_table

# Path, most requests, window in seconds. Other paths have no limit.
POLICY = [("/view", 3, 5 * 86400.0), ("/click", 2, 3 * 86400.0), ("/error", 1, 86400.0)]
MINUTES = 60 * 24


def policy(spark):
    return spark.createDataFrame(POLICY, "path string, most int, window double")


def requests(df):
    return df.select(F.col("user_id").alias("client"), F.concat(F.lit("/"), "event_type").alias("path"), "event_id", "ts")


def keyed(df):
    return df.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "event_id", "ts")


@query("str_rate_limit", f"""
WITH RECURSIVE p(path, most, secs) AS (VALUES {', '.join(f"('{path}', {most}, {window})" for path, most, window in POLICY)}),
e AS (SELECT user_id || ':/' || event_type AS key, event_id, ts, most, secs FROM events LEFT JOIN p ON p.path = '/' || event_type),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS k FROM e WHERE most IS NOT NULL),
r(key, k, event_id, ts, recent, accepted) AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT), NULL::BIGINT, NULL::TIMESTAMP, []::TIMESTAMP[], NULL::BOOLEAN FROM o UNION ALL
  SELECT key, k, event_id, ts, CASE WHEN len(live) < most THEN list_append(live, ts) ELSE live END, len(live) < most FROM (
    SELECT o.*, list_filter(r.recent, lambda t: epoch_us(t) > epoch_us(o.ts) - o.secs * 1000000) AS live FROM r JOIN o ON o.key = r.key AND o.k = r.k + 1))
SELECT key, event_id, ts, accepted FROM r WHERE k > 0 UNION ALL SELECT key, event_id, ts, true FROM e WHERE most IS NULL""")
def _(t):
    feed = Feed(t.spark, t.sf_dir)
    out = plain_time(drain(S.rate_limit(requests(feed.stream), policy(t.spark)), "append", "limit", feed=feed), "ts")
    # Requests without a limit come out at once, those of the closing records too.
    return out.join(F.broadcast(feed.table.agg(F.max("ts").alias("last"))), F.col("ts") <= F.col("last")).drop("last")


@query("str_rate_offered", """
WITH e AS (SELECT user_id || ':' || event_type AS key, ts, epoch_us(ts) // 21600000000 AS b FROM events),
w AS (SELECT key, unnest([b, b - 1, b - 2, b - 3]) AS b FROM e)
SELECT key, TIMESTAMP '1970-01-01' + b * INTERVAL 6 HOUR AS window_start, count(*) AS n FROM w GROUP BY 1, 2""")
def _(t):
    feed = Feed(t.spark, t.sf_dir)
    return plain_time(drain(W.offered_load(keyed(feed.stream), "1 day", "6 hours"), "append", "offered", feed=feed), "window_start")


def attempts(df):
    """Errors are failed log-ins, sign-ups good ones; ten users share an address."""
    return df.filter(F.col("event_type").isin("error", "signup")).select(
        "event_id", "ts", F.col("user_id").alias("user"), F.concat(F.lit("10.0.0."), F.floor(F.col("user_id") / 10).cast("string")).alias("ip"),
        (F.col("event_type") == "signup").alias("ok"))


# A replay of all attempts one by one, in time order, with the counts and locks of all accounts and addresses.
LOCKOUT = """
WITH RECURSIVE a AS (SELECT event_id, ts, user_id AS usr, '10.0.0.' || (user_id // 10) AS ip, event_type = 'signup' AS ok, row_number() OVER (ORDER BY ts, event_id) AS k
  FROM events WHERE event_type IN ('error', 'signup')),
r(k, event_id, ts, usr, ip, outcome, uf, ul, nf, nl, us, ns) AS (
  SELECT CAST(0 AS BIGINT), NULL::BIGINT, NULL::TIMESTAMP, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0, NULL::TIMESTAMP, 0, NULL::TIMESTAMP,
    MAP {}::MAP(BIGINT, STRUCT(f INTEGER, l TIMESTAMP)), MAP {}::MAP(VARCHAR, STRUCT(f INTEGER, l TIMESTAMP)) UNION ALL
  SELECT k, event_id, ts, usr, ip, outcome, uf2, ul2, nf2, nl2, map_concat(us, MAP {usr: {'f': uf2, 'l': ul2}}), map_concat(ns, MAP {ip: {'f': nf2, 'l': nl2}}) FROM (
    SELECT *, CASE outcome WHEN 'success' THEN 0 WHEN 'failure' THEN uf + 1 ELSE uf END AS uf2, CASE outcome WHEN 'success' THEN 0 WHEN 'failure' THEN nf + 1 ELSE nf END AS nf2,
      CASE WHEN outcome = 'success' THEN NULL WHEN outcome = 'failure' AND uf >= 4 THEN ts + INTERVAL 1 DAY ELSE ul END AS ul2,
      CASE WHEN outcome = 'success' THEN NULL WHEN outcome = 'failure' AND nf >= 9 THEN ts + INTERVAL 1 DAY ELSE nl END AS nl2 FROM (
      SELECT *, CASE WHEN nl > ts THEN 'ip_locked' WHEN ul > ts THEN 'user_locked' WHEN ok THEN 'success' ELSE 'failure' END AS outcome FROM (
        SELECT a.*, coalesce(r.us[a.usr].f, 0) AS uf, r.us[a.usr].l AS ul, coalesce(r.ns[a.ip].f, 0) AS nf, r.ns[a.ip].l AS nl, r.us, r.ns FROM r JOIN a ON a.k = r.k + 1))))
SELECT event_id, ts, usr AS user, ip, outcome, uf AS user_failures, ul AS user_locked_until, nf AS ip_failures, nl AS ip_locked_until FROM r WHERE k > 0"""


@query("str_login_lockout", LOCKOUT)
def _(t):
    feed = Feed(t.spark, t.sf_dir)
    table = LockoutTable(t.spark, scratch_path(t.spark, "lockout-table"), buckets=int(t.spark.conf.get("spark.sql.shuffle.partitions")), minutes=MINUTES)
    drain(attempts(feed.stream), "append", "lockout", each=table.apply, feed=feed)
    return plain_time(table.read(t.spark), "ts", "user_locked_until", "ip_locked_until")


def task_updates(df):
    et = F.col("event_type")
    status = (F.when(et == "view", "pending").when(et == "click", "running").when(et == "purchase", "completed").when(et == "error", "failed")
              .otherwise("cancelled"))
    return df.select((F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("long")).alias("task_id"), "event_id", "ts", status.alias("status"),
                     (F.floor("value") * 3 - 20).alias("progress"), F.col("props").alias("message"))


view("v_updates", """
SELECT user_id * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS task_id, event_id, ts, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running'
   WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status, CAST(floor(value) AS BIGINT) * 3 - 20 AS progress, props AS message FROM events""")


@query("str_task_latest", """
SELECT task_id, status, least(greatest(progress, 0), 100) AS progress, message, ts AS updated_at FROM v_updates
QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(t):
    log = scratch_path(t.spark, "task-log")
    drain(task_updates(stream_table(t.spark, t.sf_dir, "events")), "append", "latest", each=W.log_newest(log))
    return plain_time(W.read_newest(t.spark, log), "updated_at")


@query("str_task_hung", """
WITH u AS (SELECT *, lead(ts) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS nxt FROM v_updates)
SELECT task_id, ts + INTERVAL 1 HOUR AS hung_at FROM u WHERE status IN ('pending', 'running') AND (nxt IS NULL OR nxt - ts > INTERVAL 1 HOUR)""")
def _(t):
    feed = Feed(t.spark, t.sf_dir)
    out = drain(S.hung_tasks(task_updates(feed.stream).select("task_id", "event_id", "ts", "status")), "append", "hung", feed=feed)
    return plain_time(out, "hung_at")


@query("str_request_metrics", """
SELECT date_trunc('hour', ts) AS window_start, CASE WHEN starts_with(path, '/note/') THEN '/note/{id}' WHEN starts_with(path, '/notes/') THEN '/notes/{id}'
   WHEN starts_with(path, '/chat/') THEN '/chat/*' ELSE path END AS bucket, status, count(*) AS n,
  round_even(sum(greatest(CAST(trunc(duration_ms) AS BIGINT), 0)) / count(*), 2) AS avg_ms FROM v_requests GROUP BY 1, 2, 3""")
def _(t):
    live, feed = type(t)(t.spark, t.sf_dir), Feed(t.spark, t.sf_dir)
    live.events = feed.stream
    return plain_time(drain(W.request_metrics(live.requests), "append", "metrics", feed=feed), "window_start")


@query("str_study_daily", """
SELECT user_id, strftime(created_at, '%Y-%m-%d') AS date, CAST(sum(CASE WHEN contains(session_type, 'break') THEN 0 ELSE duration_minutes END) AS BIGINT) AS study_minutes,
  CAST(sum(CASE WHEN contains(session_type, 'break') THEN duration_minutes ELSE 0 END) AS BIGINT) AS break_minutes, count(*) AS n FROM v_sessions GROUP BY 1, 2""")
def _(t):
    live, feed = type(t)(t.spark, t.sf_dir), Feed(t.spark, t.sf_dir)
    live.events = feed.stream
    return drain(W.study_daily(live.sessions.withColumnRenamed("created_at", "ts")), "append", "daily", feed=feed)


@query("str_active_sessions", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events FROM s GROUP BY user_id, k""")
def _(t):
    feed = Feed(t.spark, t.sf_dir)
    out = drain(W.active_sessions(feed.stream, "6 hours"), "append", "sessions", feed=feed)
    return plain_time(out, "session_start", "session_end")


@query("str_event_audit", """
SELECT user_id, event_type AS action, 'u' || user_id || '@x.org' AS email, CASE event_type WHEN 'error' THEN 'invalid_credentials' ELSE 'ok' END AS status,
  CASE event_type WHEN 'error' THEN 'Invalid email or password' END AS reason, ts FROM events""")
def _(t):
    e = stream_table(t.spark, t.sf_dir, "events")
    bad = F.col("event_type") == "error"
    details = F.concat(F.lit("email=u"), F.col("user_id").cast("string"), F.lit("@x.org; status="), F.when(bad, "invalid_credentials; Invalid email or password").otherwise("ok"))
    out = drain(W.event_audit(e.select("user_id", F.col("event_type").alias("action"), details.alias("details"), "ts")), "append", "audit")
    return plain_time(out, "ts")


@query("str_incremental_embed")
def _(t):
    table = scratch_path(t.spark, "chunk-table")
    create_buckets(t.spark, table, W.CHUNKS)
    changes = stream_table(t.spark, t.sf_dir, "documents").select("doc_id", "text", F.lit(1).alias("version"))
    drain(changes, "append", "embed", each=W.embed_changes(table))
    return read_buckets(t.spark, table, W.CHUNKS).drop("bucket")
