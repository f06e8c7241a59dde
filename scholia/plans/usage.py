"""Usage, quota, conversation and report queries bound to the supplied tables."""

from pyspark.sql import functions as F

from scholia.operators import reports, usage
from scholia.params import AS_OF
from scholia.plans.registry import query, view

DAY7 = "TIMESTAMP '2024-01-24 00:00:00'"
NO_TIER = "furniture"

view("v_members", """
SELECT user_id, CASE tier WHEN 'household' THEN 'free' WHEN 'machinery' THEN 'pro' WHEN 'building' THEN 'unlimited'
  WHEN 'automobile' THEN 'early_tester' ELSE tier END AS tier FROM v_users""")
view("v_exercises", "SELECT p_partkey AS exercise_id, CAST(p_size AS BIGINT) AS user_id FROM part")


def members(t):
    tier = F.col("tier")
    return t.users.select("user_id", F.when(tier == "household", "free").when(tier == "machinery", "pro")
                          .when(tier == "building", "unlimited").when(tier == "automobile", "early_tester").otherwise(tier).alias("tier"))


def exercises(t):
    return t.part.select(F.col("p_partkey").alias("exercise_id"), F.col("p_size").cast("long").alias("user_id"))


@query("agg_dashboard_summary", f"""
SELECT u.user_id, coalesce(s.n, 0) AS total_subjects, coalesce(r.n, 0) AS total_notes,
  coalesce(m.n, 0) AS questions_asked_7d, CAST(coalesce(t.n, 0) AS BIGINT) AS study_time_7d_mins
FROM v_users u LEFT JOIN (SELECT user_id, count(*) n FROM v_user_subjects GROUP BY 1) s USING (user_id)
LEFT JOIN (SELECT user_id, count(*) n FROM v_resources GROUP BY 1) r USING (user_id)
LEFT JOIN (SELECT user_id, count(*) n FROM v_asked WHERE created_at >= {DAY7} GROUP BY 1) m USING (user_id)
LEFT JOIN (SELECT user_id, sum(duration_minutes) n FROM v_sessions WHERE created_at >= {DAY7} GROUP BY 1) t USING (user_id)""")
def _(t):
    return usage.dashboard_summary(t.users, t.user_subjects, t.resources, t.questions_asked, t.sessions, AS_OF)


view("v_progress", """
SELECT r.user_id, r.resource_id, CASE WHEN n.resource_id IS NULL THEN 0.0 ELSE 100.0 END AS completion
FROM v_resources r LEFT JOIN (SELECT DISTINCT resource_id FROM v_notes) n USING (resource_id)""")


@query("agg_progress", """
SELECT user_id, count(*) AS total_notes, CAST(sum(completion) AS DOUBLE) / count(*) AS overall_completion FROM v_progress GROUP BY 1""")
def _(t):
    return usage.progress(t.resources, t.notes)


@query("agg_completion_status", """
SELECT user_id, count(*) FILTER (completion >= 100) AS completed, count(*) FILTER (completion > 0 AND completion < 100) AS in_progress,
  count(*) FILTER (completion = 0) AS not_started FROM v_progress GROUP BY 1""")
def _(t):
    return usage.completion_status(t.resources, t.notes)


@query("agg_time_spent", """
WITH b AS (SELECT user_id, resource_id, CAST(sum(coalesce(duration_minutes, 0)) AS BIGINT) AS total_minutes, count(*) AS sessions_count
  FROM v_sessions GROUP BY 1, 2),
a AS (SELECT b.user_id, 'resource' AS kind, b.resource_id, coalesce(r.title, 'Unknown Resource') AS title, total_minutes, sessions_count
  FROM b LEFT JOIN v_resources r USING (resource_id) WHERE b.resource_id IS NOT NULL
  UNION ALL SELECT user_id, 'total', NULL, NULL, CAST(coalesce(sum(total_minutes) FILTER (resource_id IS NOT NULL), 0) AS BIGINT),
    CAST(sum(sessions_count) AS BIGINT) FROM b GROUP BY 1)
SELECT *, total_minutes / sessions_count AS average_minutes FROM a""")
def _(t):
    return usage.time_spent(t.sessions, t.resources)


@query("agg_study_stats", """
SELECT user_id, count(*) AS total_sessions, CAST(sum(duration_minutes) AS BIGINT) AS total_study_time,
  sum(duration_minutes) / count(*) AS average_session_duration, CAST(sum(attempted) AS BIGINT) AS attempted,
  CAST(sum(correct) AS BIGINT) AS correct, CASE WHEN sum(attempted) > 0 THEN sum(correct) / sum(attempted) * 100 ELSE 0 END AS average_accuracy
FROM v_sessions GROUP BY 1""")
def _(t):
    return usage.study_stats(t.sessions)


@query("agg_study_calendar", """
SELECT user_id, strftime(created_at, '%Y-%m-%d') AS date,
  CAST(sum(CASE WHEN contains(session_type, 'break') THEN 0 ELSE duration_minutes END) AS BIGINT) AS study_minutes,
  CAST(sum(CASE WHEN contains(session_type, 'break') THEN duration_minutes ELSE 0 END) AS BIGINT) AS break_minutes,
  count(*) AS sessions_count FROM v_sessions WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1, 2""")
def _(t):
    return usage.study_calendar(t.sessions, AS_OF)


@query("agg_session_score", """
SELECT id, CASE WHEN coalesce(score, 0) = 0 AND attempted > 0 THEN correct / attempted * 100 ELSE score END AS score FROM v_sessions""")
def _(t):
    return usage.session_score(t.sessions)


view("v_account", """
SELECT u.user_id, coalesce(s.n, 0) AS subjects_count, coalesce(g.n, 0) AS groups_count, coalesce(m.n, 0) AS messages_count,
  round_even(coalesce(r.b, 0) / 1048576.0, 2) AS storage_mb, coalesce(l.n, 0) AS total_logins,
  CAST(coalesce(t.n, 0) AS BIGINT) AS minutes, coalesce(r.n, 0) AS resources_count, coalesce(n.n, 0) AS notes_count
FROM v_users u LEFT JOIN (SELECT user_id, count(*) n FROM v_user_subjects GROUP BY 1) s USING (user_id)
LEFT JOIN (SELECT user_id, count(*) n FROM v_user_groups GROUP BY 1) g USING (user_id)
LEFT JOIN (SELECT user_id, count(*) n FROM v_asked GROUP BY 1) m USING (user_id)
LEFT JOIN (SELECT user_id, count(*) n, CAST(sum(file_size) AS DOUBLE) b FROM v_resources GROUP BY 1) r USING (user_id)
LEFT JOIN (SELECT user_id, count(*) n FROM v_audit WHERE action = 'login' GROUP BY 1) l USING (user_id)
LEFT JOIN (SELECT user_id, sum(duration_minutes) n FROM v_sessions GROUP BY 1) t USING (user_id)
LEFT JOIN (SELECT r.user_id, count(*) n FROM v_notes n JOIN v_resources r USING (resource_id) GROUP BY 1) n USING (user_id)""")


@query("agg_user_admin_stats", """
SELECT user_id, notes_count, subjects_count, groups_count, messages_count, storage_mb, total_logins, minutes FROM v_account""")
def _(t):
    return usage.user_admin_stats(t.users, t.notes, t.resources, t.user_subjects, t.user_groups, t.questions_asked,
                                  t.audit_log, t.sessions)


@query("agg_user_stats", """
WITH l AS (SELECT user_id, created_at, log_id FROM v_audit WHERE action = 'login'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, log_id) <= 5),
g AS (SELECT user_id, string_agg(strftime(created_at, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY created_at DESC, log_id) AS recent FROM l GROUP BY 1)
SELECT a.user_id, a.resources_count AS notes_count, a.subjects_count, a.groups_count, a.messages_count, a.storage_mb, a.minutes,
  coalesce(g.recent, '') AS recent_logins FROM v_account a LEFT JOIN g USING (user_id)""")
def _(t):
    return usage.user_stats(t.users, t.resources, t.user_subjects, t.user_groups, t.questions_asked, t.audit_log, t.sessions)


@query("agg_count_per_parent", """
SELECT r.resource_id, count(n.resource_id) AS child_count FROM v_resources r LEFT JOIN v_notes n USING (resource_id) GROUP BY 1""")
def _(t):
    return usage.count_per_parent(t.resources, t.notes, "resource_id")


@query("agg_distinct_conversations", """
SELECT user_id, count(DISTINCT conversation_id) AS conversations FROM v_asked WHERE created_at >= TIMESTAMP '2024-01-01' GROUP BY 1""")
def _(t):
    return usage.distinct_conversations(t.questions_asked, AS_OF, "month")


@query("agg_period_counts", """
SELECT user_id, count(*) AS n FROM v_audit WHERE created_at >= date_trunc('week', TIMESTAMP '2024-01-31') GROUP BY 1""")
def _(t):
    return usage.period_counts(t.audit_log, AS_OF, "week")


@query("agg_storage_used", """
SELECT user_id, CAST(sum(file_size) AS BIGINT) AS bytes, round_even(sum(file_size) / 1048576.0, 2) AS mb,
  round_even(sum(file_size) / 1073741824.0, 2) AS gb FROM v_resources GROUP BY 1""")
def _(t):
    return usage.storage_used(t.resources)


view("v_quota", """
SELECT m.user_id, q.quota, q.used, q.exact, l.lim AS "limit", l.lim = -1 AS unlimited,
  CASE WHEN q.quota IN ('conversations', 'messages', 'notes') AND coalesce(l.tier, 'free') IN ('free', 'pro') THEN 'month' END AS reset_period
FROM v_members m JOIN (
  SELECT u.user_id, unnest(['resources', 'subjects', 'groups', 'conversations', 'messages', 'exercises', 'notes', 'storage_gb']) AS quota,
   unnest([a.resources_count, a.subjects_count, a.groups_count, coalesce(c.n, 0), a.messages_count, coalesce(e.n, 0),
     CASE WHEN u.tier IN ('unlimited', 'early_tester') THEN a.notes_count ELSE coalesce(f.n, 0) END, round_even(coalesce(b.b, 0) / 1073741824.0, 2)]::DOUBLE[]) AS used,
   unnest([a.resources_count, a.subjects_count, a.groups_count, coalesce(c.n, 0), a.messages_count, coalesce(e.n, 0),
     CASE WHEN u.tier IN ('unlimited', 'early_tester') THEN a.notes_count ELSE coalesce(f.n, 0) END, coalesce(b.b, 0) / 1073741824.0]::DOUBLE[]) AS exact
  FROM v_members u JOIN v_account a USING (user_id)
  LEFT JOIN (SELECT user_id, count(DISTINCT conversation_id) n FROM v_asked GROUP BY 1) c USING (user_id)
  LEFT JOIN (SELECT user_id, count(*) n FROM v_exercises GROUP BY 1) e USING (user_id)
  LEFT JOIN (SELECT r.user_id, count(*) n FROM v_notes n JOIN v_resources r USING (resource_id)
             WHERE n.created_at >= TIMESTAMP '2024-01-01' GROUP BY 1) f USING (user_id)
  LEFT JOIN (SELECT user_id, CAST(sum(file_size) AS DOUBLE) b FROM v_resources GROUP BY 1) b USING (user_id)) q USING (user_id)
JOIN (SELECT unnest(['free', 'pro', 'unlimited', 'early_tester', 'furniture']) AS tier, unnest([
   [50, 10, 5, 100, 500, 20, 50, 5], [500, 100, 50, -1, -1, 200, 500, 100], [-1, -1, -1, -1, -1, -1, -1, -1],
   [-1, -1, -1, -1, -1, -1, -1, -1], [50, 10, 5, 100, 500, 20, 50, 5]]) AS lims) t ON t.tier = m.tier
JOIN LATERAL (SELECT CASE WHEN t.tier = 'furniture' THEN 'free' ELSE t.tier END AS tier, CAST(t.lims[list_position(
  ['resources', 'subjects', 'groups', 'conversations', 'messages', 'exercises', 'notes', 'storage_gb'], q.quota)] AS BIGINT) AS lim) l ON true""")


def quota_rows(t):
    return usage.quota_status(members(t), t.resources, t.user_subjects, t.user_groups, t.questions_asked, exercises(t), t.notes, AS_OF)


@query("agg_quota_status", 'SELECT user_id, quota, used, "limit", unlimited, reset_period FROM v_quota')
def _(t):
    return quota_rows(t).drop("exact")


@query("agg_quota_check", """
SELECT user_id, quota, "limit" = -1 OR CASE WHEN quota = 'storage_gb' THEN exact + 1048576000 / 1073741824.0 <= "limit" ELSE used < "limit" END AS allowed
FROM v_quota""")
def _(t):
    return usage.quota_check(quota_rows(t), new_bytes=1048576000)


@query("agg_quota_cards", """
SELECT user_id, CASE WHEN quota IN ('resources', 'notes', 'exercises') THEN 'items_processed'
    WHEN quota IN ('conversations', 'messages') THEN 'chat_messages' ELSE quota END AS card, sum(used) AS used,
  CASE WHEN bool_or("limit" = -1) THEN -1 ELSE CAST(sum("limit") AS BIGINT) END AS "limit", bool_or(unlimited) AS unlimited
FROM v_quota GROUP BY 1, 2""")
def _(t):
    return usage.quota_cards(quota_rows(t))


@query("agg_conversation_list", """
SELECT user_id, conversation_id, coalesce(nullif(max(title), ''), 'Untitled Conversation') AS title, count(*) AS message_count,
  max(created_at) AS last_message_at, CASE WHEN max(resource_id) IS NOT NULL THEN 'resource' WHEN max(subject_id) IS NOT NULL THEN 'subject'
    WHEN max(group_id) IS NOT NULL THEN 'group' END AS scope_type, bool_or(is_pinned) AS is_pinned, bool_or(is_favourite) AS is_favourite
FROM v_chat GROUP BY 1, 2""")
def _(t):
    return usage.conversation_list(t.chat_messages)


@query("agg_conversation_by_exercise", """
SELECT exercise_id, conversation_id, coalesce(nullif(max(title), ''), 'Untitled Conversation') AS title, count(*) AS message_count,
  max(created_at) AS last_message_at FROM v_chat WHERE exercise_id IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return usage.conversation_by_exercise(t.chat_messages)


@query("agg_conversation_admin", """
SELECT conversation_id, title, count(*) AS message_count, max(created_at) AS last_message_at FROM v_chat GROUP BY 1, 2""")
def _(t):
    return usage.conversation_admin(t.chat_messages)


@query("agg_max_version_next", """
WITH n AS (SELECT o_orderkey AS new_id, o_custkey AS resource_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT new_id, n.resource_id, coalesce(m.v, 0) + n.n AS next_version
FROM n LEFT JOIN (SELECT resource_id, max(version) AS v FROM v_notes GROUP BY 1) m USING (resource_id)""")
def _(t):
    new = t.orders.select(F.col("o_orderkey").alias("new_id"), F.col("o_custkey").alias("resource_id"))
    return reports.next_versions(t.notes, new, [F.col("new_id")])


view("v_titles", """
SELECT CASE p_size % 4 WHEN 0 THEN p_name WHEN 3 THEN p_name || ' draft' ELSE p_name || ' ' || p_size END AS title FROM part""")


@query("agg_next_title_suffix", r"""
WITH b AS (SELECT DISTINCT p_name AS base_title FROM part UNION SELECT DISTINCT p_brand FROM part),
t AS (SELECT DISTINCT title FROM v_titles),
h AS (SELECT base_title, max(CASE WHEN title = base_title THEN 1
   ELSE coalesce(TRY_CAST(nullif(regexp_extract(title, ' (\d+)$', 1), '') AS BIGINT), 0) END) AS n
  FROM b JOIN t ON starts_with(title, base_title) GROUP BY 1)
SELECT base_title, CASE WHEN coalesce(n, 0) > 0 THEN base_title || ' ' || (n + 1) ELSE base_title END AS next_title FROM b LEFT JOIN h USING (base_title)""")
def _(t):
    m = F.pmod("p_size", F.lit(4))
    title = (F.when(m == 0, F.col("p_name")).when(m == 3, F.concat("p_name", F.lit(" draft")))
             .otherwise(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"))))
    bases = t.part.select(F.col("p_name").alias("base_title")).unionByName(t.part.select(F.col("p_brand").alias("base_title")))
    return reports.next_title(t.part.select(title.alias("title")).distinct(), bases)


@query("agg_number_ranges", """
WITH d AS (SELECT DISTINCT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS n FROM lineitem),
g AS (SELECT key, n, n - row_number() OVER (PARTITION BY key ORDER BY n) AS g FROM d),
r AS (SELECT key, min(n) AS a, max(n) AS b FROM g GROUP BY key, g)
SELECT key, CASE WHEN count(*) = 2 THEN string_agg(CASE WHEN a = b THEN a || '' ELSE a || '-' || b END, ' & ' ORDER BY a)
   ELSE string_agg(CASE WHEN a = b THEN a || '' ELSE a || '-' || b END, ', ' ORDER BY a) END AS ranges FROM r GROUP BY 1""")
def _(t):
    return reports.number_ranges(t.lineitem.withColumnRenamed("l_orderkey", "key"), "key", "l_linenumber")


@query("agg_expand_ranges", r"""
WITH p AS (SELECT p_partkey AS title_id, p_brand AS set_id, p_size AS s, CASE WHEN p_size % 7 = 0 THEN NULL
    WHEN p_brand < 'Brand#15' THEN 'Topic' WHEN p_size % 2 = 0 THEN 'Chapter' ELSE 'Lecture' END AS label FROM part),
l AS (SELECT set_id, count(DISTINCT label) = 1 AND count(label) = count(*) AS same FROM p GROUP BY 1),
n AS (SELECT DISTINCT title_id, set_id, label, unnest([s, s + 1, s + 2, s + 9]) AS n FROM p WHERE label IS NOT NULL)
SELECT title_id, CASE WHEN same THEN label END AS label, n FROM n JOIN l USING (set_id)""")
def _(t):
    s = F.col("p_size")
    label = (F.when(s % 7 == 0, F.lit("intro to")).when(F.col("p_brand") < "Brand#15", F.lit("topic"))
             .when(s % 2 == 0, F.lit("CHAPTER")).otherwise(F.lit("Lecture")))
    text = lambda c: c.cast("string")
    title = F.concat(F.lit("Week of "), label, F.lit(" "), F.when(s % 7 == 0, "none").otherwise(
        F.concat(text(s), F.lit("-"), text(s + 2), F.lit(", "), text(s + 9))))
    return reports.expand_ranges(t.part.select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("title_id"), title.alias("title")))


@query("agg_unique_violations", """
SELECT o_custkey AS key, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    return reports.unique_violations(t.orders, [F.col("o_custkey").alias("key")], F.col("o_orderstatus") == "O")


@query("agg_active_progress", """
SELECT user_id, sum(coalesce(progress, 0)) / count(*) AS overall_progress FROM v_tasks WHERE status IN ('pending', 'running') GROUP BY 1""")
def _(t):
    return reports.active_progress(t.tasks)


@query("agg_marks_total", """
WITH g AS (SELECT event_id AS session_id, unnest([
   CASE WHEN event_type = 'click' THEN NULL ELSE CAST(floor(value) AS BIGINT) % 10 END, NULL]) AS mx,
   unnest([CASE WHEN event_type <> 'click' THEN CAST(floor(value) AS BIGINT) % 4 END, NULL]) AS aw,
   unnest([CASE WHEN event_type = 'click' THEN value > 20 END, value > 30]) AS ok FROM events)
SELECT session_id, CAST(sum(coalesce(nullif(mx, 0), CASE WHEN ok IS NOT NULL THEN 1 ELSE 0 END)) AS BIGINT) AS total_max,
  CAST(sum(coalesce(aw, CASE WHEN ok THEN 1 ELSE 0 END)) AS BIGINT) AS total_awarded FROM g GROUP BY 1""")
def _(t):
    v = F.floor("value")
    click = F.col("event_type") == "click"
    one = F.struct(F.when(~click, F.pmod(v, F.lit(10))).alias("total_max"), F.when(~click, F.pmod(v, F.lit(4))).alias("total_awarded"),
                   F.when(click, F.col("value") > 20).alias("is_correct"))
    none = F.lit(None).cast("long")
    two = F.struct(none.alias("total_max"), none.alias("total_awarded"), (F.col("value") > 30).alias("is_correct"))
    return reports.marks_total(t.events.select(F.col("event_id").alias("session_id"),
                                               F.create_map(F.lit("q1"), one, F.lit("q2"), two).alias("question_scores")))


@query("agg_task_performance", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events)
SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,9))) AS DOUBLE) / count(*) AS avg_score,
  CAST(sum(user_id) AS DOUBLE) / count(*) AS avg_ms,
  CAST(sum(CAST(value AS DECIMAL(28,9))) FILTER (rn <= 100) AS DOUBLE) / least(count(*), 100) AS recent_score FROM r GROUP BY 1""")
def _(t):
    runs = t.events.select("event_type", F.col("value").alias("score"), F.col("user_id").alias("ms"), F.col("ts").alias("at"),
                           F.col("event_id").alias("run_id"))
    return reports.task_performance(runs, ["event_type"])


@query("agg_request_metrics", """
WITH b AS (SELECT CASE WHEN starts_with(path, '/note/') THEN '/note/{id}' WHEN starts_with(path, '/notes/') THEN '/notes/{id}'
   WHEN starts_with(path, '/chat/') THEN '/chat/*' ELSE path END AS bucket, status, greatest(CAST(trunc(duration_ms) AS BIGINT), 0) AS ms FROM v_requests),
p AS (SELECT bucket, count(*) AS n FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
SELECT 'requests_total' AS metric, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM b
UNION ALL SELECT 'errors_total', '', CAST(count(*) AS DOUBLE) FROM b WHERE status >= 500
UNION ALL SELECT 'avg_duration_ms', '', round_even(sum(ms) / count(*), 2) FROM b
UNION ALL SELECT 'status', CAST(status AS VARCHAR), CAST(count(*) AS DOUBLE) FROM b GROUP BY status
UNION ALL SELECT 'path', bucket, CAST(n AS DOUBLE) FROM p""")
def _(t):
    return reports.request_metrics(t.requests)


view("v_corrections", """
SELECT user_id AS file, CASE event_type WHEN 'click' THEN 'heading_level' WHEN 'view' THEN 'ignore_image' WHEN 'error' THEN 'ocr_correction'
   WHEN 'purchase' THEN 'mark_list' ELSE 'mark_body' END AS type, 'img_' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) || '.png' AS image_path FROM events""")


def corrections(t):
    et = F.col("event_type")
    kind = (F.when(et == "click", "heading_level").when(et == "view", "ignore_image").when(et == "error", "ocr_correction")
            .when(et == "purchase", "mark_list").otherwise("mark_body"))
    k = F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(5)).cast("string")
    return t.events.select(F.col("user_id").alias("file"), kind.alias("type"), F.concat(F.lit("img_"), k, F.lit(".png")).alias("image_path"))


@query("agg_correction_types", "SELECT type, count(*) AS n, count(*) / sum(count(*)) OVER () * 100 AS pct FROM v_corrections GROUP BY 1")
def _(t):
    return reports.correction_types(corrections(t))


@query("agg_correction_source", """
WITH d AS (SELECT lower(text || ' ' || CASE doc_id % 5 WHEN 0 THEN 'Slide' WHEN 1 THEN 'Figure 2' WHEN 2 THEN 'OCR' ELSE '' END) AS t FROM documents)
SELECT CASE WHEN contains(t, 'slide') THEN 'PPTX' WHEN contains(t, 'page') OR contains(t, 'figure') OR contains(t, 'chapter') THEN 'PDF'
  WHEN contains(t, 'ocr') OR contains(t, 'conf') THEN 'Scanned' ELSE 'Unknown' END AS source_type, count(*) AS n FROM d GROUP BY 1""")
def _(t):
    m = F.pmod("doc_id", F.lit(5))
    tail = F.when(m == 0, "Slide").when(m == 1, "Figure 2").when(m == 2, "OCR").otherwise("")
    return (t.documents.select(reports.source_class(F.concat("text", F.lit(" "), tail)).alias("source_type"))
            .groupBy("source_type").agg(F.count("*").alias("n")))


@query("agg_threshold_tuning", """
WITH c AS (SELECT file, CASE type WHEN 'heading_level' THEN 'SmartPipeline.pptx_heading_thresholds' WHEN 'ocr_correction' THEN 'ImagePreprocessor.clahe_clip_limit'
    WHEN 'ignore_image' THEN NULL ELSE 'SignalMerger.list_detection' END AS target, count(*) AS n FROM v_corrections GROUP BY 1, 2),
i AS (SELECT file, image_path, count(*) AS n FROM v_corrections WHERE type = 'ignore_image' GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, image_path) <= 3)
SELECT file, target, '' AS subject, n AS correction_count, CASE WHEN target LIKE 'Smart%' THEN least(n / 20, 0.95) ELSE least(n / 15, 0.85) END AS confidence
FROM c WHERE target IS NOT NULL AND n >= 3
UNION ALL SELECT file, 'ImageClassifier.skip_images', image_path, n, least(n / 5, 0.95) FROM i WHERE n >= 2""")
def _(t):
    return reports.threshold_tuning(corrections(t))


@query("agg_report_summary", """
SELECT user_id AS run_id, count(*) AS files, count(*) FILTER (event_type = 'error') AS errors,
  round_even(coalesce(CAST(sum(CASE WHEN event_type <> 'view' THEN CAST(value AS DECIMAL(28,9)) END) AS DOUBLE) / count(CASE WHEN event_type <> 'view' THEN 1 END), 0), 4) AS avg_score,
  round_even(coalesce(max(value) FILTER (event_type <> 'view'), 0), 4) AS max_score, round_even(coalesce(min(value) FILTER (event_type <> 'view'), 0), 4) AS min_score,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS images, CAST(sum(event_id % 3) AS BIGINT) AS warnings FROM events GROUP BY 1""")
def _(t):
    results = t.events.select(
        F.col("user_id").alias("run_id"), F.when(F.col("event_type") != "view", F.col("value")).alias("score"),
        F.when(F.col("event_type") == "error", "failed").alias("error"), F.get_json_object("props", "$.k").cast("long").alias("images"),
        F.pmod("event_id", F.lit(3)).alias("warnings"))
    return reports.report_summary(results)


view("v_daily", """
SELECT user_id AS series, strftime(ts, '%Y-%m-%d') AS run_at, round_even(CAST(sum(CAST(value AS DECIMAL(28,9))) AS DOUBLE) / count(*), 4) AS score
FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2""")


@query("agg_score_trend", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY run_at DESC) AS rn, count(*) OVER (PARTITION BY series) AS runs FROM v_daily),
m AS (SELECT series, any_value(runs) AS runs, CAST(sum(CAST(score AS DECIMAL(28,9))) FILTER (rn <= 3) AS DOUBLE) / least(any_value(runs), 3) AS recent,
   CASE WHEN any_value(runs) = 2 THEN min(score) FILTER (rn = 2)
        ELSE coalesce(CAST(sum(CAST(score AS DECIMAL(28,9))) FILTER (rn > 3) AS DOUBLE) / nullif(count(*) FILTER (rn > 3), 0), 0) END AS older FROM r GROUP BY 1)
SELECT series, runs, CASE WHEN runs >= 2 AND recent - older > 0.01 THEN 'up' WHEN runs >= 2 AND recent - older < -0.01 THEN 'down' ELSE 'stable' END AS direction,
  CASE WHEN runs >= 2 THEN round_even(recent - older, 4) END AS change, CASE WHEN runs >= 2 THEN round_even(recent, 4) END AS recent_avg,
  CASE WHEN runs >= 2 THEN round_even(older, 4) END AS older_avg FROM m""")
def _(t):
    daily = (t.events.filter(F.col("event_type").isin("click", "view"))
             .groupBy(F.col("user_id").alias("series"), F.date_format("ts", "yyyy-MM-dd").alias("run_at"))
             .agg(F.bround(reports.exact_sum("value") / F.count("*"), 4).alias("score")))
    return reports.score_trend(daily)


@query("agg_grade_bands", """
SELECT CASE WHEN s >= 0.9 THEN 'A' WHEN s >= 0.75 THEN 'B' WHEN s >= 0.5 THEN 'C' ELSE 'D' END AS grade, count(*) AS n
FROM (SELECT least(value / 50, 1.0) AS s FROM events) GROUP BY 1""")
def _(t):
    return t.events.groupBy(reports.grade(F.least(F.col("value") / 50, F.lit(1.0))).alias("grade")).agg(F.count("*").alias("n"))


@query("agg_scanned_docs", """
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT doc_id, count(*) AS p, CAST(sum(length(trim(line))) AS BIGINT) / count(*) AS cpp FROM p GROUP BY 1)
SELECT doc_id, cpp AS chars_per_page, cpp < 200 AS is_scanned,
  CASE WHEN cpp < 20 THEN 0.95 WHEN cpp < 50 THEN 0.75 WHEN cpp < 200 THEN 0.30 ELSE 0.05 END::DOUBLE AS confidence FROM c""")
def _(t):
    pages = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return reports.scanned(pages)
