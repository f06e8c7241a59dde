"""SQL form of the derived domain tables, for the twins."""

from scholia.plans.registry import view

view("v_users", """
SELECT c_custkey AS user_id, c_name AS full_name,
       CASE WHEN c_acctbal > 0 THEN 'u' || c_custkey END AS nickname,
       lower(c_name || '@example.com') AS email, lower(c_mktsegment) AS tier, CAST(c_nationkey AS BIGINT) AS subject_id
FROM customer""")
view("v_groups", "SELECT CAST(r_regionkey AS BIGINT) AS group_id, r_name AS name FROM region")
view("v_subjects", """
SELECT CAST(n_nationkey AS BIGINT) AS subject_id, n_name AS name,
       CASE WHEN n_regionkey <> 4 THEN CAST(n_regionkey AS BIGINT) END AS group_id FROM nation""")
view("v_user_subjects", "SELECT s_suppkey AS subject_id, s_name AS name, CAST(s_nationkey AS BIGINT) AS user_id FROM supplier")
view("v_user_groups", """
SELECT CAST(n_nationkey AS BIGINT) AS group_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS user_id FROM nation""")
view("v_resources", """
SELECT o_orderkey AS resource_id, o_custkey AS user_id, 'Resource ' || o_orderkey AS title, o_orderstatus AS status,
       o_orderpriority AS kind, o_orderdate AS created_at, o_custkey % 25 AS subject_id,
       CAST(floor(o_totalprice) AS BIGINT) * 100 AS file_size FROM orders""")
view("v_notes", """
SELECT 'nt_' || l_orderkey || '_' || l_partkey || '_' || l_suppkey || '_' || l_linenumber || '_'
         || strftime(l_shipdate, '%Y%m%d') AS note_id,
       l_orderkey AS resource_id, CAST(l_linenumber AS BIGINT) AS version, l_shipdate AS created_at,
       CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS user_id, l_returnflag = 'A' AS is_pinned,
       CAST(trunc(l_quantity) AS BIGINT) AS n_words FROM lineitem""")
view("v_sessions", """
SELECT event_id AS id, user_id, nullif(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS resource_id,
       CASE event_type WHEN 'view' THEN 'short_break' WHEN 'signup' THEN 'long_break' ELSE 'study' END AS session_type,
       CAST(floor(value) AS BIGINT) AS duration_minutes, CAST(floor(value) AS BIGINT) % 11 AS attempted,
       CAST(floor(value) AS BIGINT) % (CAST(floor(value) AS BIGINT) % 11 + 1) AS correct,
       CASE WHEN event_type = 'click' THEN value END AS score, ts AS created_at FROM events""")
view("v_tasks", """
SELECT event_id AS task_id, user_id,
       CASE event_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'chat' ELSE 'exercise' END AS task_type,
       CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed'
            WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status,
       CASE WHEN value < 100 THEN CAST(floor(value) AS BIGINT) END AS progress, ts AS updated_at FROM events""")
view("v_audit", """
SELECT event_id AS log_id, user_id, CASE WHEN event_type = 'signup' THEN 'login' ELSE event_type END AS action,
       ts AS created_at FROM events""")
view("v_asked", """
SELECT event_id AS message_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS conversation_id,
       ts AS created_at FROM events WHERE event_type = 'click'""")
view("v_requests", """
SELECT event_id AS request_id, user_id, ts,
       CASE event_type WHEN 'click' THEN '/chat/' || event_id WHEN 'view' THEN '/note/' || event_id
            WHEN 'purchase' THEN '/notes/list' WHEN 'signup' THEN '/uploads/' || user_id ELSE '/health' END AS path,
       CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 17 = 0 THEN 404 ELSE 200 END AS status,
       value AS duration_ms FROM events""")
view("v_turns", """
SELECT conv_id AS conversation_id, turn, role, text, conv_id % 150 AS user_id,
       TIMESTAMP '1970-01-01 00:00:00' + turn * INTERVAL 1 SECOND AS created_at FROM conversations""")
view("v_chat", """
SELECT u.conversation_id, u.turn, u.user_id, u.text AS message, a.text AS response, u.created_at,
       CASE WHEN u.turn <= 1 THEN substr(u.text, 1, 40) END AS title,
       u.conversation_id % 7 = 0 AS is_pinned, u.conversation_id % 5 = 0 AND u.turn > 1 AS is_favourite,
       CASE WHEN u.conversation_id % 4 = 1 THEN u.conversation_id END AS resource_id,
       CASE WHEN u.conversation_id % 4 IN (1, 2) THEN u.conversation_id % 25 END AS subject_id,
       CASE WHEN u.conversation_id % 4 = 3 THEN u.conversation_id % 5 END AS group_id,
       CASE WHEN u.conversation_id % 3 = 0 THEN u.conversation_id % 10 END AS exercise_id
FROM v_turns u LEFT JOIN v_turns a
  ON a.conversation_id = u.conversation_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""")

def marked(cases: str) -> str:
    """Lines of each document reshaped by their 0-based place i; DuckDB counts from 1."""
    return f"""
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: {cases}), chr(10)) AS text FROM documents"""


view("v_md", marked("""CASE (j - 1) % 14 WHEN 0 THEN '# ' || x WHEN 2 THEN '- ' || x WHEN 3 THEN '## ' || x WHEN 4 THEN '1. ' || x
  WHEN 5 THEN '| ' || replace(x, ' ', ' | ') || ' |' WHEN 6 THEN '|---|---|' || chr(10) || x WHEN 7 THEN '#### ' || x WHEN 8 THEN '```' || chr(10) || x WHEN 10 THEN '```' || chr(10) || x
  WHEN 9 THEN 'x = f(' || x || ');' WHEN 11 THEN chr(10) || x WHEN 12 THEN '![fig](' || substr(x, 1, 3) || '.png) see figure 2 ' || x
  WHEN 13 THEN '# Topic 4: ' || x ELSE x END"""))
view("v_slides", marked("""CASE (j - 1) % 11 WHEN 0 THEN '### ' || x || ' (1 of 3)' WHEN 1 THEN '© 2024 ' || x WHEN 2 THEN '•' || chr(10) || x
  WHEN 3 THEN '<!-- Start of picture text -->' || chr(10) || x WHEN 4 THEN substr(x, 1, 9) || '<br>' || x
  WHEN 5 THEN '<!-- End of picture text -->' || chr(10) || x WHEN 6 THEN '##### ' || x WHEN 7 THEN ' 12 ' || chr(10) || x WHEN 8 THEN x || ' All rights reserved'
  WHEN 9 THEN '# ' || x ELSE x END"""))
view("v_scans", marked("""CASE (j - 1) % 13 WHEN 0 THEN 'SECTION ALPHA-BETA' || chr(10) || x WHEN 1 THEN '• ' || x WHEN 2 THEN '1 2 3.5 4 5' || chr(10) || x WHEN 3 THEN '>}' || chr(10) || x
  WHEN 4 THEN x || '-' WHEN 5 THEN 'Page 3' || chr(10) || x WHEN 6 THEN 'www.example.com' || chr(10) || x WHEN 7 THEN '1. ' || x WHEN 8 THEN x || '|| _____ x·'
  WHEN 9 THEN '  q  ' || x WHEN 10 THEN 'Page 3 of ' || length(x) || chr(10) || x WHEN 11 THEN 'KPI: 12 ROWS!' || chr(10) || x
  WHEN 12 THEN 'Chapter 2 ' || x ELSE x END"""))
for _name, _of in (("v_md_lines", "v_md"), ("v_slide_lines", "v_slides"), ("v_scan_lines", "v_scans"), ("v_doc_lines", "documents")):
    view(_name, f"""
SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos,
  len(string_split(text, chr(10))) AS total, regexp_replace(line, '^[\\s\\p{{Z}}\\x{{0b}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{0b}}\\x{{85}}]+$', '', 'g') AS s FROM {_of}""")
