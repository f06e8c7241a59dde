"""Source and sink queries: what is written is derived from the supplied tables and read back."""

import uuid

from pyspark.sql import functions as F

from scholia.operators import quality as Q
from scholia.params import AS_OF
from scholia.plans.registry import query, view
from scholia.session import scratch_path
from scholia.sources import readers as R
from scholia.sources import writers as W


@query("src_table_scan", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def _(t):
    return R.scan(t, "orders", ["o_orderkey"], limit=100, offset=200)


@query("src_table_catalog", """
SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS table_name""")
def _(t):
    return R.catalog(t)


@query("src_jdbc", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey > 50")
def _(t):
    """The orders as a table of an embedded database, read back in eight ranges of their key; the filter goes to the database."""
    url, driver = f"jdbc:derby:memory:scholia-{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    upper = lambda df: df.toDF(*[c.upper() for c in df.columns])
    W.write_jdbc(upper(orders), url, "ORDERS", driver=driver)
    ends = orders.agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).first()
    back = R.jdbc(t.spark, url, "ORDERS", "O_ORDERKEY", ends.lo or 0, (ends.hi or 0) + 1, 8, driver=driver)
    return back.filter("O_CUSTKEY > 50").toDF(*orders.columns)


@query("src_text_docs", "SELECT item_id, text FROM benchmark")
def _(t):
    path = scratch_path(t.spark, "text")
    t.benchmark.select("item_id", "text").write.partitionBy("item_id").text(path)
    docs = R.text_documents(t.spark, path)
    return docs.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.regexp_replace("text", r"\n\z", "").alias("text"))


@query("src_json_side", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return R.json_column(t.events.withColumnRenamed("event_id", "id"), "id", "props", "k bigint").select("id", "parsed.k")


@query("src_reports_json", """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, user_id AS files_processed, value AS average_score FROM events WHERE event_id % 10 <> 0""")
def _(t):
    report = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                                F.struct(F.col("user_id").alias("files_processed"), F.col("value").alias("average_score")).alias("summary")))
    broken = F.when(F.pmod("event_id", F.lit(10)) == 0, F.substring(report, 1, 25)).otherwise(report)
    path = scratch_path(t.spark, "reports")
    t.events.select(broken.alias("value")).write.text(path)
    return R.reports(t.spark, path)


@query("src_corrections_json", """
SELECT 'c' || event_id AS file, event_type AS type, 'h2' AS "from", 'h1' AS "to", user_id AS line, NULL::VARCHAR AS text, NULL::VARCHAR AS image_path FROM events
UNION ALL SELECT 'c' || event_id, 'ignore_image', NULL, NULL, NULL, NULL, event_type || '.png' FROM events""")
def _(t):
    et = F.col("event_type")
    one = F.struct(et.alias("type"), F.lit("h2").alias("from"), F.lit("h1").alias("to"), F.col("user_id").alias("line"),
                   F.lit(None).cast("string").alias("image_path"))
    none = F.lit(None).cast("string")
    two = F.struct(F.lit("ignore_image").alias("type"), none.alias("from"), none.alias("to"), F.lit(None).cast("long").alias("line"),
                   F.concat(et, F.lit(".png")).alias("image_path"))
    path = scratch_path(t.spark, "corrections")
    name = F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("file")
    W.write_lines(t.events.select(name, F.array(one, two).alias("corrections")), path)
    return R.corrections(t.spark, path)


def log_rows(t):
    """Log lines from events; every ninth has no time stamp."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    logger = F.when(F.col("event_type") == "view", "uvicorn.access").otherwise("app.worker")
    message = F.concat(F.col("event_type"), F.lit(" rs_"), F.col("user_id").cast("string"), F.lit(" #"), F.col("event_id").cast("string"))
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000"))
    line = F.concat(stamp, F.lit(" ["), level, F.lit("] "), logger, F.lit(": "), message)
    source = F.when(F.col("event_type") == "error", "errors.log").when(F.col("event_type") == "click", "worker.log").otherwise("backend.log")
    return t.events.select(F.when(F.pmod("event_id", F.lit(9)) == 0, message).otherwise(line).alias("value"), source.alias("log"))


def written_logs(t):
    path = scratch_path(t.spark, "logs")
    log_rows(t).withColumn("file", F.col("log")).select("value", "file").write.partitionBy("file").text(path)
    lines = R.log_files(t.spark, [path])
    return lines.withColumn("source", F.regexp_replace("source", "^file=", ""))


view("v_log", r"""
SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ',000' END AS timestamp,
  CASE WHEN event_id % 9 <> 0 THEN CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END END AS level,
  CASE WHEN event_id % 9 <> 0 THEN CASE event_type WHEN 'view' THEN 'uvicorn.access' ELSE 'app.worker' END END AS logger,
  event_type || ' rs_' || user_id || ' #' || event_id AS message, CASE event_type WHEN 'error' THEN 'errors.log' WHEN 'click' THEN 'worker.log' ELSE 'backend.log' END AS source FROM events""")


@query("src_log_lines", "SELECT timestamp, level, logger, message FROM v_log")
def _(t):
    return R.parse_log(written_logs(t))


@query("src_log_entity_trail", """
WITH h AS (SELECT timestamp, coalesce(level, 'INFO') AS level, coalesce(logger, source) AS logger, message, source FROM v_log
   WHERE contains(message, 'rs_1') AND coalesce(logger, '') <> 'uvicorn.access')
SELECT * FROM h ORDER BY coalesce(timestamp, '') DESC, source DESC, message DESC LIMIT 200""")
def _(t):
    return R.entity_trail(written_logs(t), "rs_1")


@query("src_log_search", """
SELECT timestamp, level, logger, message FROM v_log WHERE contains(lower(concat_ws(' ', timestamp, level, logger, message)), 'error')""")
def _(t):
    return R.search_log(R.parse_log(written_logs(t)), "ERROR")


@query("rel_union_files", """
SELECT source, count(*) AS n, count(timestamp) AS stamped FROM v_log GROUP BY 1""")
def _(t):
    return (R.parse_log(written_logs(t), ["source"]).groupBy("source")
            .agg(F.count("*").alias("n"), F.count("timestamp").alias("stamped")))


@query("src_file_listing")
def _(t):
    return R.file_listing(t.spark, t.sf_dir, "*.parquet")


@query("src_binary_md5")
def _(t):
    return R.file_digests(t.spark, t.sf_dir, "*.parquet")


# -- sinks ------------------------------------------------------------------------------------------


@query("snk_json_side", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(t):
    path = scratch_path(t.spark, "json")
    W.write_json(t.documents.select("doc_id", "lang", "source", "n_chars"), path, "doc_id")
    return t.spark.read.schema("doc_id bigint, lang string, source string, n_chars bigint").json(path).drop("bucket")


@query("snk_user_export", """
SELECT user_id, 'profile' AS section, 0 AS part, '{"full_name":"' || full_name || '","email":"' || email || '"}' AS export_json FROM v_users
UNION ALL SELECT user_id, 'subjects', 0, '[' || string_agg('{"subject_id":' || subject_id || ',"name":"' || name || '"}', ',' ORDER BY subject_id) || ']' FROM v_user_subjects GROUP BY 1
UNION ALL SELECT user_id, 'resources', 0, '[' || string_agg('{"resource_id":' || resource_id || ',"title":"' || title || '","subject_id":' || subject_id || '}', ',' ORDER BY resource_id) || ']' FROM v_resources GROUP BY 1""")
def _(t):
    return W.user_export(t.users.select("user_id", "full_name", "email"), {
        "subjects": (t.user_subjects, "subject_id", ["name"]),
        "resources": (t.resources, "resource_id", ["title", "subject_id"])})


@query("snk_embeddings_json", "SELECT vec_id AS id, len(embedding) AS n, round_even(list_sum(embedding::DOUBLE[]), 3) AS total FROM embeddings")
def _(t):
    path = scratch_path(t.spark, "vectors")
    t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).write.json(path)
    back = t.spark.read.schema("id bigint, vector array<float>").json(path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("id", F.size("vector").cast("long").alias("n"), F.bround(total, 3).alias("total"))


def trimmed(c):
    return rf"regexp_replace({c}, '^[\s\p{{Z}}\x{{0b}}\x{{85}}]+|[\s\p{{Z}}\x{{0b}}\x{{85}}]+$', '', 'g')"


@query("snk_jsonl_train", f"""
WITH p AS (SELECT u.conversation_id || '-' || u.turn AS id, {trimmed('u.text')} AS r, {trimmed('a.text')} AS p FROM v_turns u JOIN v_turns a ON a.conversation_id = u.conversation_id
  AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
k AS (SELECT *, row_number() OVER (ORDER BY md5(id || 'seed'), id) AS i, count(*) OVER () AS n FROM p WHERE r <> '' AND p <> '')
SELECT CASE WHEN i <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'valid' END AS split, 'system=Format;user=' || r || ';assistant=' || p AS messages FROM k""")
def _(t):
    """Pairs of a question and its answer, split, written as train and validation files of chat messages, and read back."""
    key = F.concat_ws("-", "conversation_id", "turn").alias("id")
    answers = t.turns.filter("role = 'assistant'").withColumn("turn", F.col("turn") - 1)
    pairs = Q.training_pairs(t.turns.filter("role = 'user'").select(key, "text"), answers.select(key, "text"), "Format")
    path = scratch_path(t.spark, "pairs")
    W.write_chat_files(pairs.join(Q.split_pairs(pairs, "seed"), "id"), path)
    back = t.spark.read.text(path).select("split", F.from_json("value", "messages array<struct<role:string,content:string>>").alias("r"))
    return back.select("split", F.array_join(F.transform("r.messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), ";").alias("messages"))


@query("snk_replace_by_key", """
SELECT doc_id AS resource_id, unnest([0, 1]) AS chunk_index, unnest([substr(text, 1, length(text) // 2), substr(text, length(text) // 2 + 1)]) AS text FROM documents WHERE lang <> 'fr'
UNION ALL SELECT doc_id, 0, text FROM documents WHERE lang = 'fr'""")
def _(t):
    """Every text in halves, then French ones anew as a whole."""
    fields, path = "resource_id bigint, chunk_index int, text string", scratch_path(t.spark, "chunks")
    half = F.floor(F.length("text") / 2).cast("int")
    part = lambda i, text: F.struct(F.lit(i).alias("chunk_index"), text.alias("text"))
    halves = F.array(part(0, F.substr("text", F.lit(1), half)), part(1, F.substr(F.col("text"), half + 1)))
    docs, french = t.documents.filter("text is not null"), t.documents.filter("lang = 'fr'")
    W.create_buckets(t.spark, path, fields)
    W.replace_buckets(path, docs.select(F.col("doc_id").alias("resource_id"), F.inline(halves)), docs.select(F.col("doc_id").alias("resource_id")), "resource_id", 1)
    whole = french.select(F.col("doc_id").alias("resource_id"), F.lit(0).alias("chunk_index"), "text")
    W.replace_buckets(path, whole, whole.select("resource_id"), "resource_id", 2)
    return W.read_buckets(t.spark, path, fields).drop("bucket")


@query("snk_upsert_task", """
WITH s AS (SELECT o_orderkey AS task_id, o_custkey AS user_id, o_orderpriority AS task_type FROM orders WHERE o_orderstatus = 'F')
SELECT task_id, user_id, task_type, status, progress, updated_at FROM v_tasks WHERE task_id NOT IN (SELECT task_id FROM s)
UNION ALL SELECT task_id, user_id, task_type, 'pending', 0, TIMESTAMP '2024-01-31' FROM s""")
def _(t):
    submitted = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("user_id"),
                                                              F.col("o_orderpriority").alias("task_type"))
    return W.upsert_tasks(t.tasks, submitted, AS_OF)


@query("snk_upsert_defaults", """
WITH e AS (SELECT p_partkey AS id, p_brand AS name, CAST(p_size AS BIGINT) AS v FROM part), d AS (SELECT s_suppkey * 30 AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS v FROM supplier),
u AS (SELECT e.id, coalesce(d.name, e.name) AS name, coalesce(d.v, e.v) AS v FROM e LEFT JOIN d USING (id))
SELECT 'insert' AS how, * FROM e UNION ALL SELECT 'insert', * FROM d WHERE id NOT IN (SELECT id FROM e)
UNION ALL SELECT 'update', * FROM u UNION ALL SELECT 'update', * FROM d WHERE id NOT IN (SELECT id FROM e)""")
def _(t):
    e = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_size").cast("long").alias("v"))
    d = t.supplier.select((F.col("s_suppkey") * 30).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("v"))
    return (W.insert_missing(e, d, "id").withColumn("how", F.lit("insert"))
            .unionByName(W.update_seeded(e, d, "id", ["name", "v"]).withColumn("how", F.lit("update"))))


@query("snk_retention_purge", """
SELECT purged, status, count(*) AS n FROM (SELECT status, updated_at < TIMESTAMP '2024-01-21' AND status IN ('completed', 'failed') AS purged FROM v_tasks) GROUP BY 1, 2""")
def _(t):
    return W.purge(t.tasks, AS_OF, 10).groupBy("purged", "status").agg(F.count("*").alias("n"))


@query("snk_bulk_status_reset", """
SELECT task_id, CASE status WHEN 'running' THEN 'pending' ELSE status END AS status, CASE status WHEN 'running' THEN 'Recovered from stuck state (server restart)' END AS error_message FROM v_tasks""")
def _(t):
    return W.reset_running(t.tasks)


@query("snk_toggle_group_flag", """
SELECT conversation_id, NOT arg_min(coalesce(is_favourite, false), (created_at, turn)) AS new_flag FROM v_chat GROUP BY 1""")
def _(t):
    return W.toggle_group_flag(t.chat_messages, "is_favourite")


@query("snk_cascade_delete", """
SELECT 'group' AS level, group_id AS id FROM v_groups WHERE name NOT LIKE 'A%'
UNION ALL SELECT 'subject', subject_id FROM v_subjects WHERE group_id IS NULL OR group_id NOT IN (SELECT group_id FROM v_groups WHERE name LIKE 'A%')
UNION ALL SELECT 'resource', r.resource_id FROM v_resources r WHERE subject_id NOT IN (SELECT subject_id FROM v_subjects WHERE group_id IN (SELECT group_id FROM v_groups WHERE name LIKE 'A%'))
UNION ALL SELECT 'note', n.resource_id FROM v_notes n WHERE resource_id NOT IN (SELECT r.resource_id FROM v_resources r JOIN v_subjects s USING (subject_id) WHERE s.group_id IN (SELECT group_id FROM v_groups WHERE name LIKE 'A%'))""")
def _(t):
    doomed = t.groups.filter(F.col("name").startswith("A")).select("group_id")
    subjects = t.subjects.select("subject_id", "group_id")
    g, s, r, n = W.cascade_delete([(t.groups, "group_id", None), (subjects, "subject_id", "group_id"),
                                   (t.resources.select("resource_id", "subject_id"), "resource_id", "subject_id"),
                                   (t.notes.select("note_id", "resource_id"), "note_id", "resource_id")], doomed)
    tag = lambda df, level, c: df.select(F.lit(level).alias("level"), F.col(c).alias("id"))
    return (tag(g, "group", "group_id").unionByName(tag(s, "subject", "subject_id")).unionByName(tag(r, "resource", "resource_id"))
            .unionByName(tag(n, "note", "resource_id")))


@query("snk_orphan_cleanup", """
SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT o_custkey FROM orders)""")
def _(t):
    return W.orphans(t.lineitem.select(F.col("l_partkey").alias("id")), t.orders.select(F.col("o_custkey").alias("id")), "id")
