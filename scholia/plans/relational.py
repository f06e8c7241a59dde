"""Lookups, joins, rankings and set operations bound to the supplied tables."""

from pyspark.sql import functions as F

from scholia.functions.ordered import latest, top_per_key
from scholia.operators import joins, lookups, ranking
from scholia.params import AS_OF, AS_OF_SQL
from scholia.plans.registry import query, view

# -- filters and predicates ------------------------------------------------------------------


@query("rel_point_lookup", """
SELECT r.* FROM v_resources r WHERE EXISTS (
  SELECT 1 FROM lineitem l WHERE l.l_orderkey = r.resource_id AND l.l_partkey = r.user_id)""")
def _(t):
    asked = t.lineitem.select(F.col("l_orderkey").alias("resource_id"), F.col("l_partkey").alias("user_id"))
    return lookups.owned_lookup(t.resources, asked, "resource_id", "user_id")


@query("rel_optional_filters", "SELECT * FROM v_sessions WHERE session_type = 'study' AND resource_id = 7")
def _(t):
    return lookups.optional_filters(t.sessions, [F.col("created_at").desc(), F.col("id")],
                                    session_type="study", resource_id=7, user_id=None)


@query("rel_in_list", """
SELECT k.key, p.p_partkey IS NOT NULL AS found
FROM (SELECT DISTINCT CAST(p_size * 53 AS BIGINT) AS key FROM part) k LEFT JOIN part p ON p.p_partkey = k.key""")
def _(t):
    keys = t.part.select((F.col("p_size") * 53).cast("long").alias("key"))
    return lookups.in_list(t.part.withColumnRenamed("p_partkey", "key"), keys, "key")


@query("rel_ci_equality", """
SELECT u.user_id, u.email FROM v_users u JOIN supplier s
  ON u.email = lower('CUSTOMER#' || substr(s.s_name, 10) || '@EXAMPLE.com')
WHERE u.user_id <> s.s_suppkey * 2""")
def _(t):
    asked = t.supplier.select(F.concat(F.lit("CUSTOMER#"), F.expr("substr(s_name, 10)"), F.lit("@EXAMPLE.com")).alias("email"),
                              (F.col("s_suppkey") * 2).alias("exclude_id"))
    return lookups.ci_equality(t.users, asked)


@query("rel_prefix_like", """
SELECT p_name, max(p_partkey) AS p_partkey FROM part WHERE starts_with(p_name, 'small ') GROUP BY p_name""")
def _(t):
    hits = lookups.prefix_match(t.part, "p_name", "small ").select("p_name", "p_partkey")
    return hits.groupBy("p_name").agg(F.max("p_partkey").alias("p_partkey"))


@query("rel_null_predicates", "SELECT * FROM v_sessions WHERE resource_id IS NULL OR resource_id <> 5")
def _(t):
    return lookups.not_equal_or_null(t.sessions, "resource_id", 5)


view("v_templates", """
SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size > 10 THEN CAST(p_size AS BIGINT) END AS user_id,
       p_brand = 'Brand#1' AS is_default FROM part""")


@query("rel_own_or_shared", "SELECT id, name, is_default FROM v_templates WHERE user_id = 20 OR user_id IS NULL")
def _(t):
    templates = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                              F.when(F.col("p_size") > 10, F.col("p_size").cast("long")).alias("user_id"),
                              (F.col("p_brand") == "Brand#1").alias("is_default"))
    return lookups.own_or_shared(templates, 20).select("id", "name", "is_default")


@query("rel_substring_search", """
SELECT * FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')""")
def _(t):
    return lookups.substring_search(t.part, ["p_name", "p_type"], "RING")


@query("rel_derived_flags", r"""
SELECT doc_id AS id, coalesce(source, '') <> '' AS has_output, coalesce(trim(text), '') <> '' AS has_content,
       CAST(length(text) - length(replace(text, '?', '')) AS BIGINT) AS question_count FROM documents""")
def _(t):
    return t.documents.select(
        F.col("doc_id").alias("id"), (F.coalesce("source", F.lit("")) != "").alias("has_output"),
        (F.coalesce(F.trim("text"), F.lit("")) != "").alias("has_content"),
        (F.length("text") - F.length(F.replace("text", F.lit("?"), F.lit("")))).cast("long").alias("question_count"))


@query("rel_hung_flag", f"""
SELECT task_id, status IN ('pending', 'running') AND date_diff('second', updated_at, {AS_OF_SQL}) > 3600 AS is_hung
FROM v_tasks""")
def _(t):
    return t.tasks.select("task_id", lookups.is_hung(AS_OF).alias("is_hung"))


@query("rel_token_valid", """
WITH i AS (SELECT o_orderkey AS token, o_orderstatus = 'F' AS is_used, o_orderdate AS expires_at,
                  o_orderpriority = '5-LOW' AS link_only, lower(c_name) AS invited_email,
                  CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE c_name END AS presented_email
           FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT token, CASE WHEN is_used THEN 'used' WHEN expires_at < TIMESTAMP '1996-01-01' THEN 'expired'
   WHEN NOT link_only AND lower(invited_email) <> lower(presented_email) THEN 'wrong_email' ELSE 'ok' END AS reason FROM i)
SELECT token, reason = 'ok' AS is_valid, reason FROM r""")
def _(t):
    import datetime
    invites = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
               .select(F.col("o_orderkey").alias("token"), (F.col("o_orderstatus") == "F").alias("is_used"),
                       F.col("o_orderdate").alias("expires_at"), (F.col("o_orderpriority") == "5-LOW").alias("link_only"),
                       F.lower("c_name").alias("invited_email"),
                       F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "x").otherwise(F.col("c_name")).alias("presented_email")))
    return lookups.token_status(invites, datetime.datetime(1996, 1, 1))


@query("rel_ip_rules", """
WITH q AS (SELECT event_id AS request_id, CASE event_id % 4 WHEN 0 THEN '10.0.0.' WHEN 1 THEN '192.168.1.'
              WHEN 2 THEN '8.8.4.' ELSE '127.0.0.' END || (user_id % 256) AS ip FROM events),
b AS (SELECT DISTINCT '192.168.1.' || s_suppkey % 256 AS ip FROM supplier WHERE s_acctbal < 0 OR s_suppkey % 2 = 0),
r AS (SELECT request_id, CASE WHEN NOT (starts_with(q.ip, '127.') OR starts_with(q.ip, '192.168.') OR starts_with(q.ip, '10.')
         OR q.ip = '::1') THEN 'lockdown' WHEN b.ip IS NOT NULL THEN 'blacklisted' ELSE 'ok' END AS reason
      FROM q LEFT JOIN b ON b.ip = q.ip)
SELECT request_id, reason = 'ok' AS allowed, reason FROM r""")
def _(t):
    m = F.pmod("event_id", F.lit(4))
    net = F.when(m == 0, "10.0.0.").when(m == 1, "192.168.1.").when(m == 2, "8.8.4.").otherwise("127.0.0.")
    req = t.events.select(F.col("event_id").alias("request_id"),
                          F.concat(net, F.pmod("user_id", F.lit(256)).cast("string")).alias("ip"))
    odd = (F.col("s_acctbal") >= 0) & (F.pmod("s_suppkey", F.lit(2)) != 0)
    rules = t.supplier.select(
        F.lit("specific_ip").alias("rule_type"), F.when(odd, "whitelist").otherwise("blacklist").alias("filter_type"),
        F.concat(F.lit("192.168.1."), F.pmod("s_suppkey", F.lit(256)).cast("string")).alias("value"))
    return lookups.ip_rules(req, rules, lockdown=True)


view("v_entities", """
SELECT DISTINCT note_id AS entity_id FROM v_notes UNION ALL SELECT 'rs_' || resource_id FROM v_resources
UNION ALL SELECT 'zz_' || user_id FROM v_users""")


def entities(t):
    text = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string")).alias("entity_id")
    return (t.notes.select(F.col("note_id").alias("entity_id")).distinct()
            .unionByName(t.resources.select(text("rs_", "resource_id"))).unionByName(t.users.select(text("zz_", "user_id"))))


@query("rel_id_type_tag", """
SELECT entity_id, CASE WHEN starts_with(entity_id, 'rs_') THEN 'resource' WHEN starts_with(entity_id, 'nt_') THEN 'note'
  WHEN starts_with(entity_id, 'ex_') THEN 'exercise' ELSE 'unowned' END AS entity_type FROM v_entities""")
def _(t):
    return entities(t).select("entity_id", lookups.entity_type(F.col("entity_id")).alias("entity_type"))


@query("rel_owner_resolve", """
SELECT e.entity_id, coalesce(CAST(coalesce(r1.user_id, n.user_id, r2.user_id) AS VARCHAR), 'unowned') AS owner
FROM v_entities e LEFT JOIN (SELECT DISTINCT note_id, resource_id, user_id FROM v_notes) n ON n.note_id = e.entity_id
LEFT JOIN v_resources r1 ON r1.resource_id = n.resource_id
LEFT JOIN v_resources r2 ON 'rs_' || r2.resource_id = e.entity_id""")
def _(t):
    return joins.owner_of_entities(entities(t), t.notes.select("note_id", "resource_id", "user_id"), t.resources)


@query("rel_validate_rows", r"""
WITH d AS (SELECT d.doc_id, d.lang IN ('en', 'fr', 'de') AS t1, d.n_chars <= 10000 AS t2,
    coalesce(l.quality * 5 BETWEEN 0 AND 4, true) AS t3,
    regexp_matches(d.source, '^[a-z0-9]{2,4}$') AS t4 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, t1 AND t2 AND t3 AND t4 AS is_valid,
   array_to_string(list_filter([CASE WHEN NOT t1 THEN 'type' END, CASE WHEN NOT t2 THEN 'size' END,
     CASE WHEN NOT t3 THEN 'rating' END, CASE WHEN NOT t4 THEN 'name' END], lambda x: x IS NOT NULL), ',') AS reasons FROM d""")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    return lookups.validity(d, "doc_id", {
        "type": F.col("lang").isin("en", "fr", "de"), "size": F.col("n_chars") <= 10000,
        "rating": F.coalesce((F.col("quality") * 5).between(0, 4), F.lit(True)),
        "name": F.col("source").rlike("^[a-z0-9]{2,4}$")})


@query("rel_display_formats", r"""
WITH d AS (SELECT doc_id, n_chars * n_chars AS b, n_chars % 200 AS m, lang FROM documents)
SELECT doc_id AS id,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', b / 1024) || ' KB'
       WHEN b < 1073741824 THEN printf('%.1f', b / 1048576) || ' MB' ELSE printf('%.1f', b / 1073741824) || ' GB' END AS size_label,
  CASE WHEN m >= 60 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE m || 'm' END AS duration_label,
  CASE lang WHEN 'en' THEN 'Deep Dive in Bullet Points (Fast)' WHEN 'fr' THEN 'Deep Dive in Bullet Points' ELSE 'Deep Dive' END AS mode_label,
  CASE lang WHEN 'en' THEN 'PDF' WHEN 'fr' THEN 'Image' WHEN 'de' THEN 'MARKDOWN' ELSE 'DOCUMENT' END AS family
FROM d""")
def _(t):
    lang = F.col("lang")
    size = F.col("n_chars") * F.col("n_chars")
    mime = F.when(lang == "en", "application/pdf").when(lang == "fr", "image/png").when(lang == "de", "text/markdown")
    return t.documents.select(
        F.col("doc_id").alias("id"), lookups.byte_size(size).alias("size_label"),
        lookups.study_time(F.pmod("n_chars", F.lit(200))).alias("duration_label"),
        lookups.parameter_label(F.lit("deep_dive"), F.when(lang.isin("en", "fr"), "bullet_points"),
                                F.when(lang == "en", "fast")).alias("mode_label"),
        lookups.mime_family(mime).alias("family"))


# -- joins ------------------------------------------------------------------------------------


@query("rel_inner_join", """
SELECT n.note_id, r.title, r.user_id, n.created_at FROM v_notes n JOIN v_resources r USING (resource_id)""")
def _(t):
    return joins.notes_with_owner(t.notes, t.resources)


@query("rel_outer_or_owner", """
SELECT n.note_id, n.user_id AS owner FROM v_notes n WHERE n.user_id IS NOT NULL
UNION ALL SELECT n.note_id, r.user_id FROM v_notes n JOIN v_resources r USING (resource_id)
WHERE n.user_id IS DISTINCT FROM r.user_id""")
def _(t):
    return joins.note_owner_either(t.notes, t.resources)


@query("rel_semi_in_subquery", """
SELECT * FROM v_notes WHERE resource_id IN (SELECT resource_id FROM v_resources WHERE status = 'F')""")
def _(t):
    return joins.with_existing_parent(t.notes, t.resources, F.col("status") == "F")


@query("rel_anti_having", """
SELECT * FROM v_tasks WHERE status = 'pending' AND user_id NOT IN (
  SELECT user_id FROM v_tasks WHERE status = 'running' GROUP BY user_id HAVING count(*) >= 12)""")
def _(t):
    return joins.below_concurrency(t.tasks, 12)


@query("rel_eager_hierarchy", """
SELECT r.resource_id, r.title, r.subject_id, s.name AS subject_name, s.group_id, g.name AS group_name
FROM v_resources r LEFT JOIN v_subjects s USING (subject_id) LEFT JOIN v_groups g ON g.group_id = s.group_id""")
def _(t):
    return joins.resource_hierarchy(t.resources, t.subjects, t.groups)


@query("rel_scope_expand", """
SELECT 'resource:' || resource_id AS scope_id, resource_id, title FROM v_resources
UNION ALL SELECT 'subject:' || s.subject_id, r.resource_id, r.title FROM v_subjects s JOIN v_resources r USING (subject_id)
UNION ALL SELECT 'group:' || s.group_id, r.resource_id, r.title FROM v_subjects s JOIN v_resources r USING (subject_id)
   WHERE s.group_id IN (SELECT group_id FROM v_groups)
UNION ALL SELECT 'all:' || u.user_id, r.resource_id, r.title FROM v_users u JOIN v_resources r USING (user_id)""")
def _(t):
    def scope(df, kind, col):
        return df.select(F.concat(F.lit(kind + ":"), F.col(col).cast("string")).alias("scope_id"),
                         F.lit(kind).alias("scope_type"), F.col(col).alias("target"))
    scopes = (scope(t.resources, "resource", "resource_id").unionByName(scope(t.subjects, "subject", "subject_id"))
              .unionByName(scope(t.groups, "group", "group_id")).unionByName(scope(t.users, "all", "user_id")))
    return joins.expand_scopes(scopes, t.subjects, t.resources)


@query("rel_group_nested", """
SELECT g.group_id, g.name, 0 AS page, coalesce(string_agg(s.subject_id || '=' || s.name, ',' ORDER BY s.subject_id), '') AS items
FROM v_groups g LEFT JOIN v_subjects s USING (group_id) GROUP BY ALL""")
def _(t):
    nested = joins.nested_children(t.groups, t.subjects, "group_id", "subject_id", ["name"])
    text = F.transform("items", lambda x: F.concat(x["subject_id"].cast("string"), F.lit("="), x["name"]))
    return nested.select("group_id", "name", "page", F.array_join(text, ",").alias("items"))


@query("rel_group_with_ungrouped", """
WITH s AS (SELECT coalesce(CAST(group_id AS VARCHAR), 'ungrouped') AS group_id, subject_id, name FROM v_subjects),
g AS (SELECT CAST(group_id AS VARCHAR) AS group_id, name FROM v_groups
      UNION ALL SELECT DISTINCT 'ungrouped', 'Ungrouped Subjects' FROM s WHERE group_id = 'ungrouped')
SELECT g.group_id, g.name, f.subject_id, f.name AS subject_name, g.group_id = 'ungrouped' AS is_last
FROM g LEFT JOIN (SELECT * FROM s WHERE contains(lower(name), 'n_1')) f USING (group_id)
WHERE contains(lower(g.name), 'n_1') OR f.subject_id IS NOT NULL""")
def _(t):
    return joins.groups_with_ungrouped(t.groups, t.subjects, "N_1")


view("v_tiers", """
SELECT lower(p_brand) AS tier, max(CAST(p_size AS BIGINT)) AS max_resources FROM part GROUP BY 1
UNION ALL SELECT 'free', min(CAST(p_size AS BIGINT)) FROM part""")


def tiers_from_parts(t):
    size = F.col("p_size").cast("long")
    return (t.part.groupBy(F.lower("p_brand").alias("tier")).agg(F.max(size).alias("max_resources"))
            .unionByName(t.part.agg(F.min(size).alias("max_resources")).select(F.lit("free").alias("tier"), "max_resources")))


@query("rel_lookup_or_default", """
WITH u AS (SELECT user_id, 'brand#' || (user_id % 40) AS tier FROM v_users)
SELECT u.user_id, coalesce(t.tier, 'free') AS tier,
  CASE WHEN t.tier IS NULL THEN (SELECT max_resources FROM v_tiers WHERE tier = 'free') ELSE t.max_resources END AS max_resources
FROM u LEFT JOIN v_tiers t ON t.tier = u.tier""")
def _(t):
    users = t.users.select("user_id", F.concat(F.lit("brand#"), F.pmod("user_id", F.lit(40)).cast("string")).alias("tier"))
    return joins.lookup_or_default(users, tiers_from_parts(t))


@query("rel_invite_acceptor", """
WITH u AS (SELECT user_id, email, CASE WHEN user_id % 3 > 0 THEN full_name ELSE '' END AS full_name, nickname FROM v_users)
SELECT o_orderkey AS token, u.email AS accepted_by_email,
  CASE WHEN o_orderstatus <> 'O' THEN coalesce(nullif(u.full_name, ''), nullif(u.nickname, ''), 'N/A') END AS accepted_by_name
FROM orders LEFT JOIN u ON u.user_id = CASE WHEN o_orderstatus <> 'O' THEN o_custkey END""")
def _(t):
    invites = t.orders.select(F.col("o_orderkey").alias("token"),
                              F.when(F.col("o_orderstatus") != "O", F.col("o_custkey")).alias("accepted_by"))
    users = t.users.withColumn("full_name", F.when(F.pmod("user_id", F.lit(3)) > 0, F.col("full_name")).otherwise(""))
    return joins.invite_acceptors(invites, users)


@query("rel_json_membership", """
SELECT DISTINCT event_id AS note_id, unnest([CAST(json_extract_string(props, '$.k') AS BIGINT), user_id, user_id]) AS resource_id
FROM events""")
def _(t):
    k = F.get_json_object("props", "$.k")
    u = F.col("user_id").cast("string")
    notes = t.events.select(F.col("event_id").alias("note_id"),
                            F.concat(F.lit("["), F.concat_ws(", ", k, u, u), F.lit("]")).alias("ids"))
    return joins.json_members(notes, "note_id", "ids")


view("v_related", """
SELECT note_id AS id, 'note' AS kind, CASE WHEN is_pinned THEN NULL ELSE resource_id END AS resource_id,
       [resource_id, resource_id + 1] AS merged_ids, created_at FROM v_notes
UNION ALL SELECT 'ex_' || o_orderkey, 'exercise', CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END,
       [o_custkey, o_custkey], o_orderdate FROM orders""")


@query("rel_related_union", """
SELECT resource_id, kind, id, 'direct' AS relation, created_at FROM v_related WHERE resource_id IS NOT NULL
UNION ALL SELECT unnest(list_distinct(merged_ids)), kind, id, 'merged', created_at FROM v_related WHERE resource_id IS NULL""")
def _(t):
    rid = F.col("resource_id")
    notes = t.notes.select("note_id", F.when(~F.col("is_pinned"), rid).alias("resource_id"),
                           F.array(rid, rid + 1).alias("merged_ids"), "created_at")
    c = F.col("o_custkey")
    exercises = t.orders.select(F.concat(F.lit("ex_"), F.col("o_orderkey").cast("string")).alias("exercise_id"),
                                F.when(F.col("o_orderstatus") != "P", c).alias("resource_id"),
                                F.array(c, c).alias("merged_ids"), F.col("o_orderdate").alias("created_at"))
    return joins.related_content(notes, exercises)


view("v_cited", """
SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN ' ' || upper(p_name) || ' ' || p_type
   ELSE substr(p_name, 2, 4) END AS cited FROM part""")


@query("rel_substring_title_join", """
WITH c AS (SELECT DISTINCT trim(cited) AS cited FROM v_cited),
r AS (SELECT p_name AS title, min(p_partkey) AS ord, max(p_partkey) AS resource_id FROM part GROUP BY 1),
m AS (SELECT cited, resource_id, CASE WHEN cited = title THEN -1 ELSE ord END AS ord FROM c JOIN r ON
  cited = title OR contains(lower(cited), lower(title)) OR contains(lower(title), lower(cited)))
SELECT cited, arg_min(resource_id, ord) AS resource_id FROM m GROUP BY 1""")
def _(t):
    m = F.pmod("p_size", F.lit(3))
    cited = t.part.select(F.when(m == 0, F.col("p_name"))
                          .when(m == 1, F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "), F.col("p_type")))
                          .otherwise(F.substring("p_name", 2, 4)).alias("cited"))
    return ranking.title_matches(cited, t.part.select(F.col("p_name").alias("title"), F.col("p_partkey").alias("resource_id")))


@query("rel_self_parent", """
SELECT c.conversation_id, c.turn, p.turn AS parent_turn, p.text AS parent_message FROM v_turns c
LEFT JOIN v_turns p ON p.conversation_id = c.conversation_id AND p.turn = c.turn - 1""")
def _(t):
    parent = t.turns.select("conversation_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("parent_turn"),
                            F.col("text").alias("parent_message"))
    return (t.turns.select("conversation_id", "turn").join(parent, ["conversation_id", "turn"], "left"))


@query("rel_detail_assemble", """
SELECT d.doc_id AS resource_id, d.text, l.quality, l.toxic, p.url, b.text AS segment FROM documents d
LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id
LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("resource_id"), "text")
    return (d.join(t.labels.withColumnRenamed("doc_id", "resource_id"), "resource_id", "left")
            .join(t.pages.select(F.col("page_id").alias("resource_id"), "url"), "resource_id", "left")
            .join(t.benchmark.select(F.col("item_id").alias("resource_id"), F.col("text").alias("segment")), "resource_id", "left"))


# -- latest, top-k, paging, sets ----------------------------------------------------------------


@query("rel_latest_per_key", """
SELECT * FROM v_resources QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, resource_id DESC) = 1""")
def _(t):
    return latest(t.resources, ["user_id"], ["created_at", "resource_id"])


@query("rel_topk_recent", """
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, log_id) AS INTEGER) AS rank
FROM v_audit WHERE action = 'login' QUALIFY rank <= 5""")
def _(t):
    logins = t.audit_log.filter(F.col("action") == "login")
    return top_per_key(logins, ["user_id"], [F.col("created_at").desc(), F.col("log_id")], 5)


@query("rel_recent_attempts", """
WITH a AS (SELECT user_id, event_id AS question_id, CASE WHEN event_type <> 'view' THEN props END AS answer,
   event_type = 'purchase' AS graded, CASE WHEN event_type <> 'click' THEN date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) END AS answered FROM events)
SELECT user_id, question_id, answer, graded, coalesce(answered, 0) AS answer_time,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(answered, 0) DESC, question_id) AS INTEGER) AS rank
FROM a WHERE answer IS NOT NULL OR graded QUALIFY rank <= 5""")
def _(t):
    et = F.col("event_type")
    seconds = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    a = t.events.select("user_id", F.col("event_id").alias("question_id"), F.when(et != "view", F.col("props")).alias("answer"),
                        (et == "purchase").alias("graded"), F.when(et != "click", seconds).alias("answer_time"))
    return ranking.recent_attempts(a)


@query("rel_recent_feed", """
WITH a AS (
 SELECT user_id, 'resource' AS type, CAST(resource_id AS VARCHAR) AS id, title, created_at AS updated_at, subject_id FROM v_resources
 UNION ALL SELECT p_partkey % 1500, 'exercise', CAST(p_partkey AS VARCHAR), p_name,
    TIMESTAMP '1995-01-01' + CAST(p_size AS BIGINT) * INTERVAL 1 DAY, CAST(p_size AS BIGINT) FROM part
 UNION ALL SELECT r.user_id, 'note', n.note_id, r.title, n.created_at, r.subject_id FROM v_notes n JOIN v_resources r USING (resource_id)),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id, type ORDER BY updated_at DESC, id) <= 10),
c AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, type, id) AS INTEGER) AS rank FROM b QUALIFY rank <= 20)
SELECT c.user_id, c.type, c.id, c.title, c.updated_at, c.rank, s.name AS subject_name FROM c LEFT JOIN v_subjects s USING (subject_id)""")
def _(t):
    r = t.resources
    resources = r.select("user_id", F.col("resource_id").cast("string").alias("id"), "title",
                         F.col("created_at").alias("updated_at"), "subject_id")
    exercises = t.part.select(
        F.pmod("p_partkey", F.lit(1500)).alias("user_id"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"),
        F.expr("timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(p_size)").alias("updated_at"),
        F.col("p_size").cast("long").alias("subject_id"))
    notes = (t.notes.drop("user_id").join(r.select("resource_id", "user_id", "title", "subject_id"), "resource_id")
             .select("user_id", F.col("note_id").alias("id"), "title", F.col("created_at").alias("updated_at"), "subject_id"))
    return ranking.recent_feed(resources, exercises, notes, t.subjects)


@query("rel_page", "SELECT * FROM v_audit WHERE action = 'click' ORDER BY created_at DESC, log_id LIMIT 50 OFFSET 100")
def _(t):
    return (t.audit_log.filter(F.col("action") == "click").orderBy(F.col("created_at").desc(), "log_id")
            .offset(100).limit(50))


@query("rel_sort_modes", """
SELECT p_partkey AS id, p_name AS name, row_number() OVER (ORDER BY p_name DESC, p_partkey) AS position FROM part""")
def _(t):
    items = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return ranking.sorted_positions(items, "name_desc", "id")


@query("rel_pinned_first", """
SELECT resource_id, note_id, is_pinned, version,
  row_number() OVER (PARTITION BY resource_id ORDER BY is_pinned DESC, version DESC, note_id) AS position FROM v_notes""")
def _(t):
    return ranking.pinned_first(t.notes.select("resource_id", "note_id", "is_pinned", "version"), ["resource_id"], "note_id")


@query("rel_oldest_eligible", """
SELECT user_id, arg_min(task_id, (updated_at, task_id)) AS task_id FROM v_tasks WHERE status = 'pending' AND user_id NOT IN (
  SELECT user_id FROM v_tasks WHERE status = 'running' GROUP BY user_id HAVING count(*) >= 15) GROUP BY user_id""")
def _(t):
    return (joins.below_concurrency(t.tasks, 15).groupBy("user_id")
            .agg(F.min_by("task_id", F.struct("updated_at", "task_id")).alias("task_id")))


@query("rel_active_or_recent", """
SELECT task_id, status, coalesce(progress, 0) AS progress FROM v_tasks
WHERE (status IN ('pending', 'running') OR (status IN ('completed', 'failed')
   AND updated_at >= TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 5 MINUTE)) AND task_type <> 'chat'""")
def _(t):
    import datetime
    return (ranking.active_or_recent(t.tasks, datetime.datetime(2024, 1, 29, 12))
            .select("task_id", "status", F.coalesce("progress", F.lit(0)).alias("progress")))


@query("rel_conversation_thread", """
SELECT conversation_id, turn // 256 AS page, string_agg(turn || ':' || role || ':' || text, chr(10) ORDER BY turn) AS messages
FROM v_turns GROUP BY ALL""")
def _(t):
    text = F.transform("messages", lambda m: F.concat_ws(":", m["turn"].cast("string"), m["role"], m["text"]))
    return ranking.thread_pages(t.turns).select("conversation_id", "page", F.array_join(text, "\n").alias("messages"))


@query("rel_context_tail", """
WITH m AS (SELECT * FROM v_chat QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) <= 3),
n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS i FROM m)
SELECT conversation_id, 'Previous conversation context:' || chr(10) || string_agg(chr(10) || '[Message ' || i || ']' || chr(10) ||
  'Q: ' || message || chr(10) || 'A: ' || substr(coalesce(response, ''), 1, 300) || '...', chr(10) ORDER BY i) AS context
FROM n GROUP BY 1""")
def _(t):
    return ranking.context_tail(t.chat_messages)


@query("rel_pair_qa", """
SELECT u.conversation_id, u.turn, u.text AS question, a.text AS answer FROM v_turns u JOIN v_turns a
ON a.conversation_id = u.conversation_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def _(t):
    return ranking.pair_turns(t.turns)


view("v_words", r"""
SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS word FROM documents""")
view("v_bench_words", r"""
SELECT item_id AS doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS word FROM benchmark""")


def word_sets(df, id_col):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return df.select(F.col(id_col).alias("doc_id"), words.alias("words"))


@query("rel_set_intersection", """
SELECT b.doc_id, count(w.word) AS found, count(*) AS expected, round_even(count(w.word) / count(*), 6) AS recall
FROM v_bench_words b LEFT JOIN v_words w ON w.doc_id = b.doc_id AND w.word = b.word GROUP BY 1""")
def _(t):
    return ranking.overlap(word_sets(t.documents, "doc_id"), word_sets(t.benchmark, "item_id"), "doc_id", "words")


@query("rel_set_difference", """
SELECT doc_id, word, 'missing' AS side FROM (SELECT * FROM v_bench_words EXCEPT SELECT * FROM v_words)
UNION ALL SELECT doc_id, word, 'extra' FROM (SELECT * FROM v_words EXCEPT SELECT * FROM v_bench_words)""")
def _(t):
    return ranking.difference(word_sets(t.documents, "doc_id"), word_sets(t.benchmark, "item_id"), "doc_id", "words", "word")


@query("rel_distinct_first", r"""
SELECT doc_id, line, min(pos) AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM documents) GROUP BY 1, 2""")
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return ranking.distinct_first(lines, ["doc_id", "line"], "pos")
