"""Question, quality and training-pair queries bound to the supplied tables."""

from pyspark.sql import functions as F

from scholia.functions.text import lines, strip
from scholia.operators import quality as Q
from scholia.operators import questions as X
from scholia.plans.registry import query, view

STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x{{0b}}\x{{85}}]+|[\s\p{{Z}}\x{{0b}}\x{{85}}]+$', '', 'g')"


def st(x: str) -> str:
    return STRIP.format(x)


def exercises_text(t):
    """Every conversation turn pair as raw exercise text; odd ones without labels."""
    q, a = F.col("message"), F.coalesce("response", F.lit(""))
    labelled = F.concat(F.lit("# Question 1\n"), F.translate(q, "\n", " "), F.lit("\n## Jawapan / Answer 1: "), a)
    bare = F.concat(F.lit("Intro\n"), F.translate(q, "\n", " "), F.lit("?\n\nAnswer: "), a, F.lit("\n\nrest"))
    return t.chat_messages.select((F.col("conversation_id") * 100 + F.col("turn")).alias("doc_id"),
                                  F.when(F.pmod("conversation_id", F.lit(2)) == 0, labelled).otherwise(bare).alias("text"))


@query("qa_extract_pairs")
def _(t):
    return X.extract_pairs(exercises_text(t))


@query("qa_normalize_type", """
SELECT event_id AS id, CASE WHEN lower(t) IN ('objective', 'multiple_choice', 'multiple-choice', 'mcq') THEN 'objective'
  WHEN lower(t) IN ('fill_in_the_blank', 'fill-in-the-blank', 'blank') THEN 'fill_in_the_blank' ELSE 'subjective' END AS question_type
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'MCQ' WHEN 'view' THEN 'Blank' WHEN 'error' THEN 'multiple-choice' ELSE event_type END AS t FROM events)""")
def _(t):
    et = F.col("event_type")
    raw = F.when(et == "click", "MCQ").when(et == "view", "Blank").when(et == "error", "multiple-choice").otherwise(et)
    return t.events.select(F.col("event_id").alias("id"), X.normal_type(raw).alias("question_type"))


def question_json(t):
    """A question tree per part: sub-parts for even sizes, nested ones for multiples of four, marks left out at times."""
    p = F.col
    text = lambda c: F.col(c).cast("string")
    deep = F.concat(F.lit('{"question_text": "deep", "max_marks": '), text("p_size"), F.lit(', "sub_parts": [{"id": "z", "question_text": "deepest"}]}'))
    sub = F.concat(F.lit('[{"question_text": "'), p("p_brand"), F.lit('", "marking_scheme": [{"name": "clear", "marks": 2}], "sub_parts": ['),
                   F.when(F.pmod("p_size", F.lit(4)) == 0, deep).otherwise(""), F.lit(']}, {"label": "k", "max_marks": -3}]'))
    body = F.concat(F.lit('{"id": "q'), text("p_partkey"), F.lit('", "question_text": "'), p("p_name"), F.lit('"'),
                    F.when(F.pmod("p_size", F.lit(3)) == 0, F.concat(F.lit(', "max_marks": '), text("p_size"))).otherwise(""),
                    F.when(F.pmod("p_size", F.lit(5)) == 0, F.lit(', "question_type": "objective"')).otherwise(""),
                    F.when(F.pmod("p_size", F.lit(2)) == 0, F.concat(F.lit(', "sub_parts": '), sub)).otherwise(""), F.lit("}"))
    return t.part.select(p("p_brand").alias("set_id"), p("p_partkey").cast("int").alias("q_no"), body.alias("question_json"))


@query("qa_normalize_structure")
def _(t):
    return X.normalize_structure(question_json(t)).select("set_id", F.to_json("question").alias("question"))


@query("qa_defaults")
def _(t):
    return X.fill_defaults(question_json(t)).select("set_id", F.to_json("question").alias("question"))


@query("qa_flatten_parts", """
WITH p AS (SELECT p_brand AS set_id, printf('%06d', p_partkey) AS q, p_partkey, p_name, p_size, p_brand FROM part)
SELECT set_id, q AS path, 0 AS depth, 'q' || p_partkey AS id, p_name AS question_text, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS BIGINT) END AS max_marks FROM p
UNION ALL SELECT set_id, q || '.000000', 1, NULL, p_brand, NULL FROM p WHERE p_size % 2 = 0
UNION ALL SELECT set_id, q || '.000001', 1, NULL, NULL, -3 FROM p WHERE p_size % 2 = 0
UNION ALL SELECT set_id, q || '.000000.000000', 2, NULL, 'deep', CAST(p_size AS BIGINT) FROM p WHERE p_size % 4 = 0
UNION ALL SELECT set_id, q || '.000000.000000.000000', 3, 'z', 'deepest', NULL FROM p WHERE p_size % 4 = 0""")
def _(t):
    return X.flatten_parts(question_json(t))


@query("qa_merge_sets", """
SELECT o_custkey AS new_set_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY o_custkey
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS "order" FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def _(t):
    q = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("new_set_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return X.merge_sets(q, [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]).drop("l_extendedprice")


view("v_answers", """
SELECT conversation_id || '-' || turn AS answer_id, coalesce(response, '') AS answer_text, CAST(turn % 5 AS BIGINT) AS max_marks,
  CASE turn % 4 WHEN 0 THEN ' ' || coalesce(response, '') || ' ' WHEN 2 THEN message ELSE coalesce(response, '') || ' ' || message END AS user_answer FROM v_chat""")


def answers(t):
    r = F.coalesce("response", F.lit(""))
    m = F.pmod("turn", F.lit(4))
    user = F.when(m == 0, F.concat(F.lit(" "), r, F.lit(" "))).when(m == 2, F.col("message")).otherwise(F.concat(r, F.lit(" "), F.col("message")))
    return t.chat_messages.select(F.concat_ws("-", "conversation_id", "turn").alias("answer_id"), r.alias("answer_text"),
                                  F.pmod("turn", F.lit(5)).alias("max_marks"), user.alias("user_answer"))


@query("qa_grade_objective", f"""
SELECT answer_id, CASE WHEN lower({st('user_answer')}) = lower({st('answer_text')}) THEN CASE max_marks WHEN 0 THEN 1 ELSE max_marks END ELSE 0 END AS awarded,
  CASE max_marks WHEN 0 THEN 1 ELSE max_marks END AS total FROM v_answers""")
def _(t):
    return X.grade_objective(answers(t))


@query("qa_grade_keywords", rf"""
WITH a AS (SELECT answer_id, max_marks AS m, lower({st('user_answer')}) AS u, list_filter(regexp_split_to_array(lower(answer_text), '[\s\p{{Z}}]+'), lambda w: w <> '') AS ws FROM v_answers),
k AS (SELECT *, CASE WHEN len(list_filter(ws, lambda w: length(w) > 3)) > 0 THEN list_filter(ws, lambda w: length(w) > 3) ELSE ws END AS k FROM a),
g AS (SELECT *, len(list_filter(k, lambda w: contains(u, w))) AS matched FROM k), s AS (SELECT *, CAST(round_even(m * (matched / greatest(len(k), 1)), 0) AS BIGINT) AS s FROM g)
SELECT answer_id, CASE WHEN u = '' THEN 0 ELSE least(CASE WHEN s = 0 AND length(u) > 5 THEN CAST(round_even(m * 0.25, 0) AS BIGINT) ELSE s END, m) END AS awarded, m AS total,
  CAST(CASE WHEN u = '' THEN 0 ELSE matched END AS INTEGER) AS matched, CAST(len(k) AS INTEGER) AS key_terms FROM s""")
def _(t):
    return X.grade_keywords(answers(t))


@query("qa_difficulty_mix", """
SELECT p_brand AS set_id, p_type AS type, CASE WHEN p_size < 15 THEN 'easy' WHEN p_size < 35 THEN 'medium' ELSE 'hard' END AS difficulty, count(*) AS n FROM part GROUP BY ALL""")
def _(t):
    size = F.col("p_size")
    level = F.when(size < 15, "easy").when(size < 35, "medium").otherwise("hard")
    return X.difficulty_mix(t.part.select(F.col("p_brand").alias("set_id"), F.col("p_type").alias("type"), level.alias("difficulty")))


# -- quality ---------------------------------------------------------------------------------------

view("v_counts", r"""
SELECT doc_id, count(*) AS total_lines, count(*) FILTER (s <> '') AS non_empty_lines, count(*) FILTER (starts_with(line, '#')) AS headings,
  count(*) FILTER (starts_with(line, '# ')) AS h1, count(*) FILTER (starts_with(line, '## ')) AS h2, count(*) FILTER (starts_with(line, '### ')) AS h3,
  count(*) FILTER (starts_with(s, '- ')) AS list_items, count(*) FILTER (regexp_matches(s, '^\d+[.)]\s')) AS ordered_items,
  count(*) FILTER (s <> '' AND NOT starts_with(line, '#') AND NOT starts_with(s, '- ') AND NOT regexp_matches(s, '^\d+[.)]\s') AND NOT starts_with(s, '|') AND NOT starts_with(s, '```')) AS body_lines,
  count(*) FILTER (starts_with(s, '|')) AS table_rows, count(*) FILTER (starts_with(s, '```')) // 2 AS code_blocks FROM v_md_lines GROUP BY 1""")
INTS = "total_lines non_empty_lines headings h1 h2 h3 list_items ordered_items body_lines table_rows code_blocks".split()


@query("ql_doc_metrics", f"""
SELECT c.doc_id, {', '.join(f'CAST(c.{c} AS INTEGER) AS {c}' for c in INTS)}, CAST(len(regexp_extract_all(m.text, '!\\[(.*?)\\]\\((.+?)\\)')) AS INTEGER) AS images
FROM v_counts c JOIN v_md m USING (doc_id)""")
def _(t):
    return Q.doc_metrics(t.markdown)


@query("ql_code_blocks", "SELECT doc_id, CAST(code_blocks AS INTEGER) AS code_blocks FROM v_counts")
def _(t):
    return t.markdown.select("doc_id", Q.code_blocks("text").alias("code_blocks"))


@query("ql_content_preservation", """
WITH a AS (SELECT d.doc_id, c.non_empty_lines AS a, len(list_filter(string_split(d.text, '.'), lambda x: trim(replace(x, chr(10), ' ')) <> '')) AS e FROM documents d JOIN v_counts c USING (doc_id)),
r AS (SELECT doc_id, a / greatest(e, 1) AS r FROM a)
SELECT doc_id, round_even(CASE WHEN r > 1 THEN 1 / r ELSE r END, 4) AS content_preservation FROM r""")
def _(t):
    expected = t.documents.select("doc_id", F.array_join(F.transform(F.split("text", r"\."), lambda x: F.translate(x, "\n", " ")), "\n").alias("expected"))
    both = t.markdown.join(expected, "doc_id")
    return both.select("doc_id", Q.preservation(Q.filled("text"), Q.filled("expected")).alias("content_preservation"))


view("v_links", r"""
WITH l AS (SELECT doc_id, pos, line, substr(line, 1, 3) || '.png' AS n FROM v_doc_lines)
SELECT m.doc_id, list_distinct(regexp_extract_all(m.text, '!\[(.*?)\]\((.+?)\)', 2)) AS f, coalesce(e.e, []) AS e FROM v_md m
LEFT JOIN (SELECT doc_id, list_distinct(list(n)) AS e FROM l WHERE pos % 14 IN (1, 12) OR pos % 28 = 26 GROUP BY 1) e USING (doc_id)""")


def expected_links(t):
    at = lambda i: F.pmod(i, F.lit(14)).isin(1, 12) | (F.pmod(i, F.lit(28)) == 26)
    names = F.array_compact(F.transform(lines("text"), lambda x, i: F.when(at(i), F.concat(F.substring(x, 1, 3), F.lit(".png")))))
    return t.documents.select("doc_id", names.alias("expected"))


@query("ql_image_recall_noise", """
SELECT doc_id, CASE WHEN len(e) = 0 THEN 1.0 ELSE len(list_intersect(f, e)) / greatest(len(e), 1) END AS image_recall,
  CASE WHEN len(e) = 0 THEN 0.0 ELSE (len(f) - len(list_intersect(f, e))) / greatest(len(f), 1) END AS image_noise FROM v_links""")
def _(t):
    recall, noise = Q.image_scores(Q.image_links(F.col("text")), F.col("expected"))
    return t.markdown.join(expected_links(t), "doc_id").select("doc_id", recall.alias("image_recall"), noise.alias("image_noise"))


view("v_validity", r"""
WITH h AS (SELECT doc_id, pos, length(split_part(line, ' ', 1)) AS lv, starts_with(line, '# ') AS one FROM v_md_lines WHERE starts_with(line, '#')),
j AS (SELECT *, lag(lv) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM h),
a AS (SELECT doc_id, count(*) FILTER (one) AS h1, count(*) FILTER (lv > p + 1) AS jumps,
  string_agg('hierarchy_jump_' || p || '_to_' || lv, ',' ORDER BY pos) FILTER (lv > p + 1) AS codes FROM j GROUP BY 1)
SELECT d.doc_id, round_even(greatest(0.0::DOUBLE, 1.0::DOUBLE - CASE WHEN coalesce(h1, 0) = 0 THEN 0.2 ELSE 0 END - CASE WHEN h1 > 1 THEN 0.15 ELSE 0 END - coalesce(jumps, 0) * 0.1), 6) AS score,
  concat_ws(',', CASE WHEN coalesce(h1, 0) = 0 THEN 'missing_h1' END, CASE WHEN h1 > 1 THEN 'multiple_h1' END, codes) AS issues FROM documents d LEFT JOIN a USING (doc_id)""")


@query("ql_structural_validity", "SELECT doc_id, score, issues FROM v_validity")
def _(t):
    return Q.structural_validity(t.markdown).withColumn("issues", F.array_join("issues", ","))


@query("ql_overall_score", """
WITH x AS (SELECT v.doc_id, c.non_empty_lines / greatest(c.total_lines, 1) AS cp, v.score AS sv, CASE WHEN len(e) = 0 THEN 1.0 ELSE len(list_intersect(f, e)) / greatest(len(e), 1) END AS ir,
  CASE WHEN len(e) = 0 THEN 0.0 ELSE (len(f) - len(list_intersect(f, e))) / greatest(len(f), 1) END AS im, c.headings AS h FROM v_validity v JOIN v_counts c USING (doc_id) JOIN v_links USING (doc_id))
SELECT doc_id, round_even(least((cp * 0.25 + sv * 0.25 + 0.15 + ir * 0.15 + (1.0 - im) * 0.10) * CASE WHEN h > 0 THEN 1.0 ELSE 0.8 END / 0.9, 1.0), 4) AS overall_score FROM x""")
def _(t):
    md = t.markdown
    recall, noise = Q.image_scores(Q.image_links(F.col("text")), F.col("expected"))
    parts = (md.join(expected_links(t), "doc_id").select("doc_id", recall.alias("recall"), noise.alias("noise"))
             .join(Q.structural_validity(md).select("doc_id", F.col("score").alias("validity")), "doc_id").join(Q.doc_metrics(md), "doc_id"))
    preserved = F.col("non_empty_lines") / F.greatest("total_lines", F.lit(1))
    return parts.select("doc_id", Q.overall_score(preserved, F.col("validity"), F.lit(1.0), F.col("recall"), F.col("noise"), F.col("headings")).alias("overall_score"))


@query("ql_ocr_confidence", """
SELECT doc_id, round_even(coalesce(avg(((pos * 7) % 10) / 10.0::DOUBLE) FILTER (pos % 3 = 1), 1.0), 6) AS ocr_confidence FROM v_doc_lines GROUP BY 1""")
def _(t):
    def shape(x, i):
        conf = (F.pmod(i * 7, F.lit(10)) / 10.0).cast("string")
        return F.when(F.pmod(i, F.lit(3)) == 1, F.concat(x, F.lit(" <!-- ocr-conf: "), conf, F.lit(" -->"))).otherwise(x)
    return t._marked(shape).select("doc_id", F.bround(Q.ocr_confidence("text"), 6).alias("ocr_confidence"))


@query("ql_heading_diff", r"""
WITH h AS (SELECT doc_id, pos, length(regexp_extract(line, '^(#{1,6})\s+(.+)$', 1)) AS level, trim(regexp_extract(line, '^(#{1,6})\s+(.+)$', 2)) AS text FROM v_md_lines WHERE regexp_matches(line, '^#{1,6}\s+.+$')),
e AS (SELECT doc_id, CASE level WHEN 2 THEN 3 ELSE level END AS level, text FROM h), a AS (SELECT DISTINCT doc_id, level, text FROM h), x AS (SELECT DISTINCT doc_id, level, text FROM e),
p AS (SELECT h.doc_id, h.pos, any_value(h.level) AS level, any_value(h.text) AS text, arg_max(q.level, q.pos) AS parent FROM h LEFT JOIN h q ON q.doc_id = h.doc_id AND q.pos < h.pos AND q.level < h.level GROUP BY 1, 2)
SELECT doc_id, 'missing_heading' AS diff_type, CAST(level AS INTEGER) AS level, text FROM (SELECT * FROM x EXCEPT SELECT * FROM a)
UNION ALL SELECT doc_id, 'extra_heading', CAST(level AS INTEGER), text FROM (SELECT * FROM a EXCEPT SELECT * FROM x)
UNION ALL SELECT doc_id, 'hierarchy_jump', CAST(level AS INTEGER), text FROM p WHERE level > CASE WHEN coalesce(parent, 1) = 1 THEN 1 ELSE parent + 1 END + 1""")
def _(t):
    changed = t.markdown.select("doc_id", F.regexp_replace("text", r"(?m)^## ", "### ").alias("text"))
    return Q.heading_diff(t.markdown, changed)


@query("ql_list_runs", r"""
WITH l AS (SELECT *, starts_with(s, '- ') OR regexp_matches(s, '^\d+[.)]\s') AS i FROM v_md_lines),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM l WHERE i),
r AS (SELECT doc_id, min(pos) AS start, max(pos) AS "end", CASE WHEN starts_with(arg_min(s, pos), '- ') THEN 'unordered' ELSE 'ordered' END AS type, CAST(count(*) AS INTEGER) AS length FROM g GROUP BY doc_id, g)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS run, start, "end", type, length FROM r""")
def _(t):
    return Q.list_runs(t.markdown)


@query("ql_similarity")
def _(t):
    return Q.similarity(Q.leader_pairs(t.documents), t.documents)


# -- training --------------------------------------------------------------------------------------


@query("trn_pairs", f"""
WITH p AS (SELECT u.conversation_id || '-' || u.turn AS id, {st('u.text')} AS r, {st('a.text')} AS p FROM v_turns u JOIN v_turns a ON a.conversation_id = u.conversation_id
  AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')
SELECT id, 'system=Format;user=' || r || ';assistant=' || p AS messages FROM p WHERE r <> '' AND p <> ''""")
def _(t):
    key = F.concat_ws("-", "conversation_id", "turn").alias("id")
    raw = t.turns.filter("role = 'user'").select(key, "text")
    polished = t.turns.filter("role = 'assistant'").withColumn("turn", F.col("turn") - 1).select(key, "text")
    shown = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), ";")
    return Q.training_pairs(raw, polished, "Format").select("id", shown.alias("messages"))


@query("trn_split", """
SELECT doc_id AS id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || 'seed'), doc_id) <= floor((SELECT count(*) FROM documents) * 0.9::DOUBLE) THEN 'train' ELSE 'valid' END AS split FROM documents""")
def _(t):
    return Q.split_pairs(t.documents.select(F.col("doc_id").alias("id")), "seed")


@query("trn_pending", "SELECT doc_id AS resource_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY 1 LIMIT 200")
def _(t):
    return Q.pending(t.documents.select(F.col("doc_id").alias("resource_id")), t.labels.select(F.col("doc_id").alias("resource_id")))


@query("trn_rating_stats", """
WITH m AS (SELECT d.lang AS model, d.source AS mode, l.quality * 5 + l.toxic AS rating, CASE WHEN l.toxic = 1 THEN 'bad' END AS c FROM labels l JOIN documents d USING (doc_id))
SELECT model, mode, count(*) AS n, sum(rating) / count(*) AS avg_rating, count(c) AS comments FROM m WHERE rating BETWEEN 0 AND 5 GROUP BY 1, 2""")
def _(t):
    m = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id").select(
        F.col("lang").alias("model"), F.col("source").alias("mode"), (F.col("quality") * 5 + F.col("toxic")).alias("rating"),
        F.when(F.col("toxic") == 1, "bad").alias("comment"))
    return Q.rating_stats(m)
