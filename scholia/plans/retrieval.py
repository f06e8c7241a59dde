"""Chunking, embedding and search queries bound to documents, embeddings and benchmark passages."""

from pyspark.sql import functions as F

from scholia.functions import vectors as V
from scholia.functions.ordered import add_rank, top_per_key
from scholia.operators import chunking, cleaning, retrieval
from scholia.plans.registry import query, view

W = r"list_filter(regexp_split_to_array(text, '[\s\p{Z}\x{0b}\x{85}]+'), lambda w: w <> '')"

view("v_word_lists", f"SELECT doc_id, source, {W} AS w FROM documents")


@query("vec_chunk_words", """
WITH s AS (SELECT doc_id, w, unnest(range(0, len(w), 450)) AS i FROM v_word_lists)
SELECT doc_id, CAST(i / 450 AS INTEGER) AS chunk_index, array_to_string(w[i + 1 : i + 500], ' ') AS text FROM s""")
def _(t):
    return t.documents.select("doc_id", F.posexplode(chunking.chunk_words("text")).alias("chunk_index", "text"))


view("v_char_chunks", """
WITH f AS (SELECT doc_id, w, list_reduce(list_transform(w, lambda x: {'s': length(x) + 1, 'c': []::BIGINT[]}), lambda a, x, i:
    CASE WHEN a.s + x.s >= 500 THEN {'s': 0::BIGINT, 'c': list_append(a.c, i)} ELSE {'s': a.s + x.s, 'c': a.c} END, {'s': 0::BIGINT, 'c': [0]::BIGINT[]}).c AS c
  FROM v_word_lists WHERE len(w) > 0),
g AS (SELECT doc_id, w, list_filter(c, lambda x: x < len(w)) AS c FROM f),
h AS (SELECT doc_id, w, c, unnest(range(0, len(c))) AS k FROM g),
t AS (SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, array_to_string(w[c[k + 1] + 1 : coalesce(c[k + 2], len(w))], ' ') AS text FROM h)
SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS position FROM t""")


@query("vec_chunk_chars", "SELECT doc_id, chunk_index, text, position FROM v_char_chunks")
def _(t):
    return chunking.chunk_chars(t.documents)


@query("vec_chunk_headings", r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM v_md),
f AS (SELECT doc_id, ls, list_reduce(list_transform(ls, lambda x: {'s': length(x) + 1, 'h': regexp_matches(x, '^#{1,3}\s'), 'c': []::BIGINT[]}), lambda a, x, i:
    CASE WHEN a.s + x.s >= 800 AND x.h AND i - 1 > a.c[-1] THEN {'s': x.s, 'h': x.h, 'c': list_append(a.c, i - 1)} ELSE {'s': a.s + x.s, 'h': x.h, 'c': a.c} END,
    {'s': 0::BIGINT, 'h': false, 'c': [0]::BIGINT[]}).c AS c FROM l),
h AS (SELECT doc_id, ls, c, unnest(range(0, len(c))) AS k FROM f)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, array_to_string(ls[c[k + 1] + 1 : coalesce(c[k + 2], len(ls))], chr(10)) AS text FROM h""")
def _(t):
    return chunking.chunk_headings(t.markdown)


@query("vec_chunk_breaks", r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM v_md),
f AS (SELECT doc_id, ls, list_reduce(list_transform(ls, lambda x: {'s': length(x) + 1, 'h': regexp_matches(x, '^#{1,4}\s|^\s*$'), 'c': []::BIGINT[]}), lambda a, x, i:
    CASE WHEN a.s + x.s >= 4000 AND x.h THEN {'s': 0::BIGINT, 'h': x.h, 'c': list_append(a.c, i)} ELSE {'s': a.s + x.s, 'h': x.h, 'c': a.c} END,
    {'s': 0::BIGINT, 'h': false, 'c': [0]::BIGINT[]}).c AS c FROM l),
h AS (SELECT doc_id, ls, list_filter(c, lambda x: x < len(ls)) AS c FROM f), u AS (SELECT doc_id, ls, c, unnest(range(0, len(c))) AS k FROM h),
t AS (SELECT doc_id, k, regexp_replace(array_to_string(ls[c[k + 1] + 1 : coalesce(c[k + 2], len(ls))], chr(10)), '^\s+|\s+$', '', 'g') AS text FROM u)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, text FROM t WHERE text <> ''""")
def _(t):
    return chunking.chunk_breaks(t.markdown)


@query("vec_sections", r"""
WITH l AS (SELECT *, regexp_matches(line, '^#{1,2}\s+') AS h FROM v_md_lines),
g AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l),
s AS (SELECT doc_id, k, coalesce(any_value(line) FILTER (h), '') AS header,
  regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT h), ''), '^\s+|\s+$', '', 'g') AS content FROM g GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS section, header, content FROM s WHERE trim(header) <> '' OR content <> ''""")
def _(t):
    return chunking.sections(t.markdown)


@query("vec_strip_images", r"SELECT doc_id, regexp_replace(text, '!\[.*?\]\(.*?\)', '', 'g') AS text FROM v_md")
def _(t):
    return t.markdown.select("doc_id", cleaning.strip_images("text").alias("text"))


def vectors(source: str) -> str:
    """SQL of the default encoder over (id, text) rows: signed digests of words, unit length, single precision."""
    return rf"""
SELECT i.id, list(coalesce(CAST(CAST(s.x / n.n AS FLOAT) AS DOUBLE), 0.0::DOUBLE) ORDER BY d.d) AS v FROM (SELECT DISTINCT id FROM {source}) i
CROSS JOIN (SELECT unnest(range(64)) AS d) d
LEFT JOIN (SELECT id, m, sum(g)::DOUBLE AS x FROM (SELECT id, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % 64 AS m, 1 - 2 * (CAST('0x' || substr(h, 9, 2) AS UBIGINT) % 2)::INT AS g
   FROM (SELECT id, md5(unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS h FROM {source})) GROUP BY 1, 2) s ON s.id = i.id AND s.m = d.d
LEFT JOIN (SELECT id, sqrt(sum(x * x)) AS n FROM (SELECT id, m, sum(g)::DOUBLE AS x FROM (SELECT id, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % 64 AS m,
   1 - 2 * (CAST('0x' || substr(h, 9, 2) AS UBIGINT) % 2)::INT AS g FROM (SELECT id, md5(unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS h FROM {source})) GROUP BY 1, 2)
   GROUP BY 1) n ON n.id = i.id AND n.n > 0 GROUP BY 1""".replace("\\\\", "\\")


COS = ("CASE WHEN list_dot_product({0}, {0}) > 0 AND list_dot_product({1}, {1}) > 0 THEN "
       "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))) ELSE 0 END")
view("v_doc_texts", "SELECT doc_id AS id, text FROM documents")
view("v_doc_vec", vectors("v_doc_texts"))


@query("vec_embed_batch", """
SELECT id AS doc_id, CAST(d AS INTEGER) AS dim, round_even(v[d + 1], 5) AS value FROM (SELECT id, v, unnest(range(64)) AS d FROM v_doc_vec) WHERE v[d + 1] <> 0""")
def _(t):
    vecs = V.embed(t.documents.select("doc_id", "text"), "text").select("doc_id", F.posexplode("embedding").alias("dim", "x"))
    return vecs.filter("x <> 0").select("doc_id", "dim", F.bround(F.col("x").cast("double"), 5).alias("value"))


view("v_pairs", """
WITH z AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: 0.0) ELSE embedding END::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_dot_product(a.v, b.v) AS d, sqrt(list_dot_product(a.v, a.v)) AS na, sqrt(list_dot_product(b.v, b.v)) AS nb
FROM z a JOIN z b ON b.vec_id = a.vec_id + 1""")


def pairs(t):
    v = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding"))
    a = t.embeddings.select(F.col("vec_id").alias("id_a"), v.alias("a"))
    b = t.embeddings.select(F.col("vec_id").alias("id_b"), v.alias("b"), (F.col("vec_id") - 1).alias("id_a"))
    return a.join(b, "id_a")


@query("vec_cosine_zero", "SELECT id_a, id_b, round_even(CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE d / (na * nb) END, 6) AS score FROM v_pairs")
def _(t):
    return pairs(t).select("id_a", "id_b", F.bround(V.cosine_zero(F.col("a"), F.col("b")), 6).alias("score"))


@query("vec_cosine_raw", "SELECT id_a, id_b, round_even(CASE WHEN na = 0 OR nb = 0 THEN NULL ELSE d / (na * nb) END, 6) AS score FROM v_pairs")
def _(t):
    return pairs(t).select("id_a", "id_b", F.bround(V.cosine_raw(F.col("a"), F.col("b")), 6).alias("score"))


@query("vec_cosine_eps", "SELECT id_a, id_b, round_even(d / (na * nb + 1e-9) * 100, 1) AS score FROM v_pairs")
def _(t):
    return pairs(t).select("id_a", "id_b", V.cosine_percent(F.col("a"), F.col("b")).alias("score"))


def chunks(t):
    return t.embeddings.select(F.col("label").cast("long").alias("resource_id"), F.col("vec_id").alias("chunk_index"), "embedding")


def first_vector(t):
    return t.embeddings.filter("vec_id = 0").select("embedding")


view("v_chunks", "SELECT CAST(label AS BIGINT) AS resource_id, vec_id AS chunk_index, embedding::DOUBLE[] AS v FROM embeddings")
view("v_scored", """
SELECT c.resource_id, c.chunk_index, round_even(list_dot_product(c.v, q.v) / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(q.v, q.v)) + 1e-9) * 100, 1) AS score
FROM v_chunks c, (SELECT v FROM v_chunks WHERE chunk_index = 0) q""")
view("v_near", """
SELECT q.chunk_index AS query_id, c.resource_id, c.chunk_index,
  round_even(list_dot_product(c.v, q.v) / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(q.v, q.v)) + 1e-9) * 100, 1) AS score FROM v_chunks c, v_chunks q""")
view("v_best", """
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resource_id, chunk_index) AS INTEGER) AS rank FROM v_near QUALIFY rank <= 5""")


@query("vec_topk", """
SELECT resource_id, chunk_index, score, CAST(row_number() OVER (ORDER BY score DESC, resource_id, chunk_index) AS INTEGER) AS rank
FROM v_scored WHERE resource_id IN (SELECT n_nationkey FROM nation) QUALIFY rank <= 10""")
def _(t):
    scope = t.subjects.select(F.col("subject_id").alias("resource_id"))
    return V.topk_one(chunks(t).join(scope, "resource_id", "left_semi"), first_vector(t), ["resource_id", "chunk_index"], 10)


def near(t, k=5):
    q = chunks(t).select(F.col("chunk_index").alias("query_id"), "embedding")
    return V.topk_blocks(q, chunks(t), k, ["resource_id", "chunk_index"])


@query("vec_topk_batch", "SELECT * FROM v_best")
def _(t):
    return near(t)


@query("vec_find_similar", """
SELECT vec_id, label FROM embeddings JOIN (SELECT * FROM v_scored ORDER BY score DESC, resource_id, chunk_index LIMIT 5) ON chunk_index = vec_id""")
def _(t):
    return (V.topk_one(chunks(t), first_vector(t), ["resource_id", "chunk_index"], 5)
            .select(F.col("chunk_index").alias("vec_id"), F.col("resource_id").cast("int").alias("label")))


view("v_wide_chunks", """
SELECT doc_id, i / 450 AS chunk_index, array_to_string(w[i + 1 : i + 500], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, len(w), 450)) AS i FROM v_word_lists)""")
view("v_chunk_texts", "SELECT doc_id || '-' || CAST(chunk_index AS BIGINT) AS id, text FROM v_wide_chunks")
view("v_chunk_vec", vectors("v_chunk_texts"))
view("v_query_texts", "SELECT item_id AS id, text FROM benchmark")
view("v_query_vec", vectors("v_query_texts"))


@query("vec_search_text", f"""
WITH c AS (SELECT w.doc_id, CAST(w.chunk_index AS INTEGER) AS k, md5(w.text) AS digest, v FROM v_wide_chunks w JOIN v_chunk_vec x ON x.id = w.doc_id || '-' || CAST(w.chunk_index AS BIGINT)),
f AS (SELECT digest, min(doc_id) AS resource_id FROM c GROUP BY 1),
s AS (SELECT q.id AS query_id, c.*, round_even(coalesce({COS.format('q.v', 'c.v')}, 0), 9) AS score FROM v_query_vec q, c),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, k, digest) AS INTEGER) AS rank FROM s QUALIFY rank <= 5)
SELECT query_id, f.resource_id, digest, score, rank FROM r JOIN f USING (digest)""")
def _(t):
    return retrieval.search_texts(t.documents, t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


view("v_head_texts", "SELECT doc_id AS id, array_to_string(w[1:500], ' ') AS text FROM v_word_lists WHERE len(w) > 0")
view("v_head_vec", vectors("v_head_texts"))
view("v_start_texts", "SELECT doc_id AS id, substr(text, 1, 1000) AS text FROM documents")
view("v_start_vec", vectors("v_start_texts"))


@query("vec_similar_docs", f"""
WITH d AS (SELECT doc_id, source FROM documents), p AS (SELECT a.doc_id, b.doc_id AS similar_id FROM d a JOIN d b ON a.source = b.source AND a.doc_id <> b.doc_id),
s AS (SELECT p.*, round_even(coalesce({COS.format('q.v', 'c.v')}, 0), 9) AS score FROM p JOIN v_head_vec q ON q.id = p.doc_id JOIN v_start_vec c ON c.id = p.similar_id
   JOIN v_head_vec n ON n.id = p.similar_id)
SELECT doc_id, similar_id, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, similar_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def _(t):
    return retrieval.similar_documents(t.documents.select("doc_id", F.col("source").alias("owner"), "text"))


view("v_snip_texts", "SELECT doc_id || '-' || chunk_index AS id, text FROM v_char_chunks")
view("v_snip_vec", vectors("v_snip_texts"))
@query("vec_embed_corpus", """
SELECT c.doc_id AS resource_id, c.chunk_index, c.text, c.position, CAST(x.d AS INTEGER) AS dim, round_even(x.value, 5) AS value
FROM v_char_chunks c LEFT JOIN (SELECT * FROM (SELECT id, unnest(range(64)) AS d, unnest(v) AS value FROM v_snip_vec) WHERE value <> 0) x ON x.id = c.doc_id || '-' || c.chunk_index""")
def _(t):
    chunks = retrieval.embed_corpus(t.documents)
    parts = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("dim"), F.bround(x.cast("double"), 5).alias("value"))), lambda p: p["value"] != 0)
    return chunks.select("resource_id", "chunk_index", "text", "position", F.explode_outer(parts).alias("p")).select("resource_id", "chunk_index", "text", "position", "p.dim", "p.value")


view("v_ask_texts", "SELECT 0 AS id, 'the retention of entire nations' AS text")
view("v_ask_vec", vectors("v_ask_texts"))


@query("vec_snippets", """
WITH s AS (SELECT c.doc_id, c.chunk_index, c.text, c.position, round_even(list_dot_product(q.v, x.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(x.v, x.v)) + 1e-9) * 100, 1) AS score
  FROM v_char_chunks c JOIN v_snip_vec x ON x.id = c.doc_id || '-' || c.chunk_index, v_ask_vec q)
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_index) AS INTEGER) AS rank FROM s QUALIFY rank <= 3""")
def _(t):
    return retrieval.snippets(t.documents, "the retention of entire nations")


@query("vec_min_score", """
SELECT query_id, resource_id, chunk_index, score, rank, score >= 30 AS is_shown FROM v_best WHERE score >= 15""")
def _(t):
    return near(t).filter(F.col("score") >= 15).withColumn("is_shown", F.col("score") >= 30)


view("v_hits", """
SELECT source AS query_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS INTEGER) AS rank, text FROM documents
""")


def ranked_texts(t):
    d = t.documents.select(F.col("source").alias("query_id"), "n_chars", "doc_id", "text")
    return add_rank(d, ["query_id"], [F.col("n_chars"), F.col("doc_id")], "rank")


@query("vec_pack_snippets", """
WITH f AS (SELECT query_id, min(rank) FILTER (text <> '') AS f FROM v_hits GROUP BY 1),
r AS (SELECT h.query_id, h.rank, h.text, sum(length(h.text)) OVER (PARTITION BY h.query_id ORDER BY h.rank) + 2 * greatest(h.rank - f.f, 1) AS n
  FROM v_hits h JOIN f USING (query_id) WHERE h.rank >= f.f)
SELECT f.query_id, coalesce(string_agg(r.text, chr(10) || chr(10) ORDER BY r.rank), '') AS context FROM f LEFT JOIN r ON r.query_id = f.query_id AND r.n <= 2000 GROUP BY 1""")
def _(t):
    return retrieval.pack_snippets(ranked_texts(t))


@query("vec_pack_context", """
WITH r AS (SELECT *, '[Source ' || rank || ']: ' AS label FROM v_hits),
b AS (SELECT *, coalesce(sum(length(label) + length(text) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r)
SELECT query_id, string_agg(label || text || chr(10) || chr(10), '' ORDER BY rank) AS context, string_agg(substr(text, 1, 150), '|' ORDER BY rank) AS sources
FROM b WHERE b + length(text) <= 3000 GROUP BY 1""")
def _(t):
    return retrieval.pack_context(ranked_texts(t)).withColumn("sources", F.array_join("sources", "|"))


@query("vec_ground_questions", """
SELECT b.query_id AS question_id, b.resource_id, s.name AS title, substr(d.text, 1, 300) AS quote, b.score
FROM v_best b LEFT JOIN v_subjects s ON s.subject_id = b.resource_id LEFT JOIN documents d ON d.doc_id = b.chunk_index WHERE rank = 1""")
def _(t):
    titles = t.subjects.select(F.col("subject_id").alias("resource_id"), F.col("name").alias("title"))
    # A quote is the opening of the chunk's text.
    quotes = t.documents.select(F.col("doc_id").alias("chunk_index"), F.substring("text", 1, 300).alias("quote"))
    return (near(t, 1).join(titles, "resource_id", "left").join(quotes, "chunk_index", "left")
            .select(F.col("query_id").alias("question_id"), "resource_id", "title", "quote", "score"))


TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


@query("vec_keyword_relevance", rf"""
WITH q AS (SELECT item_id AS query_id, list_filter({TOK.format("text")}, lambda w: length(w) > 2 AND w NOT IN
   ('what', 'this', 'that', 'with', 'from', 'into', 'have', 'been', 'does', 'is', 'a', 'an', 'the')) AS qw FROM benchmark),
p AS (SELECT q.query_id, d.doc_id AS item_id, qw, lower(split_part(d.text, chr(10), 1)) AS title, lower(d.text) AS body, {TOK.format('d.text')} AS bw
  FROM q, documents d WHERE len(qw) > 0),
s AS (SELECT query_id, item_id, len(list_filter(qw, lambda w: contains(title, w))) / len(qw) * 100 * 0.60
   + coalesce(least(len(list_filter(bw, lambda w: list_contains(qw, w))) / nullif(len(bw), 0) * 150, 100.0), 0) * 0.35
   + least(len(list_filter(list_zip(qw[1:-2], qw[2:]), lambda z: contains(body, z[1] || ' ' || z[2]) OR contains(title, z[1] || ' ' || z[2]))) * 15, 100) * 0.25 AS raw0 FROM p),
r AS (SELECT query_id, item_id, round(raw0, 9) AS raw FROM s)
SELECT query_id, item_id, round_even(least(raw, 100.0), 1) AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round_even(least(raw, 100.0), 1) DESC, item_id) AS INTEGER) AS rank FROM r WHERE raw >= 50 QUALIFY rank <= 5""")
def _(t):
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    items = t.documents.select(F.col("doc_id").alias("item_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))
    return retrieval.keyword_relevance(queries, items)


def cited(t):
    """Each response with its question and, as sources, 150 characters of the first other messages of its conversation."""
    said = t.chat_messages.filter("response is not null").select("conversation_id", "turn", "message", "response")
    first = top_per_key(said, ["conversation_id"], [F.col("turn")], 11)
    others = first.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.substring("response", 1, 150).alias("preview")))).alias("others"))
    rest = F.transform(F.filter("others", lambda o: o["turn"] != F.col("turn")), lambda o: o["preview"])
    return said.join(others, "conversation_id").select(F.concat_ws("-", "conversation_id", "turn").alias("response_id"), "response",
                                                       F.concat(F.array("message"), rest).alias("sources"))


@query("vec_cite_sentences")
def _(t):
    return retrieval.cite_sentences(cited(t))
