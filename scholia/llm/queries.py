"""Registers the operators' queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.llm import bpe, chat, covertree, decontaminate, fingerprint, lengths, merkle, neardup, secret_scan, shards, spelling, toxicity, warc
from scholia.llm.common import LOWER, UPPER, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bi AS (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bn),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g)),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di),
h AS (SELECT DISTINCT doc_id, n, i, CAST(item_id AS VARCHAR) AS item FROM p JOIN g USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

GROUPS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_ >= 80 * (a.n + b.n - both_)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def escaped(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for x in chat.CONTROL:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
o AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN before IS DISTINCT FROM role THEN {len(chat.TURN + chat.TEXT)} + length({escaped("role")}) ELSE {len(chat.NEXT)} END
    + length({escaped("text")}) + CASE WHEN after IS DISTINCT FROM role THEN {len(chat.END)} ELSE 0 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


@query("op3_token_lengths")
def token_lengths(spark, sf_dir):
    return lengths.histogram(bpe.token_counts(table(spark, sf_dir, "documents")))


@query("op5_bpe_round_trip")
def bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query("op9_near_duplicates", GROUPS)
def near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4).drop("rid")


@query("op2_decontamination", CONTAMINATION)
def decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_secret_scan")
def secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(docs))


@query("op10_toxicity")
def toxic_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op1_fingerprints")
def edited_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return fingerprint.edited_fingerprints(docs, fingerprint.lexicon(docs))


@query("op4_shards")
def shard_rows(spark, sf_dir):
    return shards.assign(table(spark, sf_dir, "documents"))


@query("op6_chat", CHAT)
def chat_digests(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.formatted(turns.union(more)))


REVISITS = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS m, sha256(coalesce(html, '')) AS sha, strlen(coalesce(html, '')) AS n,
         instr('0123456789abcdef', substr(md5(coalesce(html, '')), 1, 1)) AS digit, 1700000000 + page_id * 60 AS secs FROM pages
), u AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)),
           '^.*@|:(80|443)$', '', 'g'), '^www\.', '') || regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/+$', '') AS site,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|ref|fbclid|gclid|sessionid|phpsessid)(=|$)'))), '&') AS q FROM p
), k AS (
  SELECT *, site || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key, '"' || m || '"' AS quoted FROM u
), resp AS (
  SELECT key, secs::HUGEINT * 1000000000 + page_id * 4 AS ord, page_id * 4 AS response_id, quoted AS etag, secs::VARCHAR AS modified, n, sha FROM k
), rev AS (
  SELECT key, (secs + shift)::HUGEINT * 1000000000 + page_id * 4 + i AS ord, page_id * 4 + i AS record_id,
         CASE digit % 4 WHEN 0 THEN quoted WHEN 1 THEN 'W/' || quoted WHEN 2 THEN '"other"' END AS etag, CASE WHEN digit % 4 = 3 THEN secs::VARCHAR END AS modified
  FROM k, (VALUES (1, 604800), (2, -1)) AS s(i, shift) WHERE i = 1 OR digit > 12
), j AS (
  SELECT rev.*, resp.response_id, resp.etag AS retag, resp.modified AS rmodified, resp.n, resp.sha,
         CASE WHEN resp.response_id IS NULL THEN 'no_response'
              WHEN rev.etag IS NOT NULL THEN CASE WHEN regexp_replace(rev.etag, '^W/', '') = resp.etag THEN 'resolved' ELSE 'mismatch' END
              WHEN rev.modified = resp.modified THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM rev ASOF LEFT JOIN resp ON rev.key = resp.key AND rev.ord > resp.ord
)
SELECT record_id, key, outcome, response_id,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=120; content-length: ' || n || '; content-type: text/html; etag: ' || coalesce(etag, retag)
         || '; last-modified: ' || coalesce(modified, rmodified) || '; x-seen: again' END AS headers,
       CASE WHEN outcome = 'resolved' THEN sha END AS payload_sha256, CASE WHEN outcome = 'resolved' THEN n END AS payload_bytes
FROM j
"""


@query("op7_warc_revisits", REVISITS)
def warc_revisits(spark, sf_dir):
    found = warc.resolve(warc.page_records(table(spark, sf_dir, "pages")), ["payload_sha256", "payload_bytes"])
    told = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return found.select("record_id", "key", "outcome", "response_id", told.alias("headers"), "payload_sha256", "payload_bytes")


# crc32 of UTF-8 bytes by its table; the oracle's engine has no such function. The polynomial is fixed.
CRC_TABLE = """
tab AS (WITH RECURSIVE r(i, v, k) AS (SELECT i, i, 0 FROM range(256) AS t(i) UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM r WHERE k < 8)
  SELECT list(v ORDER BY i) AS tab FROM r WHERE k = 8)"""


def crc32(x: str) -> str:
    hexed = f"hex(encode({x}))"
    nibble = lambda at: f"(instr('0123456789ABCDEF', substr({hexed}, {at}, 1)) - 1)"
    codes = f"list_transform(range(1, len({hexed}), 2), lambda k: {nibble('k')} * 16 + {nibble('k + 1')})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


SPELLING = rf"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({LOW}, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents),
u AS (SELECT id, run, count(*) AS n FROM o GROUP BY 1, 2),
h AS (SELECT run, n, {crc32("id || ':' || run")} AS h FROM u, tab),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM d a JOIN d b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON w.word = d.p || d.s UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON w.word = d.p || d.s),
b AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY 1),
c AS (SELECT near.word, min(other) AS best FROM near JOIN b ON b.word = near.word AND b.m = near.m GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN best END AS form, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
  FROM w LEFT JOIN b USING (word) LEFT JOIN c USING (word)),
r(word, last) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.last AS root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word) JOIN f AS e ON e.word = r.last WHERE e.form IS NULL
"""


def _leaf(text: str) -> str:
    told = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(map(told, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


MERKLE = f"""
WITH RECURSIVE {CRC_TABLE},
l AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS leaf,
  CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS seen FROM documents, tab),
n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM l),
a(tree, lvl, idx, n, d) AS (SELECT tree, 0, idx, n, leaf FROM n UNION ALL
  SELECT tree, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM a WHERE n > 1 GROUP BY tree, lvl, idx // 3, n),
s AS (SELECT tree, lvl AS height, d AS subroot FROM a WHERE n = 1),
t AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM s),
b(lvl, idx, n, d) AS (SELECT 0, idx, n, subroot FROM t UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM b WHERE n > 1 GROUP BY lvl, idx // 3, n),
p AS (SELECT n.tree, n.idx AS leaf_idx, a.lvl, n.idx // CAST(pow(3, a.lvl) AS BIGINT) AS own, a.idx, a.d
  FROM n JOIN a ON a.tree = n.tree AND a.n > 1 AND a.idx // 3 = n.idx // CAST(pow(3, a.lvl + 1) AS BIGINT)
  UNION ALL SELECT n.tree, n.idx, t.height + b.lvl, t.idx // CAST(pow(3, b.lvl) AS BIGINT), b.idx, b.d
  FROM n JOIN t ON t.tree = n.tree JOIN b ON b.n > 1 AND b.idx // 3 = t.idx // CAST(pow(3, b.lvl + 1) AS BIGINT)),
q AS (SELECT tree, leaf_idx, lvl, coalesce(string_agg(d, '' ORDER BY idx) FILTER (idx < own), '') AS l, coalesce(string_agg(d, '' ORDER BY idx) FILTER (idx > own), '') AS r
  FROM p GROUP BY tree, leaf_idx, lvl),
z AS (SELECT tree, leaf_idx, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof FROM q GROUP BY 1, 2),
f(tree, leaf_idx, lvl, d) AS (SELECT tree, idx, 0, coalesce(seen, leaf) FROM n UNION ALL
  SELECT f.tree, f.leaf_idx, f.lvl + 1, sha256(q.l || f.d || q.r) FROM f JOIN q ON q.tree = f.tree AND q.leaf_idx = f.leaf_idx AND q.lvl = f.lvl),
e AS (SELECT tree, leaf_idx, max_by(d, lvl) AS folded_root FROM f GROUP BY 1, 2)
SELECT n.doc_id, n.leaf, s.subroot, (SELECT d FROM b WHERE n = 1) AS root, coalesce(z.proof, sha256('')) AS proof_sha256, e.folded_root,
  e.folded_root = (SELECT d FROM b WHERE n = 1) AS verified
FROM n JOIN s USING (tree) JOIN e ON e.tree = n.tree AND e.leaf_idx = n.idx LEFT JOIN z ON z.tree = n.tree AND z.leaf_idx = n.idx
"""


@query("op11_spelling_variants", SPELLING)
def spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op12_merkle_manifest", MERKLE)
def merkle_manifest(spark, sf_dir):
    return merkle.verified(table(spark, sf_dir, "documents"))


TOP_K = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""


@query("op13_cover_tree_search", TOP_K)
def cover_tree_search(spark, sf_dir):
    return covertree.top_k(covertree.vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)
