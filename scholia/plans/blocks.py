"""Block, image and layout queries over blocks, spans and images derived from the supplied tables."""

from pyspark.sql import functions as F

from scholia.functions.text import field, unroll
from scholia.operators import blocks as B
from scholia.operators import images as I
from scholia.operators import layout as L
from scholia.plans.registry import query, view

view("v_blocks", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM documents)
SELECT doc_id, pos, CAST(pos // 20 + 1 AS INTEGER) AS page, (pos % 20) * 10.0::DOUBLE AS y,
  CASE WHEN m = 0 THEN 'h1' WHEN m = 5 THEN 'h2' WHEN m = 7 THEN 'h3' WHEN m IN (2, 4, 9) THEN 'list' WHEN m = 11 THEN 'ordered_list' ELSE 'body' END AS type,
  CASE WHEN m = 0 THEN 'Chapter ' || (pos // 12) || ' ' || x
    WHEN m = 1 AND doc_id % 4 = 1 THEN x || ' Letter: A = 0101 Number: 9 = 1001' WHEN m = 3 THEN 'and ' || x
    WHEN m = 5 THEN '2.' || (pos // 12) || ' ' || x WHEN m = 6 THEN '• ' || substr(x, 1, 20) || ' • ' || substr(x, 21) || ' ‣ z'
    WHEN m = 7 THEN x || ' (cont.)' WHEN m = 8 THEN '- -' || x || ': -Tail' WHEN m = 9 THEN x || ' Advantages of it: '
    WHEN m = 10 THEN x || '. Types of nets:' WHEN m = 11 THEN '1. ' || x ELSE x END AS text,
  CASE m WHEN 0 THEN 24.0 WHEN 5 THEN 18.0 WHEN 7 THEN 14.04 ELSE 11.0 END::DOUBLE AS font_size, CASE WHEN m IN (3, 4) THEN 1 ELSE 0 END AS indent
FROM (SELECT *, pos % 12 AS m FROM l)""")
S = r"regexp_replace(text, '^[\s\p{Z}\x{0b}\x{85}]+|[\s\p{Z}\x{0b}\x{85}]+$', '', 'g')"
KEEP = "doc_id, pos, type, text"


def shown(docs):
    return B.rows(docs).select("doc_id", "pos", "type", "text")


def parted(docs):
    """Rows with the place of a block among those its source block gave."""
    r = B.rows(docs)
    return r.select("doc_id", "seq", "pos", "type", "text")


@query("blk_union_sort", """
SELECT doc_id, page, y, pos, type, text FROM v_blocks
UNION ALL SELECT doc_id, page, 55.0, 1000000 + page, 'table', '| a |' FROM (SELECT DISTINCT doc_id, page FROM v_blocks)""")
def _(t):
    text = B.rows(t.blocks).select("doc_id", "page", "y", "pos", "type", "text")
    tables = text.select("doc_id", "page").distinct().select(
        "doc_id", "page", F.lit(55.0).alias("y"), (F.col("page") + 1000000).alias("pos"), F.lit("table").alias("type"), F.lit("| a |").alias("text"))
    return B.union_sort(text, tables)


@query("blk_exact_dedup", f"""
WITH n AS (SELECT *, lower({S}) AS n, row_number() OVER (PARTITION BY doc_id, lower({S}) ORDER BY pos) AS k FROM v_blocks)
SELECT {KEEP} FROM n WHERE NOT (k > 1 AND length(n) > 10 AND (starts_with(type, 'h') OR length(n) < 200))""")
def _(t):
    return shown(B.exact_dedup(t.blocks))


@query("blk_fuzzy_heading_dedup")
def _(t):
    return shown(B.fuzzy_heading_dedup(t.blocks))


def boxes(t):
    """Seven overlapping layout boxes per page, as a detector would give them."""
    page = t.span_pages.select("doc_id", "page", "height")
    n = F.explode(F.sequence(F.lit(0), F.lit(6)))
    b = page.withColumn("box_no", n)
    labels = F.array(*[F.lit(x) for x in ("Title", "Text", "List-item", "Picture", "Section-header", "Page-footer", "Text")])
    return b.select("doc_id", "page", "box_no", F.get(labels, F.col("box_no")).alias("label"), F.lit(0.0).alias("bx0"), F.lit(600.0).alias("bx1"),
                    (F.col("box_no") * 30.0 + 40).alias("by0"), (F.col("box_no") * 30.0 + 40 + 20 + F.pmod("page", F.lit(5)) * 10).alias("by1"),
                    (F.lit(0.5) + F.pmod(F.col("box_no") * 7 + F.col("page"), F.lit(5)) * 0.1).alias("conf"))


def page_blocks(t):
    return L.lines_to_blocks(L.drop_headers_footers(L.spans_to_lines(t.span_pages)))


@query("blk_layout_resolve", """
WITH l AS (SELECT *, CASE pos % 5 WHEN 0 THEN 'skip' WHEN 1 THEN 'h2' WHEN 2 THEN 'body' WHEN 3 THEN 'list' END AS lay, length(text) AS n FROM v_blocks)
SELECT doc_id, pos, CASE WHEN lay = 'skip' AND type = 'body' THEN 'skip' WHEN type = 'body' AND lay = 'h2' AND n < 100 THEN 'h2'
    WHEN starts_with(type, 'h') AND lay = 'body' AND n > 150 THEN 'body' WHEN lay = 'list' AND type = 'body' THEN 'list' ELSE type END AS type,
  CASE WHEN starts_with(type, 'h') AND lay = 'h2' THEN 0.95 WHEN type = 'body' AND lay = 'h2' AND n < 100 THEN 0.7
    WHEN starts_with(type, 'h') AND lay = 'body' AND n > 150 THEN 0.8 WHEN lay = 'list' AND type = 'body' THEN 0.75 ELSE 1.0 END::DOUBLE AS confidence FROM l""")
def _(t):
    b = B.rows(t.blocks)
    m = F.pmod("pos", F.lit(5))
    lay = F.when(m == 0, "skip").when(m == 1, "h2").when(m == 2, "body").when(m == 3, "list")
    labels = b.select("doc_id", "pos", lay.alias("layout_type"))
    return B.layout_resolve(b, labels).select("doc_id", "pos", "type", "confidence")


@query("blk_heading_rank", rf"""
WITH z AS (SELECT doc_id, round_even(font_size, 1) AS z, row_number() OVER (PARTITION BY doc_id ORDER BY round_even(font_size, 1) DESC) AS r
  FROM (SELECT DISTINCT doc_id, font_size FROM v_blocks WHERE starts_with(type, 'h')))
SELECT b.doc_id, b.pos, CASE WHEN NOT starts_with(type, 'h') THEN type WHEN length({S}) > 160 THEN 'body'
   WHEN regexp_matches({S}, '(?i)^(Module|Chapter|Unit)\s+\d+') THEN 'h1' WHEN regexp_matches({S}, '^\d+\.\d+\s+.+$') THEN 'h2'
   WHEN regexp_matches({S}, '^\d+(\.\d+)+\s+.+$') THEN 'h3' WHEN z.r <= 3 THEN 'h' || z.r ELSE 'body' END AS type, b.text
FROM v_blocks b LEFT JOIN z ON z.doc_id = b.doc_id AND z.z = round_even(b.font_size, 1)""")
def _(t):
    return shown(B.heading_rank(t.blocks))


@query("blk_heading_jumps", f"""
WITH h AS (SELECT *, CAST(substr(type, 2, 1) AS INTEGER) AS lv FROM v_blocks WHERE starts_with(type, 'h')),
c AS (SELECT doc_id, pos, least(lv, coalesce(lag(lv, 1) OVER w, 9) + 1, coalesce(lag(lv, 2) OVER w, 9) + 2, coalesce(lag(lv, 3) OVER w, 9) + 3,
   coalesce(lag(lv, 4) OVER w, 9) + 4, coalesce(lag(lv, 5) OVER w, 9) + 5) AS lv FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lv = 1 ORDER BY pos) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS kk,
   bool_or(lv = 1) OVER (PARTITION BY doc_id) AS has FROM c),
f AS (SELECT b.doc_id, b.pos, b.text, CASE WHEN o.lv IS NULL THEN b.type WHEN o.lv = 1 AND o.k > 1 THEN 'h2' WHEN NOT o.has AND o.kk = 1 THEN 'h1' ELSE 'h' || o.lv END AS type
  FROM v_blocks b LEFT JOIN o ON o.doc_id = b.doc_id AND o.pos = b.pos),
p AS (SELECT *, lag(type) OVER w AS pt, lag(lower({S})) OVER w AS px FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT {KEEP} FROM p WHERE NOT (starts_with(type, 'h') AND coalesce(starts_with(pt, 'h') AND px = lower({S}), false))""")
def _(t):
    return shown(B.heading_jumps(t.blocks))


@query("blk_split_bullets", rf"""
WITH b AS (SELECT *, {S} AS s FROM v_blocks), c AS (SELECT *, len(regexp_extract_all(s, '[•‣◦⁃∙►▪▸➤➢]')) AS n,
  list_filter(list_transform(regexp_split_to_array(s, '[•‣◦⁃∙►▪▸➤➢]'), lambda x: trim(x)), lambda x: length(x) > 1) AS items FROM b)
SELECT doc_id, pos, CASE WHEN n >= 2 AND len(items) > 0 THEN 'list' WHEN n = 1 AND regexp_matches(s, '^[•‣◦⁃∙►▪▸➤➢]') THEN 'list' ELSE type END AS type,
  unnest(CASE WHEN n >= 2 AND len(items) > 0 THEN items ELSE [text] END) AS text FROM c""")
def _(t):
    return shown(B.split_bullets(t.blocks))


@query("blk_list_format", rf"""
WITH b AS (SELECT *, {S} AS s FROM v_blocks), c AS (SELECT *, regexp_matches(s, '^\(?([0-9a-zA-Z]|[ivxIVX]+)[.)](\s+|$)') AS o, regexp_replace(s, '^[–—‐‑\- ]+', '') AS bare FROM b),
d AS (SELECT *, NOT o AND regexp_matches(s, '^[–—‐‑\-].') AND bare <> '' AS dash FROM c),
e AS (SELECT *, CASE WHEN s = '' THEN type WHEN o THEN 'ordered_list' WHEN dash AND type = 'body' THEN 'list' ELSE type END AS k, CASE WHEN dash THEN bare ELSE text END AS x FROM d)
SELECT doc_id, pos, k AS type, CASE WHEN s = '' THEN text WHEN k IN ('list', 'ordered_list') THEN {S.replace("(text", "(regexp_replace(x, '^[–—‐‑\\-]+\\s*', '')")}
   WHEN k = 'body' THEN regexp_replace(x, '([:\.])\s*-([A-Z])', '\1 \2', 'g') ELSE x END AS text FROM e""".replace("\\\\", "\\"))
def _(t):
    return shown(B.list_format(t.blocks))


@query("blk_merge_continuations")
def _(t):
    return shown(B.merge_continuations(t.blocks))


@query("blk_orphan_body", f"""
WITH w AS (SELECT *, lag(type) OVER w AS pt, lag(page) OVER w AS pp, lead(type) OVER w AS nt FROM v_blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, CASE WHEN type = 'body' AND pt IN ('list', 'ordered_list') AND nt IN ('list', 'ordered_list') AND page = pp AND length(text) < 100 THEN pt ELSE type END AS type, text FROM w""")
def _(t):
    return shown(B.orphan_body(t.blocks))


@query("blk_list_wrapping")
def _(t):
    return shown(B.list_wrapping(t.blocks))


LABEL = r"(?:Advantages|Disadvantages|Features|Benefits|Drawbacks|Characteristics|Properties|Types|Examples|Steps|Requirements)\s+(?:of\s+)?"


@query("blk_split_list_headers", rf"""
WITH b AS (SELECT *, {S} AS s FROM v_blocks), c AS (SELECT *, regexp_extract(s, '(?i)^(.+?)\s+({LABEL}[^:]*:\s*)$', 1) AS i, regexp_extract(s, '(?i)^(.+?)\s+({LABEL}[^:]*:\s*)$', 2) AS l FROM b)
SELECT doc_id, pos, type, CASE WHEN type IN ('list', 'ordered_list') AND length(trim(i)) > 5 THEN trim(i) ELSE text END AS text FROM c
UNION ALL SELECT doc_id, pos, 'body', '**' || trim(l) || '**' FROM c WHERE type IN ('list', 'ordered_list') AND length(trim(i)) > 5""")
def _(t):
    return shown(B.split_list_headers(t.blocks))


@query("blk_redundant_metadata")
def _(t):
    return shown(B.redundant_metadata(t.blocks))


@query("blk_split_examples", rf"""
WITH b AS (SELECT *, {S} AS s FROM v_blocks), c AS (SELECT *, regexp_extract_all(s, '(?:^|\s)([A-Z][a-z]+(?:\s+[a-z]+)*\s*:\s*\S+\s*=\s*[01]+)', 1) AS ex FROM b)
SELECT doc_id, pos, type, unnest(CASE WHEN type = 'body' AND len(ex) >= 2 THEN list_concat(list_filter([trim(substr(s, 1, instr(s, ex[1]) - 1))], lambda x: x <> ''),
   list_transform(ex, lambda e: '**' || trim(split_part(e, ':', 1)) || ':** ' || trim(substr(e, instr(e, ':') + 1)))) ELSE [text] END) AS text FROM c""")
def _(t):
    return shown(B.split_examples(t.blocks))


@query("blk_list_header_extract", rf"""
WITH w AS (SELECT *, {S} AS s, lead(type) OVER (PARTITION BY doc_id ORDER BY pos) AS nt FROM v_blocks),
c AS (SELECT *, regexp_extract(s, '(?is)^(.*?\.\s+)({LABEL}[^:]{{0,40}}:\s*)$', 1) AS i, regexp_extract(s, '(?is)^(.*?\.\s+)({LABEL}[^:]{{0,40}}:\s*)$', 2) AS l FROM w),
d AS (SELECT *, type = 'body' AND i <> '' AND coalesce(nt IN ('list', 'ordered_list'), false) AS cut, type = 'body' AND regexp_matches(s, '(?i)^({LABEL}[^:]*:\s*)$') AS lone FROM c)
SELECT doc_id, pos, type, CASE WHEN cut THEN trim(i) WHEN lone THEN '**' || s || '**' ELSE text END AS text FROM d
UNION ALL SELECT doc_id, pos, type, '**' || trim(l) || '**' FROM d WHERE cut""")
def _(t):
    return shown(B.list_header_extract(t.blocks))


@query("blk_to_markdown")
def _(t):
    return B.to_markdown(B.clean_pipeline(t.blocks))


@query("blk_slide_filter")
def _(t):
    """Every run of four lines is a slide; its first line is the title."""
    def slide(p):
        bs = F.slice("blocks", (p * 4 + 1).cast("int"), F.lit(4))
        first = F.get(bs, F.lit(0))
        title = F.when(F.pmod(p, F.lit(3)) == 1, "Summary").when(F.pmod(p, F.lit(3)) == 2, "Trace of a loop (cont.)").otherwise(first["text"])
        return F.struct((p + 1).cast("int").alias("page"), title.alias("title"), bs.alias("blocks"))
    n = F.floor((F.size("blocks") + 3) / 4)
    slides = t.blocks.select("doc_id", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), slide).alias("slides"))
    return shown(B.slide_filter(slides))


# -- images ---------------------------------------------------------------------------------------

view("v_images", """
WITH e AS (SELECT *, CAST(floor(value) AS DOUBLE) AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT user_id AS doc_id, event_id AS image_id, k % 4 + 1 AS page, k * 5.0::DOUBLE AS x, v * 3 AS y, v * 20 AS width, k * 8.0::DOUBLE AS height,
  CASE event_type WHEN 'click' THEN 'chart' WHEN 'view' THEN 'picture' ELSE 'other' END AS shape, md5(props) AS md5 FROM e""")


@query("blk_image_dedup", "SELECT doc_id, md5, min(image_id) AS image_id FROM v_images GROUP BY 1, 2")
def _(t):
    return I.image_dedup(t.images).select("doc_id", "md5", "image_id")


@query("blk_image_classify", """
WITH b AS (SELECT *, CASE WHEN width < 150 AND height < 150 THEN 1 WHEN width / 600 > 0.85 AND height / 800 > 0.85 THEN 2
     WHEN (x / 600 < 0.05 OR x / 600 > 0.95) AND y / 800 < 0.05 THEN 3 WHEN width > 0 AND height > 0 AND (width / height > 5 OR height / width > 5) THEN 4
     WHEN shape = 'chart' THEN 5 WHEN shape = 'picture' THEN 6 ELSE 7 END AS c FROM v_images),
n AS (SELECT *, CASE WHEN c > 4 THEN row_number() OVER (PARTITION BY doc_id, c > 4, round_even(x, -1), round_even(y, -1), round_even(width, -1), round_even(height, -1) ORDER BY image_id) END AS k FROM b),
f AS (SELECT image_id, c, CASE WHEN c <= 4 THEN c WHEN k >= 3 THEN 8 WHEN md5 IN (SELECT md5('{"k": ' || n_nationkey || '}') FROM nation) THEN 9 WHEN width <= 160 AND height <= 200 THEN 10 ELSE c END AS o FROM n)
SELECT image_id, o NOT IN (5, 6, 7) AS is_decorative, o IN (5, 6, 7) AS is_diagram, list_extract([0.95, 0.9, 0.85, 0.8, 0.95, 0.7, 0.5, 0.95, 0.98, 0.6]::DOUBLE[], o) AS confidence FROM f""")
def _(t):
    skip = t.nation.select(F.md5(F.concat(F.lit('{"k": '), F.col("n_nationkey").cast("string"), F.lit("}"))).alias("md5"))
    return I.image_classify(t.images, skip, [(160.0, 200.0, 0.6)])


@query("blk_image_place", """
WITH l AS (SELECT doc_id, pos, total, CASE pos % 6 WHEN 0 THEN '<!-- Page ' || (pos // 6 + 1) || ' -->' WHEN 2 THEN 'see figure 3 ' || line ELSE line END AS line FROM v_doc_lines),
t AS (SELECT doc_id, max(total) AS total FROM l GROUP BY 1),
r AS (SELECT i.doc_id, i.page, row_number() OVER (PARTITION BY i.doc_id, i.page ORDER BY image_id) AS rank, '![img](' || image_id || '.png)' AS link, total FROM v_images i JOIN t USING (doc_id))
SELECT doc_id, pos, 0 AS page, 0::BIGINT AS rank, line AS markdown FROM l
UNION ALL SELECT doc_id, CAST(coalesce(least(CASE WHEN rank = 1 AND (page - 1) * 6 + 2 < total THEN (page - 1) * 6 + 2 END, CASE WHEN (page - 1) * 6 < total THEN least(page * 6, total) - 1 END), 2147483647) AS INTEGER),
  page, rank, link FROM r""")
def _(t):
    def shape(x, i):
        m = F.pmod(i, F.lit(6))
        page = F.concat(F.lit("<!-- Page "), (F.floor(i / 6) + 1).cast("string"), F.lit(" -->"))
        return F.when(m == 0, page).when(m == 2, F.concat(F.lit("see figure 3 "), x)).otherwise(x)
    return I.image_place(t._marked(shape), t.images)


# -- layout -----------------------------------------------------------------------------------------


view("v_page_rows", r"""
WITH w AS (SELECT doc_id, pos + 1 AS page, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS w FROM v_doc_lines),
r AS (SELECT doc_id, page, w, CAST(180.0 + ceil(ceil(len(w) / 6) / 2) * 14 AS DOUBLE) AS height, unnest(range(0, CAST(ceil(len(w) / 12) AS BIGINT))) AS r FROM w),
t AS (SELECT *, r % 4 = 3 AS bullet, array_to_string(w[r * 12 + 1 : r * 12 + 6], ' ') AS a, array_to_string(w[r * 12 + 7 : r * 12 + 12], ' ') AS b,
   CASE WHEN r = 0 AND page % 3 = 1 THEN 24.0 WHEN r = 0 AND page % 3 = 2 THEN 18.0 ELSE 11.0 END::DOUBLE AS size FROM r),
u AS (SELECT *, CASE WHEN bullet THEN '• ' || a ELSE a END AS t0, CASE WHEN bullet THEN 70.0 ELSE 50.0 END::DOUBLE AS x0 FROM t)
SELECT doc_id, page, CAST(r AS INTEGER) AS line_no, t0, b AS t1, CASE WHEN b <> '' THEN t0 || ' ' || b ELSE t0 END AS text, x0,
  greatest(CASE WHEN page % 7 = 0 THEN x0 + least(length(t0) * 5, 200) ELSE x0 + 269.0 END,
    CASE WHEN b = '' THEN 0.0 WHEN page % 7 = 0 THEN 320.0 + least(length(b) * 5, 200) ELSE 320.0 + length(b) * 5 END)::DOUBLE AS x1,
  (60.0 + r * 14)::DOUBLE AS top, (60.0 + r * 14 + size)::DOUBLE AS bottom, size, height,
  CASE WHEN page % 5 = 4 THEN 'Courier' ELSE 'Arial' END || '|' || printf('%.1f', size) || '|' || CASE WHEN size > 20 THEN 'true' ELSE 'false' END || '|false' AS font FROM u""")


@query("lay_font_hierarchy", """
WITH c AS (SELECT doc_id, font, size, sum(length(t0) + length(t1)) AS chars FROM v_page_rows GROUP BY 1, 2, 3),
b AS (SELECT doc_id, arg_max(font, (chars, font)) AS bf, arg_max(size, (chars, font)) AS bs FROM c GROUP BY 1),
z AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) AS r FROM (SELECT DISTINCT c.doc_id, c.size FROM c JOIN b USING (doc_id) WHERE c.size > b.bs + 0.5))
SELECT c.doc_id, c.font AS font_key, 'h' || z.r AS level, c.font = b.bf AS is_body FROM c JOIN b USING (doc_id) LEFT JOIN z ON z.doc_id = c.doc_id AND z.size = c.size""")
def _(t):
    return L.font_hierarchy(t.span_pages).select("doc_id", "font_key", "level", "is_body")


@query("lay_spans_to_lines", "SELECT doc_id, page, line_no, text, x0, x1, top, bottom, font FROM v_page_rows")
def _(t):
    wanted = {n: field(n) for n in ("text", "x0", "x1", "top", "bottom")} | {"font": field("font.key")}
    return unroll(L.spans_to_lines(t.span_pages), ["doc_id", "page"], "lines", "line_no", wanted)


@query("lay_lines_to_blocks", """
WITH f AS (SELECT *, CASE WHEN lag(line_no) OVER w IS NULL OR size <> lag(size) OVER w OR font <> lag(font) OVER w OR line_no % 4 = 3 OR regexp_matches(text, '^[0-9]+[.)] ')
    OR abs(x0 - lag(x0) OVER w) > 15 THEN 1 ELSE 0 END AS s FROM v_page_rows WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS k FROM f)
SELECT doc_id, page, CAST(k - 1 AS INTEGER) AS block_no, string_agg(text, ' ' ORDER BY line_no) AS text, CASE WHEN k > 1 AND arg_min(x0, line_no) > 65 THEN 1 ELSE 0 END AS indent FROM g GROUP BY doc_id, page, k""")
def _(t):
    return L.lines_to_blocks(L.spans_to_lines(t.span_pages)).select("doc_id", "page", "block_no", "text", "indent")


def column_sql(x, e):
    """Column of ``x`` between the edges ``e``, else the one with the nearest centre."""
    return (f"coalesce(CASE WHEN {x} >= {e}[1] AND {x} < {e}[-1] THEN len(list_filter({e}, lambda b: b <= {x})) - 1 END, "
            f"list_sort(list_transform(range(1, len({e})), lambda i: {{'d': abs({x} - ({e}[i] + {e}[i + 1]) / 2), 'i': i - 1}}))[1].i)")


@query("lay_columns", rf"""
WITH s AS (SELECT doc_id, page, 2 * line_no AS span_no, t0 AS text, x0, (CASE WHEN page % 7 = 0 THEN x0 + least(length(t0) * 5, 200) ELSE x0 + 269.0 END)::DOUBLE AS x1, top FROM v_page_rows
  UNION ALL SELECT doc_id, page, 2 * line_no + 1, t1, 320.0::DOUBLE, (320 + CASE WHEN page % 7 = 0 THEN least(length(t1) * 5, 200) ELSE length(t1) * 5 END)::DOUBLE, top FROM v_page_rows WHERE t1 <> ''),
p AS (SELECT doc_id, page FROM s GROUP BY 1, 2 HAVING count(*) >= 4),
u AS (SELECT doc_id, page, x0, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, page ORDER BY x0) >= 20 THEN 1 ELSE 0 END AS cut FROM s JOIN p USING (doc_id, page)
  WHERE regexp_matches(text, '^[{L.BULLETS}]') QUALIFY count(*) OVER (PARTITION BY doc_id, page) >= 6),
v AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page ORDER BY x0) AS k FROM u),
m AS (SELECT doc_id, page, k, sum(x0) / count(*) AS c FROM v GROUP BY 1, 2, 3 HAVING count(*) >= 3),
n AS (SELECT doc_id, page, list(c ORDER BY c) AS cs FROM m GROUP BY 1, 2 HAVING count(*) >= 2),
marks AS (SELECT doc_id, page, [0.0::DOUBLE] || list_transform(range(1, len(cs)), lambda i: (cs[i] + cs[i + 1]) / 2) || [600.0::DOUBLE] AS e FROM n
  WHERE len(list_filter(range(1, len(cs)), lambda i: cs[i + 1] - cs[i] < 50)) = 0),
i AS (SELECT doc_id, page, greatest(0, CAST(trunc(x0) AS INTEGER)) AS a, CAST(trunc(x1) AS INTEGER) AS b FROM s JOIN p USING (doc_id, page)),
j AS (SELECT *, max(b) OVER (PARTITION BY doc_id, page ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS r FROM i),
l AS (SELECT doc_id, page, min(a) AS lo, max(b) AS hi FROM i GROUP BY 1, 2),
g AS (SELECT doc_id, page, lo, hi, list((r + a) / 2.0 ORDER BY a) AS mids FROM j JOIN l USING (doc_id, page)
  WHERE a > r AND a - r >= 15 AND r > lo + (hi - lo) * 0.05 AND a < hi - (hi - lo) * 0.05 AND hi - lo >= 100 GROUP BY 1, 2, 3, 4),
strips AS (SELECT doc_id, page, [lo::DOUBLE] || mids::DOUBLE[] || [(hi + 1)::DOUBLE] AS e FROM g),
cells AS (SELECT DISTINCT doc_id, page, round_even(top / 8, 0) AS y, len(list_filter(e, lambda b: b <= (x0 + x1) / 2)) AS c FROM s JOIN strips USING (doc_id, page)
  WHERE (x0 + x1) / 2 >= e[1] AND (x0 + x1) / 2 < e[-1]),
held AS (SELECT doc_id, page FROM (SELECT doc_id, page, y FROM cells GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY 1, 2 HAVING count(*) >= 3),
z AS (SELECT s.*, (x0 + x1) / 2 AS mid, marks.e AS me, CASE WHEN held.doc_id IS NOT NULL THEN strips.e END AS se FROM s LEFT JOIN marks USING (doc_id, page)
  LEFT JOIN strips USING (doc_id, page) LEFT JOIN held USING (doc_id, page))
SELECT doc_id, page, CAST(span_no AS INTEGER) AS span_no, CAST(CASE WHEN me IS NOT NULL THEN {column_sql("x0", "me")} WHEN se IS NOT NULL THEN {column_sql("mid", "se")} ELSE 0 END AS INTEGER) AS column_no FROM z""")
def _(t):
    return L.columns(t.span_pages)


view("v_page_blocks", r"""
WITH k AS (SELECT * FROM v_page_rows WHERE NOT regexp_matches(text, '(?i)©.*Cisco|Cisco\s*(Confidential|Public)|All rights reserved|Cisco\s+and/or\s+its\s+affiliates')
  AND NOT ((bottom < height * 0.05 OR top > height * 0.90) AND length(text) < 5) AND NOT regexp_matches(text, '^\d{1,3}$')),
f AS (SELECT *, top - lag(bottom) OVER w AS gap, lag(bottom) OVER w - lag(top) OVER w AS high, lag(size) OVER w AS s0, lag(font) OVER w AS f0, lag(x0) OVER w AS l0
  FROM k WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
g AS (SELECT *, sum(CASE WHEN s0 IS NULL OR gap > high * 1.5 OR abs(s0 - size) > 0.5 OR split_part(f0, '|', 3) <> split_part(font, '|', 3) OR (gap > high * 0.8 AND f0 <> font)
    OR regexp_matches(text, '""" + f"^[{L.BULLETS}]|{L.NUMBERED}" + r"""') OR (abs(x0 - l0) > 15 AND gap > 2) THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id, page ORDER BY line_no) - 1 AS block_no FROM f)
SELECT doc_id, page, block_no, string_agg(text, ' ' ORDER BY line_no) AS text, count(*) AS n_lines, any_value(font) AS font, any_value(size) AS size,
  (min(x0) + max(x1)) / 2 AS cx, (min(top) + max(bottom)) / 2 AS cy FROM g GROUP BY 1, 2, 3""")


@query("lay_point_in_box", r"""
WITH n AS (SELECT unnest(range(7)) AS box_no),
h AS (SELECT b.*, box_no, box_no * 30 + 40 AS by0, 20 + page % 5 * 10 AS tall, 0.5::DOUBLE + ((box_no * 7 + page) % 5)::DOUBLE * 0.1::DOUBLE AS conf FROM v_page_blocks b, n)
SELECT doc_id, page, CAST(block_no AS INTEGER) AS block_no, arg_max(['Title', 'Text', 'List-item', 'Picture', 'Section-header', 'Page-footer', 'Text'][box_no + 1],
  (conf / (600.0::DOUBLE * tall), -box_no)) AS label
FROM h WHERE cx BETWEEN 0 AND 600 AND cy BETWEEN by0 AND by0 + tall GROUP BY 1, 2, 3""")
def _(t):
    return L.point_in_box(page_blocks(t), boxes(t))


@query("lay_header_footer", r"""
WITH k AS (SELECT * FROM v_page_rows WHERE NOT regexp_matches(text, '(?i)©.*Cisco|Cisco\s*(Confidential|Public)|All rights reserved|Cisco\s+and/or\s+its\s+affiliates')
  AND NOT ((bottom < height * 0.05 OR top > height * 0.90) AND length(text) < 5) AND NOT regexp_matches(text, '^\d{1,3}$'))
SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) - 1 AS INTEGER) AS line_no, text, top FROM k""")
def _(t):
    kept = L.drop_headers_footers(L.spans_to_lines(t.span_pages))
    return unroll(kept, ["doc_id", "page"], "lines", "line_no", {n: field(n) for n in ("text", "top")})


def contained(c, words):
    return " + ".join(f"contains({c}, '{w}')::INT" for w in words)


# Within a block the size and weight do not change, so its font is that of any line.
@query("lay_block_classify", rf"""
WITH c AS (SELECT doc_id, font, size, sum(length(t0) + length(t1)) AS chars FROM v_page_rows GROUP BY 1, 2, 3),
b AS (SELECT doc_id, arg_max(size, (chars, font)) AS body FROM c GROUP BY 1),
z AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) AS r FROM (SELECT DISTINCT c.doc_id, c.size FROM c JOIN b USING (doc_id) WHERE c.size > b.body + 0.5)),
k AS (SELECT v.doc_id, page, block_no, text, text AS t, n_lines, v.size, v.size - body AS diff, CASE WHEN z.r IS NOT NULL THEN 'h' || least(z.r, 5) END AS level, split_part(font, '|', 3) = 'true' AS bold, length(text) AS n,
    regexp_matches(text, '(?i)^Video\s*[-–—]\s*|^Lab\s*[-–—]\s*') AS skip, {contained("lower(split_part(font, '|', 1))", L.MONO)} > 0 AS mono, {contained("text", L.CODE)} AS named,
    contains(text, '(') AND contains(text, ')') AS br, contains(text, '{{') AND contains(text, '}}') AS bc, contains(text, ';') AS sc, contains(text, '=') AND NOT starts_with(text, '=') AS eq,
    regexp_matches(text, '^[{L.BULLETS}]') OR (regexp_matches(text, '^[{L.DASHES}]\s*\p{{Lu}}') AND length(text) > 2) AS mark
  FROM v_page_blocks v JOIN b USING (doc_id) LEFT JOIN z ON z.doc_id = v.doc_id AND z.size = v.size)
SELECT doc_id, page, CAST(block_no AS INTEGER) AS block_no, text, CASE WHEN t = '' THEN 'body' WHEN level IS NOT NULL AND n < 200 THEN CASE WHEN skip THEN 'skip' ELSE level END
  WHEN bold AND n < 100 AND n_lines <= 2 THEN CASE WHEN skip THEN 'skip' WHEN diff > 4 THEN 'h2' WHEN diff > 1 THEN 'h3' ELSE 'h4' END
  WHEN bold AND n < 80 AND n_lines = 1 THEN 'h4' WHEN mark THEN 'list' WHEN regexp_matches(t, '{L.NUMBERED}') THEN 'ordered_list'
  WHEN mono OR (n BETWEEN 16 AND 500 AND ((bc AND sc) OR (br AND sc AND eq) OR (named >= 2 AND br::INT + bc::INT + sc::INT + eq::INT >= 2))) THEN 'code' ELSE 'body' END AS type FROM k""")
def _(t):
    return L.block_classify(page_blocks(t), L.font_hierarchy(t.span_pages))


@query("lay_size_thresholds", r"""
WITH w AS (SELECT doc_id, page, list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '') AS w FROM (
   SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)),
s AS (SELECT doc_id, page, unnest(range(0, CAST(ceil(len(w) / 6) AS BIGINT))) AS g FROM w),
z AS (SELECT doc_id, CASE WHEN g // 2 = 0 AND page % 3 = 1 THEN 24.0 WHEN g // 2 = 0 AND page % 3 = 2 THEN 18.0 ELSE 11.0 END::DOUBLE AS size FROM s),
m AS (SELECT doc_id, list_sort(list(size))[len(list(size)) // 2 + 1] AS m FROM z GROUP BY 1)
SELECT doc_id, m AS median_size, greatest(m * 1.6, 28.0) AS h1, greatest(m * 1.3, 22.0) AS h2, greatest(m * 1.1, 16.0) AS h3 FROM m""")
def _(t):
    return L.size_thresholds(t.span_pages)
