"""Cleaning queries bound to the document corpus."""

from pyspark.sql import functions as F

from scholia.functions.text import field, let, lines, strip, unroll
from scholia.operators import cleaning as C
from scholia.operators import rewriting as R
from scholia.plans.registry import query, view

STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x{{0b}}\x{{85}}]+|[\s\p{{Z}}\x{{0b}}\x{{85}}]+$', '', 'g')"


def st(x: str) -> str:
    return STRIP.format(x)


def exploded(df, *more):
    """(doc_id, pos, line) rows: a narrow step, the document's array is unrolled in place."""
    return df.select("doc_id", F.posexplode(lines("text")).alias("pos", "line")).select("doc_id", "pos", "line", *more)


def rewritten(df, column):
    return df.select("doc_id", column.alias("text"))


BLACK = r"""(?i)^©.*$|^[©®™].*$|^\s*Page\s+\d+\s*$|^\s*Slide\s+\d+\s*$|^\s*\d+\s*$|^www\..+\.\w+$|^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$|^(Confidential|Proprietary|Internal|Draft|Confidential Information)$|^(For Official Use|Restricted|Private|Classified)$"""


@query("txt_line_blacklist", rf"""
SELECT doc_id, pos, line FROM v_scan_lines WHERE length(s) >= 3 AND NOT regexp_matches(s, '{BLACK}')""")
def _(t):
    return exploded(t.scans).filter(~C.is_blacklisted(F.col("line")))


@query("txt_header_footer", r"""
SELECT doc_id, pos, line, regexp_matches(s, '(?i)^(Footer|Header):\s*|^\d+\s*$|^Page\s+\d+\s+of\s+\d+$|^www\..*$') AS is_footer FROM v_scan_lines""")
def _(t):
    return exploded(t.scans, C.is_header_footer(F.col("line")).alias("is_footer"))


view("v_slide_kept", r"""
WITH l AS (SELECT *, contains(line, 'Start of picture') AS a, contains(line, 'End of picture') AS b,
  sum(CASE WHEN contains(line, 'Start of picture') THEN 1 WHEN contains(line, 'End of picture') THEN -1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY pos) AS depth,
  sum(CASE WHEN contains(line, 'Start of picture') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS region,
  (SELECT 1) AS one FROM v_slide_lines),
e AS (SELECT doc_id, max(region) FILTER (b) AS closed FROM l GROUP BY 1),
f AS (SELECT l.*, regexp_matches(s, '(?i)^\s*©\s*\d{4}.*|^>\s*©\s*\d{4}.*|.*All Rights Reserved.*|^\s*\d+\s*$|^\s*\d+\s+©.*') AS foot FROM l),
p AS (SELECT doc_id, region, min(pos) AS pos, regexp_replace(string_agg(q, chr(10) ORDER BY pos, k), '^\s+|\s+$', '', 'g') AS line
  FROM (SELECT doc_id, region, pos, unnest(string_split(replace(line, '<br>', chr(10)), chr(10))) AS q,
      generate_subscripts(string_split(replace(line, '<br>', chr(10)), chr(10)), 1) AS k FROM f WHERE depth = 1 AND NOT a)
  WHERE NOT regexp_matches(regexp_replace(q, '^\s+|\s+$', '', 'g'), '(?i)^\s*©\s*\d{4}.*|.*All Rights Reserved.*|^\s*\d+\s*$') GROUP BY 1, 2)
SELECT doc_id, pos, line FROM f WHERE depth = 0 AND NOT b AND NOT foot AND s NOT IN ('-', '—', '–', '*', '•')
UNION ALL SELECT p.doc_id, p.pos, p.line FROM p JOIN e ON e.doc_id = p.doc_id AND e.closed >= p.region
WHERE p.line <> '' AND NOT (length(p.line) < 15 AND NOT regexp_matches(p.line, 'cout|cin|int|=|;|[{}]'))""")


@query("txt_slide_boilerplate", """
SELECT d.doc_id, coalesce(string_agg(k.line, chr(10) ORDER BY k.pos), '') AS text FROM documents d LEFT JOIN v_slide_kept k USING (doc_id) GROUP BY 1""")
def _(t):
    return rewritten(t.slides, C.slide_boilerplate("text"))


view("v_classes", r"""
WITH l AS (SELECT *, CAST(length(s) AS DOUBLE) AS n, sum(length(line)) OVER (PARTITION BY doc_id) / total AS mean, pos / total AS rel FROM v_md_lines),
c AS (SELECT *, CASE WHEN starts_with(s, '|') AND length(s) - length(replace(s, '|', '')) >= 2 THEN
     CASE WHEN regexp_matches(s, '^\s*\|\s*[-:]+\s*(\|\s*[-:]+\s*)*\|?\s*$') THEN 1 ELSE 2 END
   WHEN n < mean * 0.3 THEN 3 WHEN n < mean * 0.5 THEN 4 WHEN rel < 0.1 AND n < mean * 0.6 THEN 5 WHEN rel < 0.2 AND n < mean * 0.7 THEN 6
   WHEN regexp_matches(s, '\p{Lu}') AND NOT regexp_matches(s, '\p{Ll}|\p{Lt}') AND n > 3 THEN CASE WHEN n < mean * 0.6 THEN 7 ELSE 8 END
   WHEN regexp_matches(s, '^(\d+\.?\s+)?[A-Z][^.!?]*$') AND n < mean * 0.7 THEN 9
   WHEN regexp_matches(s, '^\s*[-•*]\s+|^\s*\d+\.\s+|^\s*[a-z]\)\s+') THEN 10 ELSE 11 END AS k FROM l)
SELECT doc_id, pos, line, s, k, CASE WHEN k <= 2 THEN 'table_row' WHEN k IN (3, 5, 7) THEN 'h1' WHEN k IN (4, 6, 8, 9) THEN 'h2' WHEN k = 10 THEN 'list' ELSE 'body' END AS type,
  list_extract([0.0, 0.95, 0.85, 0.80, 0.80, 0.75, 0.90, 0.80, 0.75, 0.85, 0.60]::DOUBLE[], k) AS confidence FROM c""")


@query("txt_line_classify", "SELECT doc_id, pos, type, confidence FROM v_classes")
def _(t):
    wanted = {n: field(n) for n in ("pos", "type", "confidence")}
    return unroll(t.markdown, ["doc_id"], C.classified_lines("text"), "_i", wanted).drop("_i")


view("v_md_kinds", r"""
SELECT doc_id, pos, s, CASE WHEN starts_with(s, '# ') THEN 'h1' WHEN starts_with(s, '## ') THEN 'h2' WHEN starts_with(s, '### ') THEN 'h3'
  WHEN starts_with(s, '#### ') THEN 'h4' WHEN starts_with(s, '##### ') THEN 'h5' WHEN starts_with(s, '- ') THEN 'list'
  WHEN regexp_matches(s, '^\d+\.\s') THEN 'ordered_list' WHEN starts_with(s, '|') THEN 'table_row' ELSE 'body' END AS type FROM v_md_lines WHERE s <> ''""")


@query("txt_markdown_segments", r"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS seg, type,
  CASE WHEN type IN ('body', 'table_row') THEN s ELSE regexp_replace(s, '^(#{1,5} |- |\d+\.\s)', '') END AS content FROM v_md_kinds""")
def _(t):
    return unroll(t.markdown, ["doc_id"], C.markdown_segments("text"), "seg", {n: field(n) for n in ("type", "content")})


@query("txt_join_sentences", """
SELECT d.doc_id, coalesce(string_agg(l.s, ' ' ORDER BY l.pos) FILTER (l.s <> ''), '') AS text FROM documents d JOIN v_scan_lines l USING (doc_id) GROUP BY 1""")
def _(t):
    return rewritten(t.scans, C.join_sentences("text"))


@query("txt_clean_chars", rf"""
SELECT doc_id, translate({st("regexp_replace(regexp_replace(text, '(?m)^\\s*\\|\\s*$', '', 'g'), '[\\s\\p{Z}\\x{0b}\\x{85}]+', ' ', 'g')")}, '–—', '--') AS text FROM v_md""".replace("\\\\", "\\"))
def _(t):
    return rewritten(t.markdown, C.clean_chars("text"))


@query("txt_normalize_symbols", r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, 'a', '∧'), 'e', '∨'), '\bDEFINITION\b', 'Definition', 'g'),
  '\bOBJECTIVES\b', 'Objectives', 'g'), '([a-z]{10,})([A-Z][a-z]{4,})', '\1 \2', 'g') AS text
FROM (SELECT doc_id, text || ' DEFINITION OBJECTIVES XDEFINITION peradabanbaruAcuan ' || lang AS text FROM documents)""")
def _(t):
    tail = F.concat(F.col("text"), F.lit(" DEFINITION OBJECTIVES XDEFINITION peradabanbaruAcuan "), F.col("lang"))
    marked = F.translate(tail, "ae", "")
    return t.documents.select("doc_id", C.normalize_symbols(marked).alias("text"))


def prompted(t):
    """Every fourth line below a prompt; one letter in its slide font."""
    line = lambda x: strip(F.translate(x, "o", "ð"))
    return t._marked(lambda x, i: F.when(F.pmod(i, F.lit(4)) == 1, F.concat(F.lit(" Click to add title\n"), line(x))).otherwise(line(x)))


@query("txt_symbol_map_slides", rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM documents),
m AS (SELECT doc_id, j, {st("regexp_replace(replace(x, 'o', '•'), '[ \t]+', ' ', 'g')")} AS x FROM l)
SELECT d.doc_id, coalesce({st("string_agg(x, chr(10) ORDER BY j)")}, '') AS text FROM documents d LEFT JOIN m USING (doc_id) GROUP BY 1""".replace("\\\\", "\\"))
def _(t):
    return rewritten(prompted(t), C.slide_symbols("text"))


@query("txt_bullets", rf"""
SELECT doc_id, string_agg(CASE WHEN regexp_matches(s, '^[ØqnvlhÂ§ø·]\s+') AND length(s) > 2
   THEN repeat(' ', length(line) - length(regexp_replace(line, '^\s+', ''))) || '- ' || {st("regexp_replace(s, '^[ØqnvlhÂ§ø·]\\s+', '')")}
   ELSE line END, chr(10) ORDER BY pos) AS text FROM v_scan_lines GROUP BY 1""".replace("\\\\", "\\"))
def _(t):
    return rewritten(t.scans, C.bullets("text"))


def twice(x: str, pattern: str, new: str) -> str:
    """A look-behind said without one: its character is matched too, so neighbours need a second pass."""
    return f"regexp_replace(regexp_replace({x}, '{pattern}', '{new}', 'g'), '{pattern}', '{new}', 'g')"


@query("txt_punct_spacing", f"""
SELECT doc_id, {twice(twice("regexp_replace(text, '([,.]) ', '\\1', 'g')", "(^|[^A-Z])([,;:!])([A-Za-zÀ-ž])", "\\1\\2 \\3"),
                      "(^|[^A-Z0-9.])([.])([A-ZÀ-ž][a-z])", "\\1\\2 \\3")} AS text FROM documents""")
def _(t):
    glued = t.documents.select("doc_id", F.regexp_replace("text", r"([,.]) ", "$1").alias("text"))
    return rewritten(glued, C.punctuation_spacing("text"))


@query("txt_ocr_artifacts", rf"""
WITH k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM v_scan_lines
  WHERE NOT regexp_matches(s, '^([\d.]+\s+){{3,}}[\d.]+$') AND NOT (s <> '' AND NOT regexp_matches(s, '[\p{{L}}\p{{N}}]') AND length(s) <= 4) GROUP BY 1)
SELECT d.doc_id, coalesce({st("regexp_replace(regexp_replace(regexp_replace(regexp_replace(k.text, '\\n{3,}', chr(10) || chr(10), 'g'), '[|¦]{2,}', '|', 'g'), '_{4,}', '', 'g'), '[•·]', '-', 'g')")}, '') AS text
FROM documents d LEFT JOIN k USING (doc_id)""".replace("\\\\", "\\"))
def _(t):
    return rewritten(t.scans, C.ocr_artifacts("text"))


@query("txt_ocr_structure", rf"""
SELECT doc_id, string_agg(CASE
  WHEN regexp_matches(s, '^[A-Z][A-Z\s\-]{{3,}}$') AND length(s) < 80 THEN '## Section Alpha-Beta'
  WHEN length(regexp_replace(s, '[^\p{{Lu}}]', '', 'g')) / greatest(length(s), 1) > 0.7 AND length(s) BETWEEN 11 AND 79 THEN '### ' || s
  WHEN regexp_matches(s, '^[•\-*]') THEN '- ' || {st("substr(s, 2)")} ELSE s END, chr(10) ORDER BY pos) AS text FROM v_scan_lines GROUP BY 1""")
def _(t):
    return rewritten(t.scans, C.ocr_structure("text"))


@query("txt_dehyphenate", r"""
SELECT doc_id, regexp_replace(text, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') AS text
FROM (SELECT doc_id, replace(text, ' ', '-' || chr(10)) AS text FROM v_scans)""")
def _(t):
    broken = t.scans.select("doc_id", F.replace("text", F.lit(" "), F.lit("-\n")).alias("text"))
    return rewritten(broken, C.dehyphenate("text"))


@query("txt_heading_detect_slides", r"""
WITH x AS (SELECT doc_id, pos, CASE pos % 4 WHEN 2 THEN '2.1 ' || s ELSE s END AS s FROM v_scan_lines)
SELECT doc_id, pos, CASE WHEN s = '' THEN 0 WHEN regexp_matches(s, '^[0-9A-Fa-f\s,=+*/_()\-]+$') AND NOT regexp_matches(s, '[A-Za-z]{3,}') THEN 0
  WHEN regexp_matches(s, '[=+*<>⇒∈≤≥÷±≠]') THEN 0 WHEN regexp_matches(s, '(?i)^(Chapter|Topic|Section)\s+\d+') THEN CASE WHEN pos = 0 THEN 1 ELSE 2 END
  WHEN regexp_matches(s, '^\d+(\.\d+)+(\)|\.)?\s+[A-Za-z]') THEN 2
  WHEN regexp_matches(lower(s), '^(example|note|solution|exercise)') OR ends_with(s, ':') THEN 0
  WHEN lower(s) IN ('decimal', 'binary', 'octal', 'hexadecimal', 'hundreds', 'tens', 'ones', 'sign', 'magnitude', 'integer', 'fraction', 'topics') THEN 0
  WHEN len(regexp_extract_all(s, '[A-Za-z]+')) BETWEEN 2 AND 8 AND length(s) < 70 AND NOT regexp_matches(s, '[.,;:?!]$') AND regexp_matches(s, '\p{Lu}')
    AND (NOT regexp_matches(s, '\p{Ll}|\p{Lt}') OR (NOT regexp_matches(s, '[\p{Lu}\p{Ll}]\p{Lu}') AND NOT regexp_matches(s, '(^|[^\p{Lu}\p{Ll}])\p{Ll}')))
    THEN CASE WHEN pos = 0 THEN 1 ELSE 2 END ELSE 0 END AS level FROM x""")
def _(t):
    s = strip("line")
    line = F.when(F.pmod("pos", F.lit(4)) == 2, F.concat(F.lit("2.1 "), s)).otherwise(s)
    return exploded(t.scans).select("doc_id", "pos", C.slide_heading_level(line, F.col("pos") == 0).alias("level"))


CODE = r"""(length(s) BETWEEN 10 AND 500 AND NOT starts_with(s, '#') AND ((contains(s, '{{') AND contains(s, '}}') AND contains(s, ';'))
   OR (contains(s, '(') AND contains(s, ')') AND contains(s, ';') AND contains(s, '=') AND NOT starts_with(s, '='))
   OR (len(regexp_extract_all(s, '\b(public|private|class|void|static|System.out|println|import|def|return|function|const|let)\b')) >= 2
       AND ((contains(s, '(') AND contains(s, ')')) OR (contains(s, '{{') AND contains(s, '}}')) OR contains(s, ';')))
   OR (regexp_matches(s, '[→∨∧¬↔⊕≡⇒⇔]') AND length(s) < 150 AND NOT list_has_any(regexp_split_to_array(lower(s), '\s+'),
        ['denotes', 'that', 'the', 'has', 'it', 'meaning', 'is', 'dalam', 'yang', 'dan', 'untuk'])
       AND regexp_matches(s, '[pqr]\s*[∧∨→¬]|[¬∧∨→]\s*[pqr]'))))""".replace("{{", "{").replace("}}", "}")


def noisy(t):
    """Three of six lines below a line of noise or a label."""
    def shape(x, i):
        m = F.pmod(i, F.lit(6))
        return F.concat(F.when(m == 1, "MyCircle\n").when(m == 2, "Examples:\n").when(m == 3, "Animation\n").otherwise(""), x)
    return t.markdown.select("doc_id", F.array_join(F.transform(lines("text"), shape), "\n").alias("text"))


@query("txt_noise_label", rf"""
WITH m AS (SELECT doc_id, string_agg(CASE pos % 6 WHEN 1 THEN 'MyCircle' || chr(10) || line WHEN 2 THEN 'Examples:' || chr(10) || line WHEN 3 THEN 'Animation' || chr(10) || line ELSE line END,
  chr(10) ORDER BY pos) AS text FROM v_md_lines GROUP BY 1),
x AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos, {st("unnest(string_split(text, chr(10)))")} AS s FROM m)
SELECT doc_id, pos, s = '' OR lower(s) IN ('run', 'animation', 'no value', 'reference value') OR
    (regexp_matches(s, '^[A-Z][A-Za-z0-9]*([A-Z][A-Za-z0-9]*)+$') AND length(s) <= 40) AS is_noise,
  lower({st("regexp_replace(s, ':+$', '')")}) IN ('objective', 'question', 'example', 'examples', 'note', 'tip') AS is_label,
  s <> '' AND length(s) <= 90 AND NOT regexp_matches(s, '[.!?]$') AND NOT {CODE}
    AND NOT (regexp_matches(lower(s), '(^|[^\p{{L}}\p{{N}}_])(you|we|they|he|she|it)($|[^\p{{L}}\p{{N}}_])') AND len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) >= 4)
    AND len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) <= 9 AS is_heading FROM x""")
def _(t):
    rows = exploded(noisy(t)).select("doc_id", "pos", strip("line").alias("line"))
    return rows.select("doc_id", "pos", C.is_noise(F.col("line")).alias("is_noise"), C.is_label(F.col("line")).alias("is_label"),
                       C.is_probable_heading(F.col("line")).alias("is_heading"))


CODE_CASES = """CASE j % 5 WHEN 1 THEN 'public static void f(int a)' || chr(10) || x WHEN 2 THEN 'int y = g(' || x || '); The ' || x
   WHEN 3 THEN 'p ∧ q → r' || chr(10) || x ELSE x END"""


def code_lines(t):
    """Lines of code above some lines, and lines that begin as code and go on as prose."""
    def shape(x, i):
        m = F.pmod(i + 1, F.lit(5))
        return (F.when(m == 1, F.concat(F.lit("public static void f(int a)\n"), x)).when(m == 2, F.concat(F.lit("int y = g("), x, F.lit("); The "), x))
                .when(m == 3, F.concat(F.lit("p ∧ q → r\n"), x)).otherwise(x))
    return t._marked(shape)


view("v_coded", f"""
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: {CODE_CASES}), chr(10)) AS text FROM documents""")
view("v_code_lines", """
SELECT doc_id, unnest(string_split(text, chr(10))) AS s, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM v_coded""")


@query("txt_code_detect", f"SELECT doc_id, pos, {CODE} AS is_code FROM v_code_lines")
def _(t):
    return exploded(code_lines(t)).select("doc_id", "pos", C.looks_like_code(F.col("line")).alias("is_code"))


@query("txt_code_prose_split")
def _(t):
    return (exploded(code_lines(t)).select("doc_id", "pos", F.inline(C.code_prose_split(F.col("line")))))


@query("txt_title_detect", rf"""
WITH l AS (SELECT doc_id, pos, s, {st("regexp_replace(s, '^#+', '')")} AS b FROM v_md_lines WHERE pos < 15),
a AS (SELECT doc_id, arg_min(b, pos) AS b FROM l WHERE regexp_matches(b, '(?i)\b(Topic|Chapter)\s+\d+') GROUP BY 1),
h AS (SELECT doc_id, arg_min({st("substr(s, 3)")}, pos) AS h FROM l WHERE starts_with(s, '# ') AND NOT regexp_matches(s, '\((P\d+|C\d)\)') GROUP BY 1)
SELECT d.doc_id, coalesce(nullif({st("regexp_replace(regexp_replace(a.b, '(?i)^.*?\\b((?:Topic|Chapter)\\s+\\d+.*)$', '\\1'), '\\s*[-–—]?\\s*(AP\\..*|Dr\\.|Prof\\.).*$', '')")}, ''), a.b, h.h) AS title
FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN h USING (doc_id)""".replace("\\\\", "\\"))
def _(t):
    return t.markdown.select("doc_id", C.title_detect("text").alias("title"))


@query("txt_title_extract", rf"""
WITH l AS (SELECT doc_id, pos, regexp_replace(s, '^[# \t]+|[# \t]+$', '', 'g') AS s FROM v_md_lines),
c AS (SELECT doc_id, pos, s, length(s) AS n FROM l WHERE length(s) >= 4 AND NOT regexp_matches(s, '^\p{{Nd}}+$') AND NOT regexp_matches(s, '^(!\[|\[|http|/)')
  AND NOT ends_with(s, '?') AND regexp_replace(lower(regexp_extract(s, '^\S+')), '^[()\[\].,:;!?]+|[()\[\].,:;!?]+$', '', 'g') NOT IN ('what', 'how', 'why', 'when', 'which',
   'where', 'who', 'define', 'explain', 'list', 'name', 'describe', 'is', 'are', 'does', 'do', 'can', 'would', 'could', 'should'))
SELECT d.doc_id, coalesce(arg_max(s, pos) FILTER (n BETWEEN 10 AND 80), arg_min(s, pos) FILTER (n < 100)) AS title FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1""")
def _(t):
    return t.markdown.select("doc_id", C.title_extract("text").alias("title"))


@query("txt_title_first_h1", rf"""
SELECT d.doc_id, arg_min({st("substr(s, 3)")}, pos) FILTER (starts_with(s, '# ') AND {st("substr(s, 3)")} <> '') AS title FROM documents d JOIN v_md_lines l USING (doc_id) GROUP BY 1""")
def _(t):
    return t.markdown.select("doc_id", C.title_first_h1("text").alias("title"))


@query("txt_title_conversation", rf"""
WITH a AS (SELECT conv_id, turn, {st("text")} AS t FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, turn, CASE WHEN ends_with(t, '?') THEN {st("substr(t, 1, length(t) - 1)")} ELSE t END AS t FROM a),
c AS (SELECT conv_id, turn, upper(substr(t, 1, 1)) || substr(t, 2) AS t FROM b),
d AS (SELECT conv_id, turn, t, list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '') AS w FROM c),
e AS (SELECT conv_id, turn, CASE WHEN len(w) > 8 THEN array_to_string(w[1:8], ' ') || '…' ELSE t END AS t FROM d),
f AS (SELECT *, length(substr(t, 1, 77)) - instr(reverse(substr(t, 1, 77)), ' ') AS sp, instr(substr(t, 1, 77), ' ') > 0 AS has FROM e)
SELECT conv_id AS conversation_id, turn, CASE WHEN t = '' THEN 'New Conversation' WHEN length(t) > 80 THEN
  CASE WHEN has AND sp > 50 THEN substr(t, 1, sp) ELSE substr(t, 1, 77) END || '…' ELSE t END AS title FROM f""")
def _(t):
    asked = t.turns.filter(F.col("role") == "user")
    return asked.select("conversation_id", "turn", C.title_conversation("text").alias("title"))


@query("txt_topic_hint", r"""
WITH p AS (SELECT page_id AS id, regexp_replace(html, '<[^>]*>', '', 'g') AS x FROM pages)
SELECT id, CASE WHEN length(x) > 10 THEN array_to_string(list_filter(regexp_split_to_array(x, '[\s\p{Z}]+'), lambda w: length(w) > 2)[1:5], ' ') END AS topic,
  CASE WHEN length(x) > 10 THEN substr(x, 1, 200) END AS quote FROM p""")
def _(t):
    topic, quote = C.topic_hint("html")
    return t.pages.select(F.col("page_id").alias("id"), topic.alias("topic"), quote.alias("quote"))


view("v_some_h1", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '# ' || text ELSE text END AS text, 'Doc ' || doc_id AS title FROM documents")


@query("txt_enforce_h1", """
SELECT doc_id, CASE WHEN starts_with(text, '# ') OR contains(text, chr(10) || '# ') THEN text ELSE '# ' || title || chr(10) || chr(10) || text END AS text FROM v_some_h1""")
def _(t):
    text = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("# "), F.col("text"))).otherwise(F.col("text"))
    return rewritten(t.documents, C.enforce_h1(text, F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))))


@query("txt_secondary_h1", rf"""
WITH l AS (SELECT *, regexp_matches(line, '^#\s+') AS h FROM v_md_lines),
n AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l)
SELECT doc_id, {st("string_agg(line, chr(10) ORDER BY pos)")} AS text FROM n WHERE NOT h OR k = 1 GROUP BY 1""")
def _(t):
    return rewritten(t.markdown, C.only_first_h1("text"))


@query("txt_table_rows_to_md", """
SELECT doc_id AS table_id, '| id | name of |' || chr(10) || '| --- | ------- |' || chr(10) || string_agg('| ' || pos || ' | ' || CASE WHEN pos % 4 = 0 THEN '' ELSE s END || ' |', chr(10) ORDER BY pos) AS markdown
FROM v_doc_lines GROUP BY 1""")
def _(t):
    """One table per document, a row per line; the cells are an array of arrays in the document's row."""
    row = lambda x, i: F.array(i.cast("string"), F.when(F.pmod(i, F.lit(4)) != 0, x))
    head = F.array(F.array(F.lit("id"), F.lit(" name of ")))
    cells = F.concat(head, F.transform(lines("text"), row))
    return t.documents.select(F.col("doc_id").alias("table_id"), let(cells, C.table_markdown).alias("markdown"))


view("v_cells", """
SELECT doc_id, pos, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(line, '[^ ]', '', 'g') ELSE line END AS line FROM v_doc_lines""")


@query("txt_table_density", r"""
WITH rows AS (SELECT doc_id, pos, string_split(line, ' ') AS cells FROM v_cells),
c AS (SELECT doc_id, pos, len(cells) AS n, len(list_filter(cells, lambda x: trim(x) = '')) AS e FROM rows)
SELECT doc_id AS table_id, count(*) >= 2 AND max(n) >= 2 AND sum(e) / sum(n) <= 0.6 AS keep FROM c GROUP BY 1""")
def _(t):
    blank = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.regexp_replace("line", "[^ ]", "")).otherwise(F.col("line"))
    cells = exploded(t.documents).select("doc_id", F.split(blank, " ").alias("cells"))
    n, empty = F.size("cells"), F.size(F.filter("cells", lambda c: F.trim(c) == ""))
    rows = cells.select("doc_id", n.alias("n"), empty.alias("e"))
    return (rows.groupBy(F.col("doc_id").alias("table_id"))
            .agg(((F.count("*") >= 2) & (F.max("n") >= 2) & (F.sum("e") / F.sum("n") <= 0.6)).alias("keep")))


@query("txt_reasoning_scrub", rf"""
WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '```md' || chr(10) || text || chr(10) || '```' ELSE 'Here is the answer' || chr(10) || text || chr(10) || '=== end' END AS text FROM conversations),
l AS (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda y: NOT regexp_matches(y, '(?i)^\s*[\*\-]\s*Rule \d+:|^\s*[\*\-]\s*Segment \d+:|^\s*[\*\-]\s*Summary of|^\s*Here is the|^\s*===')) AS ls FROM x),
c AS (SELECT conv_id, turn, {st("array_to_string(ls, chr(10))")} AS c FROM l)
SELECT conv_id AS conversation_id, turn, {st("CASE WHEN starts_with(c, '```') THEN regexp_replace(regexp_replace(c, '^```[a-z]*\\n?', ''), '\\n?```$', '') ELSE c END")} AS text FROM c""".replace("\\\\", "\\"))
def _(t):
    wrapped = F.when(F.pmod("turn", F.lit(3)) == 0, F.concat(F.lit("```md\n"), F.col("text"), F.lit("\n```"))).otherwise(
        F.concat(F.lit("Here is the answer\n"), F.col("text"), F.lit("\n=== end")))
    return t.turns.select("conversation_id", "turn", C.reasoning_scrub(wrapped).alias("text"))


@query("txt_provider_error", r"""
WITH x AS (SELECT conv_id, turn, CASE WHEN turn = 3 THEN '[Gemini] Request TIMED OUT ' || text ELSE text END AS text FROM conversations)
SELECT conv_id AS conversation_id, turn, regexp_matches(lower(text), 'connection failed|failed after|provider error|timeout|timed out|\[gemini\]|\[huggingface\]|\[ollama\]') AS is_error FROM x""")
def _(t):
    text = F.when(F.col("turn") == 3, F.concat(F.lit("[Gemini] Request TIMED OUT "), F.col("text"))).otherwise(F.col("text"))
    return t.turns.select("conversation_id", "turn", C.provider_error(text).alias("is_error"))


@query("txt_figure_refs", r"""
SELECT doc_id, array_to_string(list_concat(regexp_extract_all(text, '(?i)as\s+shown\s+in\s+(?:the\s+)?(?:figure|diagram|illustration|chart|image)'),
  regexp_extract_all(text, '(?i)see\s+(?:figure|diagram|illustration|chart|image)'), regexp_extract_all(text, '(?i)in\s+(?:figure|diagram|illustration|chart|image)\s*\d*'),
  regexp_extract_all(text, '(?i)illustrated\s+(?:below|above|in)'), regexp_extract_all(text, '(?i)(?:figure|fig\.?)\s*\d+'),
  regexp_extract_all(text, '(?i)(?:diagram|chart|graph)\s*\d+'), regexp_extract_all(text, '(?i)(?:below|above|following)\s+(?:figure|diagram|illustration)')), '|') AS refs FROM v_md""")
def _(t):
    return t.markdown.select("doc_id", F.array_join(C.figure_refs("text"), "|").alias("refs"))


@query("txt_doc_stats", """
SELECT doc_id, CAST(count(*) AS INTEGER) AS total, CAST(count(*) FILTER (starts_with(type, 'h')) AS INTEGER) AS headings,
  CAST(count(*) FILTER (type IN ('list', 'ordered_list')) AS INTEGER) AS lists, CAST(count(*) FILTER (type = 'table_row') AS INTEGER) AS tables,
  CAST(count(*) FILTER (type = 'body') AS INTEGER) AS body FROM v_md_kinds GROUP BY 1""")
def _(t):
    return t.markdown.select("doc_id", F.inline(C.line_kinds("text")))


# -- rewrites with state --------------------------------------------------------------------------


@query("txt_segments", rf"""
WITH f AS (SELECT *, regexp_matches(s, '{BLACK}') OR length(s) < 3 AS b, regexp_matches(s, '(?i)^(Footer|Header):\s*|^\d+\s*$|^Page\s+\d+\s+of\s+\d+$|^www\..*$') AS hf FROM v_classes WHERE s <> ''),
g AS (SELECT *, b OR type IN ('h1', 'h2', 'table_row') AS cut FROM f),
r AS (SELECT *, sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY pos) * 2 + CASE WHEN cut THEN 0 ELSE 1 END AS run FROM g),
o AS (SELECT *, min(pos) FILTER (NOT hf) OVER (PARTITION BY doc_id, run) AS open_at FROM r),
k AS (SELECT * FROM o WHERE CASE WHEN cut THEN NOT b AND NOT hf AND confidence > 0 ELSE pos >= open_at END),
s AS (SELECT doc_id, run, arg_min(type, pos) AS type, arg_min(confidence, pos) AS confidence, string_agg(s, ' ' ORDER BY pos) AS text FROM k GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INTEGER) AS seg, type,
  translate({st("regexp_replace(regexp_replace(text, '(?m)^\\s*\\|\\s*$', '', 'g'), '[\\s\\p{Z}\\x{0b}\\x{85}]+', ' ', 'g')")}, '–—', '--') AS content, confidence FROM s""".replace("\\\\", "\\"))
def _(t):
    return unroll(t.markdown, ["doc_id"], R.segments("text"), "seg", {n: field(n) for n in ("type", "content", "confidence")})


@query("txt_validate_markdown")
def _(t):
    return rewritten(t.markdown, R.validate_markdown(F.col("text")))


@query("txt_slide_headings")
def _(t):
    return rewritten(t.slides, R.slide_headings("text"))


@query("txt_dup_fences", """
SELECT doc_id, 'intro' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || 'end' AS text FROM documents""")
def _(t):
    """Every fenced line group of the fixture is written twice, so half of the blocks must go."""
    block = F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```\n"))
    return rewritten(t.documents, R.duplicate_fences(F.concat(F.lit("intro\n"), block, block, F.lit("end"))))


@query("txt_table_overlap_dedup")
def _(t):
    def shape(x, i):
        return F.when(F.pmod(i, F.lit(3)) == 0, F.concat(F.lit("| "), F.replace(x, F.lit(" "), F.lit(" | ")), F.lit(" |\n"), F.substring(x, 1, 40))).otherwise(x)
    return rewritten(t._marked(shape), R.table_overlap("text"))


@query("txt_final_answer", rf"""
SELECT conv_id AS conversation_id, turn, CASE turn % 6 WHEN 0 THEN 'yes'
  WHEN 4 THEN CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 25 AND regexp_matches(trim(x), '^\p{{Lu}}') AND NOT ends_with(trim(x), ':'))) > 0
    THEN {st("text")} ELSE {st("'Wait, let me see' || chr(10) || text")} END ELSE {st("text")} END AS answer FROM conversations""".replace("\\\\", "\\"))
def _(t):
    m, body = F.pmod("turn", F.lit(6)), F.col("text")
    around = lambda before, after="": F.concat(F.lit(before), body, F.lit(after))
    text = (F.when(m == 0, '{"final_answer": "yes", "k": 1}')
            .when(m == 1, around("<think>plan</think> text before <FINAL_ANSWER>", "</FINAL_ANSWER>"))
            .when(m == 2, around("===START=== a ===END=== ===START===", "===END===")).when(m == 3, around("Answer: "))
            .when(m == 4, around("Wait, let me see\n")).otherwise(body))
    return t.turns.select("conversation_id", "turn", R.final_answer(text).alias("answer"))


@query("txt_json_recover", """
SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN props ELSE '[' || user_id || ']' END AS json FROM events""")
def _(t):
    m = F.pmod("event_id", F.lit(3))
    raw = (F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("Here {you} go:\n```json\n"), F.col("props"), F.lit("\n```")))
           .otherwise(F.concat(F.lit("see ["), F.lit("x and ["), F.col("user_id").cast("string"), F.lit("] done"))))
    return t.events.select(F.col("event_id").alias("id"), R.json_recover(raw).alias("json"))
