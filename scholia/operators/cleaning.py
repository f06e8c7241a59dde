"""Corpus cleaning: predicates and rewrites over lines held in the document's row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.text import (any_of, is_title, is_upper, joined, keep_lines, last_where, let, lines, map_lines, replace_all,
                                    strip, tokens, words)

# Boilerplate lines of extracted notes.
BLACKLIST = [
    r"^©.*$", r"^[©®™].*$", r"^\s*Page\s+\d+\s*$", r"^\s*Slide\s+\d+\s*$", r"^\s*\d+\s*$", r"^www\..+\.\w+$",
    r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", r"^(Confidential|Proprietary|Internal|Draft|Confidential Information)$",
    r"^(For Official Use|Restricted|Private|Classified)$",
]
HEADER_FOOTER = [r"^(Footer|Header):\s*", r"^\d+\s*$", r"^Page\s+\d+\s+of\s+\d+$", r"^www\..*$"]
LIST_ITEM = [r"^[\s]*[-•*]\s+", r"^[\s]*\d+\.\s+", r"^[\s]*[a-z]\)\s+"]
# Slide footers, copyright notices and publisher marks.
SLIDE_FOOTERS = [
    r"^\s*©\s*\d{4}.*", r"^>\s*©\s*\d{4}.*", r"^.*All Rights Reserved.*", r"^.*May not be copied, scanned, or duplicated.*",
    r"^.*password-protected website for classroom.*", r"^\s*¢\s*[»\>]\s*CENGAGE.*", r"^\s*[’‘*®©]?\s*Learning[’‘']?\s*$",
    r"^\s*ky a Learning\s*$", r"^\s*\d+\s*$", r"^\s*\d+\s+©.*", r"^FIGURE\s+\d+-\d+\s+.*\(cont’d\.\)$",
]
LONE_MARKS = ["-", "—", "–", "*", "•"]
PICTURE_START, PICTURE_END = "<!-- Start of picture text -->", "<!-- End of picture text -->"
# Words and signs that make a picture's text code.
PICTURE_WORDS = ["cout", "cin", "int", "=", ";", "{", "}"]


def ci(patterns: list[str]) -> list[str]:
    return [f"(?i){p}" for p in patterns]


def is_blacklisted(line: Column) -> Column:
    s = strip(line)
    return (F.length(s) < 3) | any_of(s, ci(BLACKLIST))


def is_header_footer(line: Column) -> Column:
    return any_of(strip(line), ci(HEADER_FOOTER))


def is_list_item(line: Column) -> Column:
    return any_of(strip(line), LIST_ITEM)


def slide_boilerplate(text: Column | str) -> Column:
    """Footers, lone bullets and the junk inside picture-text regions.

    A region spans its start and end marks; regions are cut out of the text by one pattern, so
    no state runs along the lines. Kept region text must be long enough or look like code.
    """
    footer = lambda x: any_of(strip(x), ci(SLIDE_FOOTERS))
    outside = lambda x: ~strip(x).isin(LONE_MARKS) & ~footer(x)
    def picture(body: Column) -> Column:
        kept = strip(joined(F.filter(lines(F.replace(body, F.lit("<br>"), F.lit("\n"))), lambda y: ~footer(y))))
        coded = F.lit(False)
        for w in PICTURE_WORDS:
            coded = coded | kept.contains(w)
        bad = (kept == "") | ((F.length(kept) < 15) & ~coded) | footer(kept)
        return F.when(~bad, kept)
    # Pieces between marked regions; every piece but the first opens with region text and its end mark.
    source = F.col(text) if isinstance(text, str) else text
    blocks = F.split(source, rf"(?m)^.*{PICTURE_START}.*$\n?")
    def piece(p: Column, i: Column) -> Column:
        halves = F.split(p, rf"(?m)^.*{PICTURE_END}.*$\n?", 2)
        body = F.when((i > 0) & (F.size(halves) > 1), F.get(halves, F.lit(1))).when(i > 0, F.lit(None)).otherwise(p)
        rest = F.filter(lines(F.regexp_replace(body, r"\n\z", "")), lambda x: outside(x))
        pic = F.when((i > 0) & (F.size(halves) > 1), picture(F.regexp_replace(F.get(halves, F.lit(0)), r"\n\z", "")))
        kept = F.when(F.coalesce(body, F.lit("")) == "", F.array().cast("array<string>")).otherwise(rest)
        return F.concat(F.array_compact(F.array(pic)), kept)
    return joined(F.flatten(F.transform(blocks, piece)))


def line_type(line: Column, s: Column, pos: Column, total: Column, mean: Column) -> Column:
    """(type, confidence) from table marks, length against the mean, place and pattern; ``s`` is the stripped line, bound once."""
    n = F.length(s)
    rel = pos / F.greatest(total, F.lit(1))
    row = s.startswith("|") & (F.regexp_count(s, F.lit(r"\|")) >= 2)
    rule = s.rlike(r"^\s*\|\s*[-:]+\s*(\|\s*[-:]+\s*)*\|?\s*$")
    def out(kind: str, conf: float) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(conf).alias("confidence"))
    return (F.when(row & rule, out("table_row", 0.0)).when(row, out("table_row", 0.95))
            .when(n < mean * 0.3, out("h1", 0.85)).when(n < mean * 0.5, out("h2", 0.80))
            .when((rel < 0.1) & (n < mean * 0.6), out("h1", 0.80)).when((rel < 0.2) & (n < mean * 0.7), out("h2", 0.75))
            .when(is_upper(s) & (n > 3) & (n < mean * 0.6), out("h1", 0.90)).when(is_upper(s) & (n > 3), out("h2", 0.80))
            .when(s.rlike(r"^(\d+\.?\s+)?[A-Z][^.!?]*$") & (n < mean * 0.7), out("h2", 0.75))
            .when(is_list_item(line), out("list", 0.85)).otherwise(out("body", 0.60)))


def classified_lines(text: Column | str) -> Column:
    """Array of (pos, line, type, confidence) of one document."""
    def all_lines(ls: Column, mean: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            told = lambda s, v: F.struct(i.alias("pos"), s.alias("line"), v["type"].alias("type"), v["confidence"].alias("confidence"))
            return let(strip(x), lambda s: let(line_type(x, s, i, F.size(ls), mean), lambda v: told(s, v)))
        return F.transform(ls, one)
    def mean_of(ls: Column) -> Column:
        return F.aggregate(ls, F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / F.size(ls)
    return let(lines(text), lambda ls: let(mean_of(ls), lambda m: all_lines(ls, m)))


# The marks of each kind of line.
MARKDOWN_MARKS = [("h1", r"^# "), ("h2", r"^## "), ("h3", r"^### "), ("h4", r"^#### "), ("h5", r"^##### "), ("list", r"^- "),
                  ("ordered_list", r"^\d+\.\s"), ("table_row", r"^(?=\|)")]


def markdown_segments(text: Column | str, drop_rules: bool = False) -> Column:
    """Array of (type, content) of non-blank Markdown lines; rule lines are dropped on request."""
    def one(s: Column) -> Column:
        told = F.struct(F.lit("body").alias("type"), s.alias("content"))
        for name, mark in reversed(MARKDOWN_MARKS):
            told = F.when(s.rlike(mark), F.struct(F.lit(name).alias("type"), F.regexp_replace(s, mark, "").alias("content"))).otherwise(told)
        return told
    # Stripped once a line: inside a lambda an expression is worked out again wherever it stands.
    kept = F.filter(F.transform(lines(text), strip), lambda s: s != "")
    if drop_rules:
        kept = F.filter(kept, lambda s: ~s.startswith("---"))
    return F.transform(kept, one)


def join_sentences(text: Column | str) -> Column:
    return joined(F.filter(F.transform(lines(text), lambda x: strip(x)), lambda x: x != ""), " ")


def clean_chars(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    c = F.regexp_replace(c, r"(?m)^\s*\|\s*$", "")
    return F.translate(strip(F.regexp_replace(c, r"(?U)\s+", " ")), "–—", "--")


# Private-use glyphs of the Symbol font and the characters they stand for.
SYMBOLS = {
    "\uf0d8": "¬", "\uf0da": "∨", "\uf0d9": "∧", "\uf0ae": "→", "\uf0de": "⇒", "\uf0db": "⇔", "\uf0ba": "≡", "\uf0c5": "⊕",
    "\uf0ab": "↔", "\uf05c": "∴", "\uf051": "∵", "\uf022": "∀", "\uf024": "∃", "\uf0ce": "∈", "\uf0cf": "∉", "\uf0c8": "∪",
    "\uf0c7": "∩", "\uf0cc": "⊂", "\uf0cd": "⊆", "\uf0cb": "⊋", "\uf0ca": "⊇", "\uf0c6": "∅", "\uf0d6": "√", "\uf0a5": "∞",
    "\uf0b9": "≠", "\uf0bb": "≈", "\uf0a3": "≤", "\uf0b3": "≥",
}
# Glyphs of old slide decks.
SLIDE_SYMBOLS = {
    "\uf0ce": "∈", "\uf0de": "⇒", "\uf0a8": "•", "\uf0b4": "×", "\uf0b8": "÷", "\uf0b1": "±", "\uf0b9": "≠", "\uf0a3": "≤",
    "\uf0b3": "≥", "\x0b": "\n", "\r\n": "\n", "\r": "\n", "ð": "•",
}
# Texts of empty slide placeholders.
PLACEHOLDERS = ["click to edit master title style", "click to edit master text styles", "second level", "third level", "fourth level",
                "fifth level", "click to edit master subtitle style", "click to add title", "click to add subtitle", "click to add text",
                "title text", "subtitle text", "title area for autorayouts", "object area for autorayouts",
                "subtitle area for autorayouts", "<date/time>", "<footer>", "<header>", "<#>", "*"]


def normalize_symbols(text: Column | str) -> Column:
    c = replace_all(text, SYMBOLS)
    c = F.regexp_replace(c, r"\bDEFINITION\b", "Definition")
    c = F.regexp_replace(c, r"\bOBJECTIVES\b", "Objectives")
    return F.regexp_replace(c, r"([a-z]{10,})([A-Z][a-z]{4,})", "$1 $2")


def slide_symbols(text: Column | str) -> Column:
    """Glyphs mapped, blanks collapsed, placeholder lines dropped."""
    c = strip(F.regexp_replace(replace_all(text, SLIDE_SYMBOLS), r"[ \t]+", " "))
    return keep_lines(c, lambda x: ~F.lower(strip(x)).isin(PLACEHOLDERS))


BULLET = r"^[ØqnvlhÂ§ø·]\s+"


def bullets(text: Column | str) -> Column:
    def one(x: Column) -> Column:
        s = strip(x)
        indent = F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))
        return F.when(s.rlike(BULLET) & (F.length(s) > 2),
                      F.concat(F.repeat(F.lit(" "), indent), F.lit("- "), strip(F.regexp_replace(s, BULLET, "")))).otherwise(x)
    return map_lines(text, one)


def punctuation_spacing(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    c = F.regexp_replace(c, r"(?<![A-Z])([,;:!])([A-Za-zÀ-ž])", "$1 $2")
    return F.regexp_replace(c, r"(?<![A-Z0-9\.])(\.)([A-ZÀ-ž][a-z])", "$1 $2")


def ocr_artifacts(text: Column | str) -> Column:
    axis = lambda s: s.rlike(r"^([\d.]+\s+){3,}[\d.]+$")
    noise = lambda s: (s != "") & ~s.rlike(r"[\p{L}\p{N}]") & (F.length(s) <= 4)
    c = keep_lines(text, lambda x: ~axis(strip(x)) & ~noise(strip(x)))
    for pattern, new in [(r"\n{3,}", "\n\n"), (r"[|¦]{2,}", "|"), (r"_{4,}", ""), (r"[•·]", "-")]:
        c = F.regexp_replace(c, pattern, new)
    return strip(c)


def ocr_structure(text: Column | str) -> Column:
    def one(x: Column) -> Column:
        s = strip(x)
        n = F.length(s)
        capitals = F.length(F.regexp_replace(s, r"[^\p{Lu}]", "")) / F.greatest(n, F.lit(1))
        titled = F.array_join(F.transform(F.split(s, "-"), lambda p: F.initcap(p)), "-")
        return (F.when(s.rlike(r"^[A-Z][A-Z\s\-]{3,}$") & (n < 80), F.concat(F.lit("## "), titled))
                .when((capitals > 0.7) & (n > 10) & (n < 80), F.concat(F.lit("### "), s))
                .when(s.rlike(r"^[•\-*]"), F.concat(F.lit("- "), strip(F.regexp_replace(s, r"^.", "")))).otherwise(s))
    return map_lines(text, one)


def dehyphenate(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(c, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")


# Single nouns of table headers that are never titles.
TABLE_NOUNS = ["decimal", "binary", "octal", "hexadecimal", "hundreds", "tens", "ones", "sign", "magnitude", "integer", "fraction", "topics"]


def slide_heading_level(line: Column, at_start: Column) -> Column:
    """0 for text, 1 for the document's title, 2 for a section."""
    s = strip(line)
    low = F.lower(s)
    top = F.when(at_start, 1).otherwise(2)
    n_words = F.regexp_count(s, F.lit("[A-Za-z]+"))
    label = low.startswith("example") | low.startswith("note") | low.startswith("solution") | low.startswith("exercise") | s.endswith(":")
    short = n_words.between(2, 8) & (F.length(s) < 70) & ~s.rlike(r"[.,;:?!]$")
    return (F.when(s == "", 0)
            .when(s.rlike(r"^[0-9A-Fa-f\s,=+*/_()\-]+$") & ~s.rlike(r"[A-Za-z]{3,}"), 0)
            .when(s.rlike(r"[=+*<>⇒∈≤≥÷±≠]"), 0)
            .when(s.rlike(r"(?i)^(Chapter|Topic|Section)\s+\d+"), top)
            .when(s.rlike(r"^\d+(\.\d+)+(\)|\.)?\s+[A-Za-z]"), 2)
            .when(label | low.isin(TABLE_NOUNS), 0)
            .when(short & (is_upper(s) | is_title(s)), top).otherwise(0))


# Demo captions and label words of slides, code words, logic signs and sentence words.
NOISE_EXACT = ["run", "animation", "no value", "reference value"]
LABELS = ["objective", "question", "example", "examples", "note", "tip"]
CODE_WORDS = ["public", "private", "class", "void", "static", "System.out", "println", "import", "def", "return", "function", "const", "let"]
LOGIC = "→∨∧¬↔⊕≡⇒⇔"
SENTENCE_WORDS = ["denotes", "that", "the", "has", "it", "meaning", "is", "dalam", "yang", "dan", "untuk"]


#: Characters of the longest line that can be code.
CODE_SIZE = 500


def looks_like_code(t: Column) -> Column:
    """Brackets with terminators, two code words with syntax, or a formula."""
    brackets, braces, semi = t.contains("(") & t.contains(")"), t.contains("{") & t.contains("}"), t.contains(";")
    assign = t.contains("=") & ~t.startswith("=")
    keywords = F.regexp_count(t, F.lit(r"\b(" + "|".join(CODE_WORDS) + r")\b")) >= 2
    formula = (t.rlike(f"[{LOGIC}]") & (F.length(t) < 150) & ~F.arrays_overlap(words(F.lower(t)), F.array(*map(F.lit, SENTENCE_WORDS)))
               & t.rlike(r"[pqr]\s*[∧∨→¬]|[¬∧∨→]\s*[pqr]"))
    return (F.length(t).between(10, CODE_SIZE) & ~t.startswith("#")
            & ((braces & semi) | (brackets & semi & assign) | (keywords & (brackets | braces | semi)) | formula))


def is_noise(line: Column) -> Column:
    s = strip(line)
    camel = s.rlike(r"^[A-Z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*)+$") & (F.length(s) <= 40)
    return (s == "") | F.lower(s).isin(NOISE_EXACT) | camel


def is_label(line: Column) -> Column:
    return F.lower(strip(F.regexp_replace(strip(line), ":+$", ""))).isin(LABELS)


def is_probable_heading(line: Column) -> Column:
    s = strip(line)
    n = F.size(words(s))
    pronoun = F.lower(s).rlike(r"(?<![\p{L}\p{N}_])(?:you|we|they|he|she|it)(?![\p{L}\p{N}_])") & (n >= 4)
    return (s != "") & (F.length(s) <= 90) & ~s.rlike(r"[.!?]$") & ~looks_like_code(s) & ~pronoun & (n <= 9)


# Words that open an explaining sentence.
PROSE_STARTS = ["An ", "A ", "The ", "For ", "If ", "This ", "That ", "These ", "Those ", "As ", "It ", "More ", "Java "]


def code_prose_split(line: Column) -> Column:
    """(code, prose) at the last ``; `` with code on its left and prose on its right; NULL if none."""
    numbered = r"^\s*\d+\.\s+(?=(?:public|private|protected|class|interface|enum)\b)"
    def split_at(s: Column) -> Column:
        # Longer code is none, so the cuts lie in the first characters and are found there by one scan.
        pieces = F.split(s.substr(F.lit(1), F.lit(CODE_SIZE + 1)), r"(?<=;)(?=\s)")
        def halved(p: Column) -> Column:
            codes = F.transform(F.slice(p, 1, F.size(p) - 1), lambda _, i: F.array_join(F.slice(p, F.lit(1), i + 1), ""))
            halves = F.transform(codes, lambda c: F.struct(c.alias("code"), strip(s.substr(F.length(c) + 1, F.length(s))).alias("prose")))
            good = F.filter(halves, lambda h: h["prose"].rlike("^(" + "|".join(PROSE_STARTS) + ")")
                            & looks_like_code(h["code"]) & ~looks_like_code(h["prose"]))
            return F.transform(F.slice(F.reverse(good), 1, 1), lambda h: F.struct(
                F.regexp_replace(h["code"], numbered, "").alias("code"), h["prose"].alias("prose")))
        return F.when(F.length(s) >= 40, let(pieces, halved))
    return let(strip(line), split_at)


def title_detect(text: Column | str) -> Column:
    """``Topic N`` or ``Chapter N`` in the first 15 lines, else the first H1 that is no objective."""
    head = F.slice(lines(text), 1, 15)
    bare = F.transform(head, lambda x: strip(F.regexp_replace(strip(x), "^#+", "")))
    topic = F.try_element_at(F.filter(bare, lambda x: x.rlike(r"(?i)\b(Topic|Chapter)\s+\d+")), F.lit(1))
    cut = F.regexp_replace(topic, r"(?i)^.*?\b((?:Topic|Chapter)\s+\d+.*)$", "$1")
    cut = strip(F.regexp_replace(cut, r"\s*[-–—]?\s*(AP\..*|Dr\.|Prof\.).*$", ""))
    h1 = F.transform(F.filter(head, lambda x: strip(x).startswith("# ")), lambda x: strip(F.regexp_replace(strip(x), "^# ", "")))
    plain = F.try_element_at(F.filter(h1, lambda x: ~x.rlike(r"\((P\d+|C\d)\)")), F.lit(1))
    return F.coalesce(F.nullif(cut, F.lit("")), topic, plain)


# Words that open a question or task.
QUESTION_WORDS = ["what", "how", "why", "when", "which", "where", "who", "define", "explain", "list", "name", "describe", "is", "are",
                  "does", "do", "can", "would", "could", "should"]


def title_extract(text: Column | str) -> Column:
    """Last candidate of 10-80 characters, else the first one under 100.

    The first short-enough line only counts while no candidate was seen, so a 10-80 line always wins.
    """
    bare = F.transform(lines(strip(text)), lambda x: F.regexp_replace(strip(x), r"^[# \t]+|[# \t]+$", ""))
    def ok(s: Column) -> Column:
        first = F.regexp_replace(F.lower(F.coalesce(F.try_element_at(words(s), F.lit(1)), F.lit(""))), r"^[()\[\].,:;!?]+|[()\[\].,:;!?]+$", "")
        return ((F.length(s) >= 4) & ~s.rlike(r"^\p{Nd}+$") & ~s.rlike(r"^(!\[|\[|http|/)") & ~s.endswith("?") & ~first.isin(QUESTION_WORDS))
    cand = F.filter(bare, ok)
    return F.coalesce(last_where(cand, lambda s: F.length(s).between(10, 80)),
                      F.try_element_at(F.filter(cand, lambda s: F.length(s) < 100), F.lit(1)))


def title_first_h1(text: Column | str) -> Column:
    heads = F.transform(F.filter(lines(text), lambda x: strip(x).startswith("# ")), lambda x: strip(F.regexp_replace(strip(x), "^# ", "")))
    return F.try_element_at(F.filter(heads, lambda h: h != ""), F.lit(1))


def title_conversation(question: Column | str) -> Column:
    """At most 8 words and 80 characters, first letter upper case, no closing question mark."""
    t = strip(question)
    t = F.when(t.endswith("?"), strip(F.regexp_replace(t, r"\?$", ""))).otherwise(t)
    t = F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)))
    w = words(t)
    t = F.when(F.size(w) > 8, F.concat(joined(F.slice(w, 1, 8), " "), F.lit("…"))).otherwise(t)
    cut = F.substring(t, 1, 77)
    space = F.length(cut) - F.locate(" ", F.reverse(cut))  # 0-based place of the last blank
    short = F.when((F.locate(" ", F.reverse(cut)) > 0) & (space > 50), cut.substr(F.lit(1), space)).otherwise(cut)
    t = F.when(F.length(t) > 80, F.concat(short, F.lit("…"))).otherwise(t)
    return F.when(t == "", "New Conversation").otherwise(t)


def topic_hint(text: Column | str) -> tuple[Column, Column]:
    plain = F.regexp_replace(F.col(text) if isinstance(text, str) else text, "<[^>]*>", "")
    topic = joined(F.slice(F.filter(words(plain), lambda w: F.length(w) > 2), 1, 5), " ")
    long = F.length(plain) > 10
    return F.when(long, topic), F.when(long, F.substring(plain, 1, 200))


def enforce_h1(text: Column, title: Column) -> Column:
    has = F.exists(lines(text), lambda x: x.startswith("# "))
    return F.when(has, text).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), text))


def only_first_h1(text: Column | str) -> Column:
    """Later H1 lines are dropped."""
    h1 = lambda x: x.rlike(r"^#\s+")
    def rest(ls: Column, first: Column) -> Column:
        return strip(joined(F.filter(ls, lambda x, i: ~h1(x) | (i + 1 == first))))
    return let(lines(text), lambda ls: let(F.array_position(F.transform(ls, h1), True), lambda first: rest(ls, first)))


def reasoning_scrub(text: Column | str) -> Column:
    marks = [r"^\s*[\*\-]\s*Rule \d+:", r"^\s*[\*\-]\s*Segment \d+:", r"^\s*[\*\-]\s*Summary of", r"^\s*Here is the", r"^\s*==="]
    c = strip(keep_lines(text, lambda x: ~any_of(x, ci(marks))))
    bare = F.regexp_replace(F.regexp_replace(c, r"\A```[a-z]*\n?", ""), r"\n?```\z", "")
    return strip(F.when(c.startswith("```"), bare).otherwise(c))


# Parts of the messages of failing providers.
PROVIDER_ERRORS = ["connection failed", "failed after", "provider error", "timeout", "timed out", "[gemini]", "[huggingface]", "[ollama]"]


def provider_error(text: Column | str) -> Column:
    low = F.lower(strip(text))
    out = F.lit(False)
    for m in PROVIDER_ERRORS:
        out = out | low.contains(m)
    return F.coalesce(out, F.lit(False))


# Ways a text refers to a figure.
FIGURE_REFS = [
    r"as\s+shown\s+in\s+(?:the\s+)?(?:figure|diagram|illustration|chart|image)", r"see\s+(?:figure|diagram|illustration|chart|image)",
    r"in\s+(?:figure|diagram|illustration|chart|image)\s*\d*", r"illustrated\s+(?:below|above|in)", r"(?:figure|fig\.?)\s*\d+",
    r"(?:diagram|chart|graph)\s*\d+", r"(?:below|above|following)\s+(?:figure|diagram|illustration)",
]


def figure_refs(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(f"(?i){p}"), F.lit(0)) for p in FIGURE_REFS]))


def line_kinds(text: Column | str) -> Column:
    """Array of one struct, to be inlined: total, headings, lists, tables and body, counted from one pass over the lines."""
    def counts(kinds: Column) -> Column:
        n = lambda test: F.size(F.filter(kinds, test))
        return F.struct(F.size(kinds).alias("total"), n(lambda k: k.startswith("h")).alias("headings"), n(lambda k: k.isin("list", "ordered_list")).alias("lists"),
                        n(lambda k: k == "table_row").alias("tables"), n(lambda k: k == "body").alias("body"))
    return F.transform(F.array(F.transform(markdown_segments(text), lambda s: s["type"])), counts)


def strip_images(text: Column | str) -> Column:
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"!\[.*?\]\(.*?\)", "")


def table_markdown(cells: Column) -> Column:
    """Rows of cells to a Markdown table; the first row is the header, NULL is empty."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))
    head = F.element_at(cells, 1)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda c: F.repeat(F.lit("-"), F.greatest(
        F.lit(3), F.length(strip(F.coalesce(c, F.lit(""))))))), " | "), F.lit(" |"))
    body = F.transform(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), row)
    return F.array_join(F.concat(F.array(row(head), rule), body), "\n")


def key_words(text: Column | str) -> Column:
    return tokens(F.lower(F.col(text) if isinstance(text, str) else text))
