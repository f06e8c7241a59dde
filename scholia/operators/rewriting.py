"""Rewrites that depend on the lines before: folds over the lines of one row, with a small state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import Folded, any_of, fold_out, joined, last_where, let, lines, running_count, runs_of, strip, words
from scholia.operators import cleaning as C

TEXTS = "array<string>"


def no_text() -> Column:
    return F.array().cast(TEXTS)


def some(test: Column, *items: Column) -> Column:
    return F.when(test, F.array(*items)).otherwise(no_text())


def segments(text: Column | str) -> Column:
    """Array of (type, content, confidence) of a page.

    Headings, table rows and blacklisted lines stand alone and end a paragraph; between them a
    paragraph opens at its first line that is no page header or footer and takes all lines after it.
    """
    alone = lambda x: C.is_blacklisted(x["line"]) | x["type"].isin("h1", "h2", "table_row")
    filled = lambda x: x["line"] != ""
    def build(run: Column, at: Column) -> Column:
        first = F.get(run, F.lit(0))
        own = F.filter(run, lambda x: ~C.is_blacklisted(x["line"]) & ~C.is_header_footer(x["line"]) & (x["confidence"] > 0))
        body = F.filter(run, filled)
        def paragraph(ls: Column) -> Column:
            open_at = F.array_position(F.transform(ls, lambda x: ~C.is_header_footer(x["line"])), True)
            return F.when(open_at > 0, F.slice(ls, open_at.cast("int"), F.size(ls)))
        def segment(ls: Column) -> Column:
            head = F.get(ls, F.lit(0))
            content = C.clean_chars(joined(F.transform(ls, lambda x: x["line"]), " "))
            return F.when(F.size(ls) > 0, F.struct(head["type"].alias("type"), content.alias("content"), head["confidence"].alias("confidence")))
        kept = F.when(alone(first) & filled(first), own).when(F.size(body) > 0, let(body, paragraph))
        return let(kept, segment)
    marked = F.filter(C.classified_lines(text), filled)
    return F.array_compact(let(marked, lambda m: F.when(F.size(m) > 0, runs_of(m, lambda p, x: alone(p) | alone(x), build)).otherwise(
        F.array(F.lit(None).cast("struct<type:string,content:string,confidence:double>")))))


def validate_markdown(text: Column) -> Column:
    """Fences balanced, headings repaired, one H1, a title on top, no long runs of blank lines."""
    def told(line: Column) -> Column:
        """What the fold asks of a line, worked out once: there an expression would be worked out again wherever it stands."""
        marks = lambda s: F.struct(
            line.alias("line"), s.alias("s"), s.startswith("```").alias("fence"), s.rlike(r"^#{1,6}\s+").alias("head"),
            F.when(s.startswith("#"), strip(F.regexp_replace(s, "^#+", ""))).alias("content"), s.rlike(r"^(- |1\. )").alias("listed"),
            (s.rlike(r"(?i)^#{1,3}\s+End of\s+(Topic|Chapter|Note)") | line.rlike(r"^#{1,6}\s*$")).alias("ending"))
        return let(strip(line), marks)

    def run(xs: Column, title: Column) -> Column:
        has_topic = F.coalesce(F.exists(xs, lambda x: x["s"].startswith(F.concat(F.lit("# "), title))), F.lit(False))
        no = F.lit(False)
        zero = dict(code=no, h1=no, listed=no, blank=no, topic=has_topic)
        def add(a: Folded, x: Column) -> tuple[dict[str, Column], Column]:
            line, s, fence, head, content, ending = (x[n] for n in ("line", "s", "fence", "head", "content", "ending"))
            broken = a["code"] & head
            glued = head & a["listed"] & ~a["blank"]
            top = head & s.rlike(r"^#\s") & ~ending
            objective = content.rlike(r"\((P\d+|C\d)\)")
            swap = top & ~a["h1"] & title.isNotNull() & ~a["topic"] & (objective | ~F.lower(content).contains(F.lower(title)))
            new = F.when(top & a["h1"], F.concat(F.lit("## "), content)).when(swap, F.concat(F.lit("# "), title)).otherwise(line)
            plain = ~fence & ~glued & ~ending
            out = F.concat(some(~fence & broken, F.lit("```")), some(fence, line),
                           some(~fence & glued, F.concat(F.lit("**"), content, F.lit("**")), F.lit("")), some(plain, new))
            return dict(code=F.when(fence, ~a["code"]).otherwise(a["code"] & ~broken),
                        h1=a["h1"] | (plain & top), listed=F.when(fence, a["listed"]).otherwise(~glued & x["listed"]),
                        blank=F.when(fence, a["blank"]).otherwise(~glued & (s == "")), topic=a["topic"] | (plain & swap)), out
        def close(a: Column, out: Column) -> Column:
            lead = some(title.isNotNull() & ~a["topic"] & ~a["h1"], F.concat(F.lit("# "), title), F.lit(""))
            return F.concat(lead, out, some(a["code"], F.lit("```")))
        even = F.concat(xs, F.transform(some(F.size(F.filter(xs, lambda x: x["fence"])) % 2 != 0, F.lit("```")), told))
        return F.regexp_replace(strip(joined(fold_out(even, zero, add, "string", close))), r"\n{4,}", "\n\n\n")
    once = F.struct(F.transform(lines(text), told).alias("l"), C.title_detect(text).alias("t"))
    return F.when(text == "", text).otherwise(let(once, lambda v: run(v["l"], v["t"])))


def slide_headings(text: Column | str) -> Column:
    """Continuation headings merged, a chapter joined with its subtitle, levels put in order."""
    # Fixed value: how a continued slide says so.
    pattern = r"(?i)^(#{1,4}\s+)(.*?)(?:\s*[\(\[]\s*(?:\d+\s+of\s+\d+|part\s+\d+|cont\.?(?:inued)?)\s*[\)\]])\s*$"

    def continued(ls: Column) -> Column:
        def add(a: Folded, x: Column) -> tuple[dict[str, Column], Column]:
            cont = x.rlike(pattern)
            name = F.concat(F.regexp_extract(x, pattern, 1), strip(F.regexp_extract(x, pattern, 2)))
            again = cont & F.coalesce(name == a["last"], F.lit(False))
            return {"last": F.when(cont, name).when(x.startswith("#"), strip(x)).otherwise(a["last"])}, some(~again, F.when(cont, name).otherwise(x))
        return fold_out(ls, {"last": F.lit(None).cast("string")}, add, "string")

    def no_lead(ls: Column) -> Column:
        first = F.array_position(F.transform(ls, lambda x: strip(x) != ""), True)
        return F.when(first > 0, F.slice(ls, first.cast("int"), F.size(ls))).otherwise(no_text())

    def subtitle(ls: Column) -> Column:
        # Fixed value: a chapter line without a title.
        chapter = r"(?i)^#{1,3}\s+(Chapter\s+\d+|Topic\s+\d+)\s*$"
        places = F.transform(ls, lambda x, i: F.struct(i.alias("i"), x.alias("x"), (strip(x) != "").alias("full")))
        def join_at(ps: Column) -> Column:
            head = F.get(F.filter(ps, lambda p: (p["i"] < 10) & strip(p["x"]).rlike(chapter)), F.lit(0))
            def use(h: Column) -> Column:
                after = F.filter(ps, lambda p: (p["i"] > h["i"]) & p["full"])
                sub, noise = F.get(after, F.lit(0)), F.get(after, F.lit(1))
                fits = F.coalesce((sub["i"] < 10) & ~strip(sub["x"]).rlike(r"^[#\-*>]"), F.lit(False))
                junk = F.coalesce(F.lower(noise["x"]).rlike("edition|programming:|problem analysis to program"), F.lit(False))
                name = F.initcap(F.regexp_extract(strip(h["x"]), chapter, 1))
                title = F.concat(F.lit("# "), name, F.lit(": "), strip(sub["x"]))
                kept = F.filter(ps, lambda p: (p["i"] != sub["i"]) & ~(junk & (p["i"] == noise["i"])))
                return F.when(fits, F.transform(kept, lambda p: F.when(p["i"] == h["i"], title).otherwise(p["x"])))
            return let(head, lambda h: F.coalesce(F.when(h.isNotNull(), use(h)), ls))
        return let(places, join_at)

    def levels(ls: Column) -> Column:
        has_h2 = F.exists(F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1))), lambda x: x.rlike(r"^##\s+"))
        def raise_h3(low: Column) -> Column:
            return F.transform(ls, lambda x, i: F.when(low & (i > 0) & x.rlike(r"^###\s+"), F.concat(F.lit("## "), strip(x.substr(F.lit(5), F.length(x))))).otherwise(x))
        return let(~has_h2, raise_h3)

    def one_h1(ls: Column) -> Column:
        def lower(first: Column) -> Column:
            return F.transform(ls, lambda x, i: F.when(x.startswith("# ") & (i + 1 > first), F.concat(F.lit("#"), x)).otherwise(x))
        return let(F.array_position(F.transform(ls, lambda x: x.startswith("# ")), True), lower)

    def deep(ls: Column) -> Column:
        flat = lambda x: F.when(x.rlike(r"^#{4,6}\s+"), F.concat(F.lit("### "), strip(F.regexp_replace(x, r"^#{4,6}\s+", "")))).otherwise(x)
        return F.transform(ls, lambda x: F.regexp_replace(flat(x), "</?u>", ""))

    out = lines(text)
    for step in (continued, no_lead, subtitle, levels, one_h1, deep):
        out = let(out, step)
    return F.concat(strip(F.regexp_replace(joined(out), r"\n{3,}", "\n\n")), F.lit("\n"))


def duplicate_fences(text: Column | str) -> Column:
    """A fenced block that equals the lines just before it is dropped."""
    def run(ls: Column) -> Column:
        fence = lambda x: x.startswith("```")
        def tagged(counts: Column) -> Column:
            return F.transform(ls, lambda x, i: F.struct(x.alias("x"), (fence(x) & (F.get(counts, i) % 2 == 1)).alias("opens"),
                                                         (fence(x) & (F.get(counts, i) % 2 == 0)).alias("closes")))
        parts = runs_of(let(running_count(ls, fence), tagged), lambda p, x: x["opens"] | p["closes"],
                        lambda r, at: F.struct(F.get(r, F.lit(0))["opens"].alias("code"), F.transform(r, lambda v: v["x"]).alias("l")))
        def add(a: Folded, g: Column) -> tuple[dict[str, Column], Column]:
            again = F.when(g["code"], strip(joined(a.last(F.size(g["l"])))) == strip(joined(g["l"])))
            return {"n": a["n"] + 1}, F.when(F.coalesce(again, F.lit(False)), no_text()).otherwise(g["l"])
        return fold_out(parts, {"n": F.lit(0)}, add, "string")
    return joined(let(lines(text), run))


def table_overlap(text: Column | str, overlap: float = 0.75) -> Column:
    """Lines within three lines after a table that repeat its words are dropped."""
    def run(ls: Column) -> Column:
        zero = {"seen": no_text(), "end": F.lit(0), "on": F.lit(False)}
        def add(a: Folded, p: Column) -> tuple[dict[str, Column], Column]:
            s = strip(p["x"])
            row = s.startswith("|")
            live = a["on"] & (p["i"] <= a["end"] + 3)
            seen = F.when(live | row, a["seen"]).otherwise(no_text())
            mine = F.array_distinct(words(F.lower(s)))
            def repeats(w: Column) -> Column:
                return (F.size(w) >= 4) & (F.size(F.array_intersect(w, seen)) / F.size(w) >= overlap)
            # Words are looked at only behind a table.
            drop = F.when(live & ~row & (s != "") & ~s.rlike("^[#-]") & (F.size(seen) > 0), let(mine, repeats)).otherwise(F.lit(False))
            cells = words(F.lower(F.translate(s, "|", " ")))
            seen = F.when(row, F.array_union(F.when(a["on"], a["seen"]).otherwise(no_text()), cells)).otherwise(seen)
            return {"seen": seen, "end": F.when(row, p["i"]).otherwise(a["end"]), "on": row | live}, some(~drop, p["x"])
        return joined(fold_out(F.transform(ls, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), zero, add, "string"))
    return let(lines(text), run)


def is_json(c: Column) -> Column:
    """The whole text is one JSON value. The parser stops behind the first value, so the text has to fit into a list and into an object: what
    follows a value may do in one of them, never in both."""
    return (F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), c, F.lit("}"))).isNotNull())


def closed_part(t: Column, opening: str, closing: str, strings: bool) -> Column:
    """The part of a text that its last closing bracket ends and the bracket belonging to it begins; null without either.

    One scan from the right with a depth. With ``strings``, brackets between double quotes count for nothing: the last bracket stands outside, so those to the
    left of an odd number of quotes stand inside.
    """
    body = F.regexp_extract(t, rf"(?s)^.*\{closing}", 0)
    pattern = rf"[\{opening}\{closing}]" + (r'|\\*"' if strings else "")
    marks = lambda b: F.arrays_zip(F.regexp_extract_all(b, F.lit(pattern), F.lit(0)).alias("m"), F.slice(F.split(b, pattern, -1), 2, F.greatest(F.length(b), F.lit(1))).alias("g"))

    def step(a: Column, x: Column) -> Column:
        size = F.length(x["m"])
        quote = x["m"].endswith('"')
        outside = ~quote & ~a["inside"]
        depth = a["depth"] + F.when(outside, F.when(x["m"] == closing, 1).otherwise(-1)).otherwise(0)
        reach = a["reach"] + size + F.length(x["g"])
        # A quote behind an odd number of backslashes is none.
        return F.struct(depth.alias("depth"), (a["inside"] != (quote & (size % 2 == 1))).alias("inside"), reach.alias("reach"),
                        F.coalesce(a["found"], F.when(outside & (x["m"] == opening) & (depth == 0), reach)).alias("found"))

    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(0).alias("reach"), F.lit(None).cast("int").alias("found"))
    scan = lambda b: F.right(b, F.aggregate(F.reverse(marks(b)), zero, step, lambda a: a["found"]))
    return let(body, lambda b: F.when(b != "", scan(b)))


# Marks of an answer and of reasoning talk.
ANSWER_MARKS = ["FINAL_ANSWER:", "FINAL ANSWER:", "===START===", "Final Answer:", "Answer:", "ANSWER:"]
META_WORDS = ["Context:", "Question:", "Constraint:", "Task:", "Wait,", "Actually,", "Let me", "Draft", "Final Check", "Check constraints",
              "Let's check", "Final version:"]
START, END = "===START===", "===END==="


def final_answer(text: Column) -> Column:
    """The answer inside a model's output, by the first rule that finds one.

    A JSON answer key, a JSON list, a tagged answer, the longest marked part, the text after the last
    mark, the last paragraph after the reasoning, else the text itself.
    """
    def key_of(json: Column) -> Column:
        parsed = F.from_json(json, "final_answer string, title string")
        return strip(F.coalesce(parsed["final_answer"], parsed["title"]))

    def from_json(t: Column) -> Column:
        fenced = F.nullif(F.regexp_extract(t, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
        braces = F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))
        valid = is_json
        bad = fenced.isNotNull() & ~valid(fenced)
        listed = closed_part(t, "[", "]", False)
        return F.coalesce(F.when(~bad, F.coalesce(key_of(fenced), key_of(braces))), F.when(valid(listed), listed))

    def clean(t: Column) -> Column:
        for p in (r"(?s)<think>.*?</think>", r"(?s)<\|channel\|>thought.*?<channel\|>", r"(?s)<\|thought\|>.*?</\|thought\|>",
                  r"</?think>|<\|channel\|>thought|<channel\|>|<\|thought\|>|</\|thought\|>"):
            t = F.regexp_replace(t, p, "")
        return t

    def marked(t: Column) -> Column:
        parts = F.split(t, START)
        def pick(ps: Column) -> Column:
            # Of the starts before an end the first one holds the most.
            runs = runs_of(F.slice(ps, 2, F.size(ps)), lambda p, x: p.contains(END), lambda r, at: joined(r, START))
            pairs = F.transform(F.filter(runs, lambda s: s.contains(END)), lambda s: strip(F.substring_index(s, END, 1)))
            # Longest, the first of equals: array_max on (length, -place).
            best = F.array_max(F.transform(pairs, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"]
            long = last_where(F.transform(ps, lambda s: strip(s)), lambda s: F.length(s) > 50)
            return F.when(F.size(ps) > 1, F.coalesce(best, long, strip(F.element_at(ps, -1)))).when(t.contains(END), strip(F.substring_index(t, END, 1)))
        found = let(parts, pick)
        bare = strip(F.regexp_replace(found, r"^```(markdown)?", ""))
        return strip(F.regexp_replace(F.when(found.startswith("```"), bare).otherwise(found), r"```$", ""))

    def after_mark(t: Column) -> Column:
        tails = [F.when(t.contains(m), strip(F.substring_index(t, m, -1))) for m in ANSWER_MARKS]
        return F.coalesce(*[F.when(F.length(x) > 5, x) for x in tails])

    def last_paragraph(t: Column) -> Column:
        meta = lambda s: any_of(s, META_WORDS)
        def run(ls: Column) -> Column:
            good = lambda s: ~meta(s) & (F.length(s) > 25) & s.rlike(r"^\p{Lu}") & ~s.endswith(":")
            places = F.transform(ls, lambda x, i: F.struct(i.alias("i"), strip(x).alias("s")))
            end = last_where(places, lambda p: good(p["s"]))["i"]
            def cut(e: Column) -> Column:
                wall = F.coalesce(last_where(places, lambda p: (p["i"] < e) & (p["s"] != "") & meta(p["s"]))["i"], F.lit(-1))
                return F.when(e.isNotNull(), strip(joined(F.slice(ls, wall + 2, F.size(ls)))))
            return let(end, cut)
        talk = F.substring(t, 1, 400).rlike("Context:|Question:") | F.substring(t, 1, 200).contains("Wait,")
        return F.when(talk, let(lines(t), run))

    def plain(t: Column) -> Column:
        tagged = strip(F.regexp_extract(t, r"(?is)<FINAL_ANSWER>(.*?)</FINAL_ANSWER>", 1))
        return F.coalesce(F.when(F.length(tagged) > 5, tagged), marked(t), after_mark(t), last_paragraph(t), strip(t))

    return F.when(text == "", "").otherwise(F.coalesce(from_json(text), let(clean(text), plain)))


def json_recover(text: Column) -> Column:
    """First part of a text that is JSON: all of it, a fenced part, an object or a list up to its last bracket.

    A part that ends at the last bracket is JSON only if it begins at the bracket that belongs to it, so there is one to try of each kind.
    """
    def run(t: Column) -> Column:
        fenced = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?i)```(?:json)?\s*([\s\S]*?)\s*```"), F.lit(1)), lambda x: strip(x)), lambda x: x != "")
        found = F.concat(F.array(t), fenced, F.array(closed_part(t, "{", "}", True), closed_part(t, "[", "]", True)))
        return F.try_element_at(F.filter(found, lambda c: (c != "") & is_json(c)), F.lit(1))
    return let(strip(text), run)


def text_column(docs: DataFrame, rewritten: Column) -> DataFrame:
    return docs.select("doc_id", rewritten.alias("text"))
