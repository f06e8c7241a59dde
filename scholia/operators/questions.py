"""Question banks: extraction, normal form, flattening, merging and grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.ordered import add_rank
from scholia.functions.text import joined, let, lines, strip, words

# Question and answer labels (English and Malay) of raw exercise text.
PAIR = (r"(?ims)(?:^|\n)\s*(?:#*\s*q(?:uestion)?\s*[\d.\-)]*[\s:\-]*)\n*(.+?)\s*(?:\n|\r\n)\s*"
        r"(?:#*\s*(?:j(?:awapan)?\s*/?\s*)?a(?:nswer)?\s*[\d.\-)]*[\s:\-]*)\n*(.+?)"
        r"(?=\n\s*(?:#*\s*q(?:uestion)?\s*[\d.\-)]*[\s:\-])|\z)")
ASKED = r"(?i)^(?:q(?:uestion)?\s*[\d.\-)]*\s*[:\-]\s*)?(.*\?)$"
NO_ANSWER = "Answer not provided in source text."


def extract_pairs(docs: DataFrame) -> DataFrame:
    """Labelled question and answer pairs; without any, lines that end in ``?`` and the lines after them."""
    pair = "array<struct<q:string,a:string>>"
    flat = lambda x: joined(words(x), " ")

    def labelled(text: Column) -> Column:
        qs, ans = (F.regexp_extract_all(text, F.lit(PAIR), F.lit(i)) for i in (1, 2))
        both = F.zip_with(qs, ans, lambda q, a: F.struct(flat(q).alias("q"), flat(a).alias("a")))
        return F.filter(both, lambda p: p["q"] != "")

    def by_mark(ls: Column) -> Column:
        at = F.filter(F.transform(ls, lambda x, i: F.when(x.endswith("?"), i)), lambda i: i.isNotNull())
        def build(places: Column) -> Column:
            ends = F.concat(F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), F.array(F.size(ls)))
            def one(i: Column, e: Column) -> Column:
                # First run of filled lines up to the next question.
                run = F.split(F.regexp_replace(joined(F.slice(ls, i + 2, e - i - 1)), r"^\n+", ""), r"\n\n+", 2)
                parts = F.transform(lines(F.get(run, F.lit(0))), lambda x: F.regexp_replace(x, r"(?i)^(?:a(?:nswer)?\s*[:\-]\s*)", ""))
                answer = strip(joined(parts, " "))
                return F.struct(strip(F.regexp_extract(F.get(ls, i), ASKED, 1)).alias("q"), F.when(answer == "", NO_ANSWER).otherwise(answer).alias("a"))
            return F.filter(F.zip_with(places, ends, one), lambda p: p["q"] != "")
        return let(at, build)

    stripped = F.transform(lines("text"), lambda x: strip(x))
    found = let(labelled(F.col("text")).cast(pair), lambda p: F.when(F.size(p) > 0, p).otherwise(let(stripped, by_mark).cast(pair)))
    rows = docs.select("doc_id", F.posexplode(found).alias("n", "p"))
    kind = F.when(F.col("p.q").contains("_____"), "fill_in_the_blank").otherwise("subjective")
    return rows.select("doc_id", "n", F.col("p.q").alias("question_text"), F.col("p.a").alias("answer_text"), kind.alias("question_type"))


def normal_type(raw: Column) -> Column:
    low = F.lower(F.coalesce(raw, F.lit("")))
    return (F.when(low.isin("objective", "multiple_choice", "multiple-choice", "mcq"), "objective")
            .when(low.isin("fill_in_the_blank", "fill-in-the-blank", "blank"), "fill_in_the_blank").otherwise("subjective"))


CRITERION = "struct<criterion:string,name:string,max_points:bigint,marks:bigint,description:string>"
PART = ("id:string,label:string,question_text:string,answer_text:string,max_marks:bigint,question_type:string,options:array<string>,"
        f"`order`:bigint,marking_scheme:array<{CRITERION}>")


def part_type(depth: int) -> str:
    """Type of a sub-part that may nest ``depth`` levels further."""
    return f"struct<{PART}>" if depth == 0 else f"struct<{PART},sub_parts:array<{part_type(depth - 1)}>>"


QUESTION = part_type(3)


def _scheme(items: Column) -> Column:
    one = lambda c: F.struct(F.coalesce(c["criterion"], c["name"], F.lit("")).alias("criterion"),
                             F.coalesce(F.nullif(F.coalesce(c["max_points"], c["marks"], F.lit(1)), F.lit(0)), F.lit(1)).alias("max_points"),
                             F.coalesce(c["description"], F.lit("")).alias("description"))
    return F.transform(F.coalesce(items, F.array().cast(f"array<{CRITERION}>")), one)


def _marks(own: Column, parts: Column | None) -> Column:
    """Own marks, else the sum over the parts, else 1."""
    own = F.greatest(F.coalesce(own, F.lit(0)), F.lit(0))
    if parts is not None:
        own = F.when(own == 0, F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + p["max_marks"])).otherwise(own)
    return F.when(own == 0, F.lit(1)).otherwise(own).cast("bigint")


def _parts(items: Column, parent: Column, depth: int) -> Column:
    """Sub-parts in normal form, unrolled to the three levels that are kept."""
    def one(p: Column, i: Column) -> Column:
        label = F.coalesce(p["label"], F.char(i + 97))
        def build(ident: Column) -> Column:
            kids = _parts(p["sub_parts"], ident, depth - 1) if depth > 0 else None
            def fields(k: Column | None) -> Column:
                kind = F.coalesce(p["question_type"], F.lit("subjective"))
                cols = [ident.alias("id"), label.alias("label"), F.coalesce(p["question_text"], F.lit("")).alias("question_text"),
                        F.coalesce(p["answer_text"], F.lit("")).alias("answer_text"), _marks(p["max_marks"], k).alias("max_marks"), kind.alias("question_type"),
                        F.when(p["question_type"] == "objective", p["options"]).alias("options"), F.coalesce(p["order"], i).cast("bigint").alias("order"),
                        _scheme(p["marking_scheme"]).alias("marking_scheme")]
                return F.struct(*cols, *([k.alias("sub_parts")] if k is not None else []))
            return fields(None) if kids is None else let(kids, fields)
        return let(F.coalesce(p["id"], F.concat(parent, label)), build)
    return F.transform(F.coalesce(items, F.array().cast(f"array<{part_type(depth)}>")), one)


def normalize_structure(questions: DataFrame) -> DataFrame:
    """Questions from JSON with marks, sub-parts and marking schemes in normal form."""
    q = questions.select("set_id", F.from_json("question_json", QUESTION).alias("q"))
    q = q.withColumn("parts", _parts(F.col("q.sub_parts"), F.coalesce(F.col("q.id"), F.lit("")), 2))
    marks = _marks(F.col("q.max_marks"), F.col("parts"))
    kind = F.coalesce(F.col("q.question_type"), F.lit("subjective"))
    def scheme(s: Column) -> Column:
        fallback = F.array(F.struct(F.lit("Overall correctness").alias("criterion"), marks.alias("max_points"),
                                    F.lit("Award marks based on accuracy and completeness of the answer.").alias("description")))
        open_ended = ~kind.isin("objective", "multiple_choice", "mcq")
        return F.when((F.size(s) == 0) & open_ended, fallback).otherwise(s)
    out = F.struct(F.col("q.id").alias("id"), F.col("q.question_text").alias("question_text"), kind.alias("question_type"), marks.alias("max_marks"),
                   let(_scheme(F.col("q.marking_scheme")), scheme).alias("marking_scheme"), F.col("parts").alias("sub_parts"))
    return q.select("set_id", out.alias("question"))


def fill_defaults(questions: DataFrame) -> DataFrame:
    """Missing marks, sub-parts and schemes filled on three levels; nothing that is given is changed."""
    def level(q: Column, depth: int) -> Column:
        def kids() -> Column:
            return F.transform(F.coalesce(q["sub_parts"], F.array().cast(f"array<{part_type(depth - 1)}>")), lambda p: level(p, depth - 1))
        base = [q["id"].alias("id"), F.coalesce(q["max_marks"], F.lit(1)).alias("max_marks"),
                F.coalesce(q["marking_scheme"], F.array().cast(f"array<{CRITERION}>")).alias("marking_scheme")]
        return F.struct(*base, *([kids().alias("sub_parts")] if depth > 1 else []))
    return questions.select("set_id", level(F.from_json("question_json", QUESTION), 3).alias("question"))


def flatten_parts(questions: DataFrame, ident: str | None = None) -> DataFrame:
    """One row per question and sub-part with its path; with an id, the first match by path of each set."""
    q = questions.select("set_id", F.col("q_no"), F.from_json("question_json", QUESTION).alias("q"))
    show = lambda df, depth: df.select("set_id", "path", F.lit(depth).alias("depth"), F.col("q.id").alias("id"),
                                       F.col("q.question_text").alias("question_text"), F.col("q.max_marks").alias("max_marks"))
    level = q.select("set_id", F.format_string("%06d", F.col("q_no")).alias("path"), "q")
    out = show(level, 0)
    for depth in (1, 2, 3):
        level = (level.select("set_id", "path", F.posexplode("q.sub_parts").alias("i", "q"))
                 .select("set_id", F.concat("path", F.lit("."), F.format_string("%06d", F.col("i"))).alias("path"), "q"))
        out = out.unionByName(show(level, depth))
    if ident is None:
        return out
    first = F.min_by(F.struct("path", "depth", "id", "question_text", "max_marks"), "path")
    return out.filter(F.col("id") == ident).groupBy("set_id").agg(first.alias("f")).select("set_id", "f.*")


def merge_sets(questions: DataFrame, order: list[Column]) -> DataFrame:
    """Questions of several sets in one, with a new running order from 0."""
    return add_rank(questions, ["new_set_id"], order, "order").withColumn("order", F.col("order") - 1)


def grade_objective(answers: DataFrame) -> DataFrame:
    right = F.lower(strip("user_answer")) == F.lower(strip("answer_text"))
    marks = F.coalesce(F.nullif(F.col("max_marks"), F.lit(0)), F.lit(1))
    return answers.select("answer_id", F.when(right, marks).otherwise(0).alias("awarded"), marks.alias("total"))


def grade_keywords(answers: DataFrame) -> DataFrame:
    """Marks by the share of key words (over three characters) found in the answer; a floor for an honest try."""
    def grade(v: Column) -> Column:
        ua, terms, marks = v["u"], v["k"], v["m"]
        matched = F.size(F.filter(terms, lambda w: ua.contains(w)))
        share = F.bround(marks * (matched / F.greatest(F.size(terms), F.lit(1))), 0).cast("bigint")
        floor = F.when((share == 0) & (F.length(ua) > 5), F.bround(marks * 0.25, 0).cast("bigint")).otherwise(share)
        none = ua == ""
        return F.struct(F.when(none, 0).otherwise(F.least(floor, marks)).cast("bigint").alias("awarded"), marks.alias("total"),
                        F.when(none, 0).otherwise(matched).alias("matched"), F.size(terms).alias("key_terms"))
    key = words(F.lower(strip("answer_text")))
    long = lambda ws: let(F.filter(ws, lambda w: F.length(w) > 3), lambda k: F.when(F.size(k) > 0, k).otherwise(ws))
    once = F.struct(F.lower(strip(F.coalesce("user_answer", F.lit("")))).alias("u"), let(key, long).alias("k"), F.col("max_marks").cast("bigint").alias("m"))
    return answers.select("answer_id", let(once, grade).alias("g")).select("answer_id", "g.*")


def difficulty_mix(questions: DataFrame) -> DataFrame:
    return questions.groupBy("set_id", "type", "difficulty").agg(F.count("*").alias("n"))
