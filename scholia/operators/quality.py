"""Quality of Markdown against an expectation, and training pairs from it."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.ordered import add_rank
from scholia.functions.text import Folded, fold_out, let, lines, runs_of, strip

ORDERED = r"^\d+[.)]\s"


def line_counts(ls: Column) -> dict[str, Column]:
    """Twelve counts of line kinds of one text, given as its lines."""
    n = lambda test: F.size(F.filter(ls, test))
    s = strip
    listed = lambda x: s(x).startswith("- ")
    row = lambda x: s(x).startswith("|")
    fence = lambda x: s(x).startswith("```")
    ordered = lambda x: s(x).rlike(ORDERED)
    return {
        "total_lines": F.size(ls), "non_empty_lines": n(lambda x: s(x) != ""), "headings": n(lambda x: x.startswith("#")),
        "h1": n(lambda x: x.startswith("# ")), "h2": n(lambda x: x.startswith("## ")), "h3": n(lambda x: x.startswith("### ")),
        "list_items": n(listed), "ordered_items": n(ordered),
        "body_lines": n(lambda x: (s(x) != "") & ~x.startswith("#") & ~listed(x) & ~ordered(x) & ~row(x) & ~fence(x)),
        "table_rows": n(row), "code_blocks": F.floor(n(fence) / 2).cast("int"),
    }


def image_links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"!\[(.*?)\]\((.+?)\)"), F.lit(2))


def doc_metrics(docs: DataFrame) -> DataFrame:
    counts = let(lines("text"), lambda ls: F.struct(*[c.alias(k) for k, c in line_counts(ls).items()]))
    return (docs.select("doc_id", counts.alias("m"), F.size(image_links(F.col("text"))).alias("images")).select("doc_id", "m.*", "images"))


def code_blocks(text: Column | str) -> Column:
    return F.floor(F.size(F.filter(lines(text), lambda x: strip(x).startswith("```"))) / 2).cast("int")


def filled(text: Column | str) -> Column:
    return F.size(F.filter(lines(text), lambda x: strip(x) != ""))


def preservation(actual: Column, expected: Column) -> Column:
    """Smaller over larger number of filled lines."""
    r = actual / F.greatest(expected, F.lit(1))
    return F.bround(F.when(r > 1, 1 / r).otherwise(r), 4)


def image_scores(found: Column, expected: Column) -> tuple[Column, Column]:
    """Recall and noise of image links as sets; without an expectation 1 and 0."""
    f, e = F.array_distinct(found), F.array_distinct(expected)
    recall = F.size(F.array_intersect(f, e)) / F.greatest(F.size(e), F.lit(1))
    noise = F.size(F.array_except(f, e)) / F.greatest(F.size(f), F.lit(1))
    none = F.size(e) == 0
    return F.when(none, 1.0).otherwise(recall), F.when(none, 0.0).otherwise(noise)


def structural_validity(docs: DataFrame) -> DataFrame:
    """Points off for no H1, several H1 and every skipped level; the issues as codes."""
    def judge(heads: Column) -> Column:
        levels = F.transform(heads, lambda h: F.length(F.substring_index(h, " ", 1)))
        def score(lv: Column) -> Column:
            h1 = F.size(F.filter(heads, lambda h: h.startswith("# ")))
            jump = lambda x, i: F.when((i > 0) & (x > F.get(lv, i - 1) + 1), F.concat(
                F.lit("hierarchy_jump_"), F.get(lv, i - 1).cast("string"), F.lit("_to_"), x.cast("string")))
            jumps = F.array_compact(F.transform(lv, jump))
            issues = F.concat(F.array_compact(F.array(F.when(h1 == 0, F.lit("missing_h1")), F.when(h1 > 1, F.lit("multiple_h1")))), jumps)
            points = 1.0 - F.when(h1 == 0, 0.2).otherwise(0.0) - F.when(h1 > 1, 0.15).otherwise(0.0) - F.size(jumps) * 0.1
            return F.struct(F.bround(F.greatest(F.lit(0.0), points), 6).alias("score"), issues.alias("issues"))
        return let(levels, score)
    heads = F.filter(lines("text"), lambda x: x.startswith("#"))
    return docs.select("doc_id", let(heads, judge).alias("v")).select("doc_id", "v.score", "v.issues")


def overall_score(preserved: Column, validity: Column, consistency: Column, recall: Column, noise: Column, headings: Column) -> Column:
    """Weighted mean, reduced by a fifth for a text without headings."""
    total = preserved * 0.25 + validity * 0.25 + consistency * 0.15 + recall * 0.15 + (1.0 - noise) * 0.10
    return F.bround(F.least(F.when(headings > 0, total).otherwise(total * 0.8) / 0.9, F.lit(1.0)), 4)


def ocr_confidence(text: Column | str) -> Column:
    """Mean of the first confidence comment of each line, 1 without any."""
    marks = F.transform(lines(text), lambda x: F.regexp_extract(x, r"<!-- ocr-conf:\s*([\d.]+)\s*-->", 1).try_cast("double"))
    return let(F.filter(marks, lambda m: m.isNotNull()), lambda m: F.when(F.size(m) > 0, F.aggregate(m, F.lit(0.0), lambda a, x: a + x) / F.size(m)).otherwise(1.0))


def headings_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line, level, text, parent_level): the parent is the last heading of a smaller level.

    The fold keeps the open headings, at most one per level.
    """
    pattern = r"^(#{1,6})\s+(.+)$"
    hs = F.filter(F.transform(lines("text"), lambda x, i: F.struct(
        i.alias("line"), F.length(F.regexp_extract(x, pattern, 1)).alias("level"), strip(F.regexp_extract(x, pattern, 2)).alias("text"))), lambda h: h["level"] > 0)
    def add(a: Folded, h: Column) -> tuple[dict[str, Column], Column]:
        kept = F.filter(a["open"], lambda l: l < h["level"])
        node = F.struct(h["line"].alias("line"), h["level"].alias("level"), h["text"].alias("text"), F.try_element_at(kept, F.lit(-1)).alias("parent"))
        return {"open": F.concat(kept, F.array(h["level"]))}, F.array(node)
    found = fold_out(hs, {"open": F.array().cast("array<int>")}, add, "struct<line:int,level:int,text:string,parent:int>")
    return docs.select("doc_id", F.inline(found)).select("doc_id", "line", "level", "text", "parent")


def heading_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Headings missing or extra by (level, text), and levels that jump below their parent.

    A child of an H1 is measured like a top-level heading.
    """
    keys = ["doc_id", "level", "text"]
    a, e = headings_of(actual), headings_of(expected)
    mine, theirs = a.select(*keys).distinct(), e.select(*keys).distinct()
    allowed = F.when(F.coalesce("parent", F.lit(1)) == 1, 1).otherwise(F.col("parent") + 1)
    jumps = a.filter(F.col("level") > allowed + 1)
    tag = lambda df, kind: df.select("doc_id", F.lit(kind).alias("diff_type"), "level", "text")
    return (tag(theirs.join(mine, keys, "left_anti"), "missing_heading").unionByName(tag(mine.join(theirs, keys, "left_anti"), "extra_heading"))
            .unionByName(tag(jumps, "hierarchy_jump")))


def list_runs(docs: DataFrame) -> DataFrame:
    """Contiguous list lines: first and last line, kind of the first, length."""
    item = lambda x: strip(x).startswith("- ") | strip(x).rlike(ORDERED)
    def build(run: Column, at: Column) -> Column:
        first = F.get(run, F.lit(0))
        kind = F.when(strip(first).startswith("- "), "unordered").otherwise("ordered")
        return F.when(item(first), F.struct(at.alias("start"), (at + F.size(run) - 1).alias("end"), kind.alias("type"), F.size(run).alias("length")))
    found = F.array_compact(runs_of(lines("text"), lambda p, x: item(p) != item(x), build))
    return docs.select("doc_id", F.posexplode(found).alias("run", "r")).select("doc_id", "run", "r.*")


def compare_list_runs(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Kind and size differences (over two lines) of runs with the same number."""
    a, e = (list_runs(x).select("doc_id", "run", F.col("type").alias(f"{n}_type"), F.col("length").alias(f"{n}_length"))
            for x, n in ((actual, "actual"), (expected, "expected")))
    both = a.join(e, ["doc_id", "run"], "full")
    return both.select("doc_id", "run", (F.col("actual_type") != F.col("expected_type")).alias("type_differs"),
                       (F.abs(F.col("actual_length") - F.col("expected_length")) > 2).alias("size_differs"))


def leader_pairs(docs: DataFrame) -> DataFrame:
    """Each document with the first document it shares a line with: one pair per document, not all pairs.

    Lines meet by their digest, and only the smallest id per digest travels on.
    """
    marks = docs.select("doc_id", F.explode(F.array_distinct(F.transform(lines("text"), lambda x: F.xxhash64(x)))).alias("h"))
    first = marks.groupBy("h").agg(F.min("doc_id").alias("first"))
    lead = marks.join(first, "h").filter("first < doc_id").groupBy("doc_id").agg(F.min("first").alias("id_b"))
    return lead.select(F.col("doc_id").alias("id_a"), "id_b")


def similarity(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Share of matching lines of each given pair, 2 M / T, by longest matching blocks."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x.split("\n"), y.split("\n")).ratio() for x, y in zip(a, b)], dtype="float64")
    left = docs.select(F.col("doc_id").alias("id_a"), F.col("text").alias("ta"))
    right = docs.select(F.col("doc_id").alias("id_b"), F.col("text").alias("tb"))
    return pairs.join(left, "id_a").join(right, "id_b").select("id_a", "id_b", F.bround(ratio("ta", "tb"), 6).alias("ratio"))


# -- training sets ---------------------------------------------------------------------------------


def training_pairs(raw: DataFrame, polished: DataFrame, system: str) -> DataFrame:
    """Chat-format messages of pairs where neither side is blank."""
    both = raw.select("id", strip("text").alias("r")).join(polished.select("id", strip("text").alias("p")), "id").filter("r <> '' and p <> ''")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return both.select("id", F.array(turn("system", F.lit(system)), turn("user", F.col("r")), turn("assistant", F.col("p"))).alias("messages"))


def split_pairs(pairs: DataFrame, seed: str, frac: float = 0.9) -> DataFrame:
    """Shuffled by a seeded digest, the first floor(frac n) rows for training.

    The digest order is numbered over many tasks; the count is one row.
    """
    keyed = pairs.select("id", F.md5(F.concat(F.col("id").cast("string"), F.lit(seed))).alias("_k"))
    cut = keyed.agg(F.floor(F.count("*") * F.lit(frac))).scalar()
    return add_rank(keyed, [], [F.col("_k"), F.col("id")], "_n").select("id", F.when(F.col("_n") <= cut, "train").otherwise("valid").alias("split"))


def pending(resources: DataFrame, existing: DataFrame, limit: int = 200) -> DataFrame:
    return resources.join(existing, "resource_id", "left_anti").select("resource_id").orderBy("resource_id").limit(limit)


def rating_stats(messages: DataFrame) -> DataFrame:
    ok = messages.filter(F.col("rating").between(0, 5))
    return ok.groupBy("model", "mode").agg(F.count("*").alias("n"), (F.sum("rating") / F.count("*")).alias("avg_rating"),
                                           F.count_if(F.coalesce("comment", F.lit("")) != "").alias("comments"))
