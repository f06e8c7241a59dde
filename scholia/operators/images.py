"""Extracted images: duplicates, decoration and their place in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.ordered import add_rank, latest, top_per_key
from scholia.functions.text import Folded, any_of, field, fold_out, let, lines, strip, unroll
from scholia.operators.cleaning import FIGURE_REFS

# Limits of the picture rules.
SMALL, CORNER, FULL_BLEED, LONG = 150, 0.05, 0.85, 5


def image_dedup(images: DataFrame) -> DataFrame:
    """First image of each content hash within a source."""
    return latest(images, ["doc_id", "md5"], ["image_id"], newest=False)


def _verdict(decorative: bool, conf: float) -> Column:
    return F.struct(F.lit(decorative).alias("is_decorative"), F.lit(not decorative).alias("is_diagram"), F.lit(conf).alias("confidence"))


def image_classify(images: DataFrame, skip: DataFrame, patterns: list[tuple[float, float, float]]) -> DataFrame:
    """Decoration or diagram by size, place and shape; then template repeats, known hashes and size patterns.

    A box seen for the third time in a source is a template. Only the second-smallest image id of a
    box matters for that, which a trimmed ranking finds however often the box occurs.
    """
    w, h = F.col("width"), F.col("height")
    x, y = F.col("x") / F.col("page_width"), F.col("y") / F.col("page_height")
    sized = (F.col("page_width") > 0) & (F.col("page_height") > 0)
    base = (F.when((w < SMALL) & (h < SMALL), _verdict(True, 0.95))
            .when(sized & (w / F.col("page_width") > FULL_BLEED) & (h / F.col("page_height") > FULL_BLEED), _verdict(True, 0.9))
            .when(sized & ((x < CORNER) | (x > 1 - CORNER)) & (y < CORNER), _verdict(True, 0.85))
            .when((w > 0) & (h > 0) & ((w / h > LONG) | (h / w > LONG)), _verdict(True, 0.8))
            .when(F.col("shape").isin("chart", "smartart"), _verdict(False, 0.95)).when(F.col("shape") == "picture", _verdict(False, 0.7))
            .otherwise(_verdict(False, 0.5)))
    tens = lambda c: F.bround(F.col(c), -1)
    box = F.concat_ws("|", *[tens(c).cast("string") for c in ("x", "y", "width", "height")])
    first = images.withColumn("_v", base).withColumn("_box", box)
    seconds = (top_per_key(first.filter(~F.col("_v.is_decorative")).select("doc_id", "_box", "image_id"), ["doc_id", "_box"],
                           [F.col("image_id")], 2).filter("rank = 2").select("doc_id", "_box", F.col("image_id").alias("_second")))
    known = skip.select("md5").distinct().withColumn("_skip", F.lit(True))
    out = F.when(F.col("_v.is_decorative"), F.col("_v")).when(F.col("image_id") > F.col("_second"), _verdict(True, 0.95)).when(
        F.col("_skip"), _verdict(True, 0.98))
    for max_w, max_h, conf in patterns:
        out = out.when((w <= max_w) & (h <= max_h), _verdict(True, conf))
    return (first.join(seconds, ["doc_id", "_box"], "left").join(known, "md5", "left")
            .select("image_id", out.otherwise(F.col("_v")).alias("_o")).select("image_id", "_o.*"))


LAST = 2147483647


def image_place(docs: DataFrame, images: DataFrame) -> DataFrame:
    """Lines of each document with its images in place, as rows in the order (pos, page, rank).

    The n-th figure reference on a page takes the n-th image of that page, what is left goes to the page's
    first end, and images of pages that never end or never come to the end of the document. So an image
    stands at the smaller of two positions found by joins, and no document's images are gathered. A page is
    taken to come once.
    """
    mark = r"^(?:<!--\s*Page\s+(\d+)\s*-->|\[Page\s+(\d+)\])"

    def places(ls: Column) -> Column:
        def facts(x: Column, i: Column) -> Column:
            """What the fold needs of a line, worked out once."""
            number = F.coalesce(F.regexp_extract(x, mark, 1).try_cast("int"), F.regexp_extract(x, mark, 2).try_cast("int"))
            nxt = F.get(ls, i + 1)
            ends = nxt.isNull() | nxt.rlike(r"^<!--\s*Page\s+\d+\s*-->") | ((strip(x) == "") & nxt.startswith("# "))
            return F.struct(number.alias("number"), any_of(F.lower(x), FIGURE_REFS).cast("int").alias("ref"), ends.alias("ends"))
        def add(a: Folded, p: Column) -> tuple[dict[str, Column], Column]:
            page = F.coalesce(p["number"], a["page"])
            refs = F.when(p["number"].isNotNull(), 0).otherwise(a["refs"]) + p["ref"]
            one = F.struct(page.alias("page"), F.when(p["ref"] > 0, refs).alias("ref"), (p["ends"] & (page > 0)).alias("ends"))
            return {"page": page, "refs": refs}, F.array(one)
        return fold_out(F.transform(ls, facts), {"page": F.lit(0), "refs": F.lit(0)}, add, "struct<page:int,ref:int,ends:boolean>")

    def numbered(ls: Column) -> Column:
        return F.zip_with(ls, places(ls), lambda x, p: F.struct(x.alias("line"), p["page"].alias("page"), p["ref"].alias("ref"), p["ends"].alias("ends")))

    wanted = {n: field(n) for n in ("line", "page", "ref", "ends")}
    text = unroll(docs, ["doc_id"], let(lines("text"), numbered), "pos", wanted)
    refs = text.filter("ref is not null").groupBy("doc_id", "page", "ref").agg(F.min("pos").alias("at_ref"))
    ends = text.filter("ends").groupBy("doc_id", "page").agg(F.min("pos").alias("at_end"))
    ranked = add_rank(images.select("doc_id", "page", "image_id", F.col("ref").alias("link")), ["doc_id", "page"], [F.col("image_id")], "rank")
    placed = (ranked.join(docs.select("doc_id"), "doc_id", "left_semi")
              .join(refs.withColumn("rank", F.col("ref").cast("long")).drop("ref"), ["doc_id", "page", "rank"], "left")
              .join(ends, ["doc_id", "page"], "left"))
    at = F.coalesce(F.least("at_ref", "at_end"), F.lit(LAST))
    return (text.select("doc_id", "pos", F.lit(0).alias("page"), F.lit(0).cast("long").alias("rank"), F.col("line").alias("markdown"))
            .unionByName(placed.select("doc_id", at.alias("pos"), "page", "rank", F.col("link").alias("markdown"))))
