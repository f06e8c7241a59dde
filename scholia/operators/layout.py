"""Page layout from text spans. A page is one row with its spans, lines or blocks as an array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import any_of, field, joined, let, runs_of, strip, unroll

# Footers to drop, list marks, headings to skip, monospace fonts and code words.
FOOTERS = [r"(?i)©.*Cisco", r"(?i)Cisco\s*(Confidential|Public)", r"(?i)All rights reserved", r"(?i)Cisco\s+and/or\s+its\s+affiliates"]
BULLETS, DASHES = "•‣◦⁃∙‐‑–—►▪▸➤➢", "–—‐‑\\-"
NUMBERED = r"^(\d+[\.\)]\s)"
SKIPPED = [r"(?i)^Video\s*[-–—]\s*", r"(?i)^Lab\s*[-–—]\s*"]
MONO = ["mono", "courier", "consolas", "lucida console", "inconsolata", "source code", "fira code", "jetbrains"]
CODE = ["public", "private", "class", "void", "static", "System.out", "println", "import", "def", "return", "function", "const", "let", "var",
        "int ", "float ", "double ", "boolean ", "char ", "String", "new ", "extends", "implements", "interface", "package", "@Override",
        "@SuppressWarnings"]
# Layout detector labels and the block types they stand for.
LAYOUT_TYPES = {"Title": "h1", "Section-header": "h2", "Text": "body", "List-item": "list", "Table": "table", "Caption": "caption",
                "Footnote": "footnote", "Page-footer": "skip", "Page-header": "skip", "Formula": "body", "Picture": "skip"}


def layout_type(label: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LAYOUT_TYPES.items() for x in pair])[label]


def point_in_box(blocks: DataFrame, boxes: DataFrame, band: float = 50.0) -> DataFrame:
    """Label of the box around each block's centre with the best confidence per area; the first on a tie.

    Boxes are listed under every height band they touch, so a block meets only boxes near it and
    not all boxes of its page.
    """
    cy, cx = (F.col("top") + F.col("bottom")) / 2, (F.col("x0") + F.col("x1")) / 2
    b = blocks.select("doc_id", "page", "block_no", cx.alias("cx"), cy.alias("cy"), F.floor(cy / band).alias("band"))
    bands = F.sequence(F.floor(F.col("by0") / band), F.floor(F.col("by1") / band))
    x = boxes.withColumn("band", F.explode(bands))
    area = (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))
    hits = b.join(x, ["doc_id", "page", "band"]).filter(
        F.col("cx").between(F.col("bx0"), F.col("bx1")) & F.col("cy").between(F.col("by0"), F.col("by1")) & (F.col("conf") > 0))
    rank = F.struct((F.col("conf") / F.greatest(area, F.lit(1.0))).alias("s"), (-F.col("box_no")).alias("n"))
    return hits.groupBy("doc_id", "page", "block_no").agg(F.max_by("label", rank).alias("label"))


def font_key(s: Column | None = None) -> Column:
    get = (lambda n: s[n]) if s is not None else F.col
    return F.concat_ws("|", get("font_name"), F.format_string("%.1f", get("font_size")), get("is_bold").cast("string"), get("is_italic").cast("string"))


def font_hierarchy(pages: DataFrame) -> DataFrame:
    """Body font (most characters) and heading level of every larger font size, per document.

    Spans shrink to one row per document and font before fonts are compared.
    """
    names = ("text", "font_name", "font_size", "is_bold", "is_italic")
    s = unroll(pages, ["doc_id"], "spans", "n", {n: field(n) for n in names}).filter(strip("text") != "")
    fonts = (s.groupBy("doc_id", font_key().alias("font_key"), "font_size", "is_bold")
             .agg(F.sum(F.length(strip("text"))).alias("chars")))
    body = fonts.groupBy("doc_id").agg(F.max_by(F.struct("font_key", F.col("font_size").alias("size")), F.struct("chars", "font_key")).alias("_b"),
                                       F.collect_set("font_size").alias("_sizes"))
    big = F.sort_array(F.filter("_sizes", lambda z: z > F.col("_b.size") + 0.5), asc=False)
    near = F.array_max(F.array_compact(F.transform(big, lambda z, i: F.when(F.abs(F.col("font_size") - z) < 0.5, F.least(i + 1, F.lit(5))))))
    return (fonts.join(body, "doc_id")
            .select("doc_id", "font_key", "font_size", F.when(near.isNotNull(), F.concat(F.lit("h"), near.cast("string"))).alias("level"),
                    (F.col("font_key") == F.col("_b.font_key")).alias("is_body"), F.col("_b.size").alias("body_size")))


def _dominant(parts: Column, weight: Callable[[Column], Column], font: Callable[[Column], Column]) -> Column:
    """Font with most characters; the earliest on a tie."""
    def pick(ps: Column) -> Column:
        keys = F.array_distinct(F.transform(ps, lambda s: font(s)["key"]))
        def total(k: Column, i: Column) -> Column:
            return F.struct(F.aggregate(F.filter(ps, lambda s: font(s)["key"] == k), F.lit(0), lambda a, s: a + weight(s)).alias("n"), (-i).alias("i"), k.alias("k"))
        best = F.array_max(F.transform(keys, total))["k"]
        return let(best, lambda k: font(F.get(F.filter(ps, lambda s: font(s)["key"] == k), F.lit(0))))
    return let(parts, pick)


def spans_to_lines(pages: DataFrame) -> DataFrame:
    """Spans of a page to lines: same line while the centres are close; a gap or bare ends get a space."""
    def same(p: Column, s: Column) -> Column:
        return F.abs((p["top"] + p["bottom"]) / 2 - (s["top"] + s["bottom"]) / 2) < F.greatest(s["font_size"] * 0.6, F.lit(4.0))
    # Worked out once a span, before the lines are cut.
    font = lambda s: F.struct(font_key(s).alias("key"), s["font_size"].alias("size"), s["is_bold"].alias("bold"), s["font_name"].alias("name"))
    def line(spans: Column, at: Column) -> Column:
        def glued(ss: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                p = F.get(ss, i - 1)
                gap = (s["x0"] - p["x1"]) > p["font_size"] * 0
                gap = gap & ((s["x0"] - p["x1"]) > s["font_size"] * 0.15)
                bare = ~p["text"].rlike(r"\s$") & ~s["text"].rlike(r"^\s") & (p["text"] != "") & (s["text"] != "")
                return F.when(i == 0, s["text"]).when(bare | (gap & ~p["text"].endswith(" ")), F.concat(F.lit(" "), s["text"])).otherwise(s["text"])
            return joined(F.transform(ss, one), "")
        low, high = (lambda f: F.array_min(F.transform(spans, lambda s: s[f]))), (lambda f: F.array_max(F.transform(spans, lambda s: s[f])))
        return F.struct(let(spans, glued).alias("text"), low("x0").alias("x0"), high("x1").alias("x1"), low("top").alias("top"),
                        high("bottom").alias("bottom"), _dominant(spans, lambda s: F.length(s["text"]), lambda s: s["font"]).alias("font"))
    key = lambda s: F.struct(F.bround(s["top"], 1).alias("t"), s["x0"].alias("x"), s["span_no"].alias("n"), s.alias("s"))
    names = ("text", "font_size", "x0", "x1", "top", "bottom")
    order = F.transform(F.array_sort(F.transform("spans", key)), lambda k: F.struct(*[k["s"][n].alias(n) for n in names], font(k["s"]).alias("font")))
    found = runs_of(order, lambda p, s: ~same(p, s), line)
    return pages.select("doc_id", "page", "width", "height", found.alias("lines"))


def columns(pages: DataFrame) -> DataFrame:
    """Column number of every span: by clusters of bullets, else by empty strips at least 15 points wide.

    Strips must have text on both sides well inside the margins, and at least three rows must reach
    into more than one column.
    """
    content = F.filter("spans", lambda s: strip(s["text"]) != "")
    def by_bullets(ss: Column) -> Column:
        xs = F.array_sort(F.transform(F.filter(ss, lambda s: strip(s["text"]).rlike(f"^[{BULLETS}]")), lambda s: s["x0"]))
        clusters = lambda v: F.when(F.size(v) >= 6, runs_of(v, lambda a, b: b - a >= 20, lambda run, i: run))
        def centres(cs: Column) -> Column:
            big = F.filter(cs, lambda c: F.size(c) >= 3)
            mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
            return F.transform(big, mean)
        def edges(c: Column) -> Column:
            apart = F.forall(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.get(c, i) - F.get(c, i - 1) >= 50)
            mids = F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: (F.get(c, i - 1) + F.get(c, i)) / 2)
            return F.when((F.size(c) >= 2) & apart, F.concat(F.array(F.lit(0.0)), mids, F.array(F.col("width"))))
        return let(let(xs, clusters), lambda cs: let(F.when(cs.isNotNull(), centres(cs)), lambda c: F.when(F.size(c) >= 2, edges(c))))

    def by_gaps(ss: Column) -> Column:
        spans = F.array_sort(F.transform(ss, lambda s: F.struct(F.greatest(F.lit(0), s["x0"].cast("int")).alias("a"), s["x1"].cast("int").alias("b"))))
        zero = F.struct(F.lit(-1).alias("left"), F.lit(-1).alias("right"), F.array().cast("array<struct<a:int,b:int>>").alias("gaps"))
        def add(acc: Column, s: Column) -> Column:
            hole = (acc["right"] >= 0) & (s["a"] > acc["right"] + 1)
            gap = F.array(F.struct((acc["right"] + 1).alias("a"), s["a"].alias("b")))
            return F.struct(F.when(acc["left"] < 0, s["a"]).otherwise(acc["left"]).alias("left"), F.greatest(acc["right"], s["b"]).alias("right"),
                            F.when(hole, F.concat(acc["gaps"], gap)).otherwise(acc["gaps"]).alias("gaps"))
        def edges(c: Column) -> Column:
            margin = (c["right"] - c["left"]) * 0.05
            real = F.filter(c["gaps"], lambda g: (g["b"] - g["a"] >= 15) & (g["a"] > c["left"] + margin) & (g["b"] < c["right"] - margin))
            mids = F.transform(real, lambda g: (g["a"] + g["b"]) / 2.0)
            return F.when((c["right"] - c["left"] >= 100) & (F.size(real) > 0),
                          F.concat(F.array(c["left"].cast("double")), mids, F.array((c["right"] + 1).cast("double"))))
        def checked(e: Column) -> Column:
            cell = lambda s: F.struct((F.bround(s["top"] / 8, 0) * 8).alias("y"), column_of((s["x0"] + s["x1"]) / 2, e).alias("c"))
            cells = F.array_distinct(F.filter(F.transform(ss, cell), lambda x: x["c"].isNotNull()))
            ys = F.array_sort(F.transform(cells, lambda x: x["y"]))
            # In sorted heights a row of several columns shows once, where a height repeats for the first time.
            again = lambda v, y, back: F.coalesce(F.get(v, back) == y, F.lit(False))
            wide = lambda v: F.size(F.filter(v, lambda y, i: again(v, y, i - 1) & ~again(v, y, i - 2))) >= 3
            return F.when(let(ys, wide), e)
        return let(let(F.aggregate(spans, zero, add), edges), lambda e: F.when(e.isNotNull(), checked(e)))

    def column_of(x: Column, e: Column) -> Column:
        inside = (x >= F.get(e, F.lit(0))) & (x < F.element_at(e, -1))
        return F.when(inside, F.size(F.filter(e, lambda b: b <= x)) - 1)

    def nearest(x: Column, e: Column) -> Column:
        centres = F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: F.struct(F.abs(x - (F.get(e, i) + F.get(e, i + 1)) / 2).alias("d"), i.alias("i")))
        return F.array_min(centres)["i"]

    enough = (F.size(content) >= 4) & (F.col("width") >= 100)
    bullets = let(content, by_bullets)
    edges = pages.withColumn("_b", F.when(enough, bullets)).withColumn("_g", F.when(enough, let(content, by_gaps)))
    spans = unroll(edges, ["doc_id", "page", "_b", "_g"], "spans", "n", {n: field(n) for n in ("span_no", "x0", "x1")})
    mid, x0 = (F.col("x0") + F.col("x1")) / 2, F.col("x0")
    number = (F.when(F.col("_b").isNotNull(), F.coalesce(column_of(x0, F.col("_b")), nearest(x0, F.col("_b"))))
              .when(F.col("_g").isNotNull(), F.coalesce(column_of(mid, F.col("_g")), nearest(mid, F.col("_g")))).otherwise(0))
    return spans.select("doc_id", "page", "span_no", number.alias("column_no"))


def drop_headers_footers(pages: DataFrame) -> DataFrame:
    """Lines in the top 5 % or bottom 10 % go when short; footer texts and lone page numbers always go."""
    def keep(x: Column) -> Column:
        edge = (x["bottom"] < F.col("height") * 0.05) | (x["top"] > F.col("height") * 0.90)
        return let(strip(x["text"]), lambda t: ~any_of(t, FOOTERS) & ~(edge & (F.length(t) < 5)) & ~t.rlike(r"^\d{1,3}$"))
    return pages.withColumn("lines", F.filter("lines", keep))


def lines_to_blocks(pages: DataFrame) -> DataFrame:
    """Lines to paragraphs: a wide gap, another font, a list mark or a new indent starts a block."""
    def starts(p: Column, x: Column) -> Column:
        gap, high = x["top"] - p["bottom"], p["bottom"] - p["top"]
        other = (F.abs(p["font"]["size"] - x["font"]["size"]) > 0.5) | (p["font"]["bold"] != x["font"]["bold"])
        mark = strip(x["text"]).rlike(f"^[{BULLETS}]|{NUMBERED}")
        return ((gap > high * 1.5) | other | ((gap > high * 0.8) & (p["font"]["key"] != x["font"]["key"])) | mark
                | ((F.abs(x["x0"] - p["x0"]) > 15) & (gap > 2)))
    def run(ls: Column) -> Column:
        margin = F.array_min(F.transform(ls, lambda x: x["x0"]))
        def build(m: Column) -> Column:
            def block(xs: Column, at: Column) -> Column:
                first = F.get(xs, F.lit(0))["x0"]
                indent = F.when(at == 0, 0).when(first > m + 35, 2).when(first > m + 15, 1).otherwise(0)
                text = joined(F.filter(F.transform(xs, lambda x: strip(x["text"])), lambda t: t != ""), " ")
                low, high = (lambda f: F.array_min(F.transform(xs, lambda x: x[f]))), (lambda f: F.array_max(F.transform(xs, lambda x: x[f])))
                return F.struct(text.alias("text"), indent.alias("indent"), F.size(xs).alias("n_lines"), low("x0").alias("x0"), high("x1").alias("x1"),
                                low("top").alias("top"), high("bottom").alias("bottom"),
                                _dominant(xs, lambda x: F.length(x["text"]), lambda x: x["font"]).alias("font"))
            return runs_of(ls, starts, block)
        return let(margin, build)
    found = let(F.col("lines"), lambda ls: F.when(F.size(ls) > 0, run(ls)))
    names = ("text", "indent", "n_lines", "x0", "x1", "top", "bottom", "font")
    return unroll(pages, ["doc_id", "page"], found, "block_no", {n: field(n) for n in names})


def block_classify(blocks: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Block type from the font's level, weight, list marks, typeface and code signs."""
    h = hierarchy.select("doc_id", "font_key", "level", "body_size")
    t, font = strip("text"), F.col("font")
    skip = any_of(t, SKIPPED)
    body = (F.abs(font["size"] - F.col("body_size")) < 0.5) & ~font["bold"]
    diff = font["size"] - F.col("body_size")
    code_words = F.lit(0)
    for w in CODE:
        code_words = code_words + t.contains(w).cast("int")
    br, bc, semi = t.contains("(") & t.contains(")"), t.contains("{") & t.contains("}"), t.contains(";")
    eq = t.contains("=") & ~t.startswith("=")
    signs = br.cast("int") + bc.cast("int") + semi.cast("int") + eq.cast("int")
    code = F.length(t).between(16, 500) & ((bc & semi) | (br & semi & eq) | ((code_words >= 2) & (signs >= 2)))
    mono = F.lit(False)
    for m in MONO:
        mono = mono | F.lower(font["name"]).contains(m)
    dash = t.rlike(rf"^[{DASHES}]\s*\p{{Lu}}") & (F.length(t) > 2)
    lev = F.col("level")
    kind = (F.when(t == "", "body").when(lev.isNotNull() & (F.length(t) < 200), F.when(skip, "skip").otherwise(lev))
            .when(font["bold"] & ~body & (F.length(t) < 100) & (F.col("n_lines") <= 2),
                  F.when(skip, "skip").when(diff > 4, "h2").when(diff > 1, "h3").otherwise("h4"))
            .when(font["bold"] & (F.length(t) < 80) & (F.col("n_lines") == 1), "h4")
            .when(t.rlike(f"^[{BULLETS}]") | dash, "list").when(t.rlike(NUMBERED), "ordered_list").when(mono | code, "code").otherwise("body"))
    return (blocks.withColumn("font_key", font["key"]).join(h, ["doc_id", "font_key"], "left")
            .select("doc_id", "page", "block_no", kind.alias("type"), "text"))


def size_thresholds(pages: DataFrame, h1: float = 1.6, h2: float = 1.3, h3: float = 1.1) -> DataFrame:
    """Upper median of the span sizes (element n div 2, not interpolated) and heading limits over it.

    Sizes are counted first, so the running count sees one row per distinct size.
    """
    s = unroll(pages, ["doc_id"], "spans", "n", {"size": field("font_size")})
    n = s.groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("doc_id").orderBy("size"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    half = n.withColumn("_u", upto).withColumn("_t", total).filter(F.col("_u") > F.floor(F.col("_t") / 2))
    m = half.groupBy("doc_id").agg(F.min("size").alias("median_size"))
    limit = lambda k, floor: F.greatest(F.col("median_size") * k, F.lit(floor))
    return m.select("doc_id", "median_size", limit(h1, 28.0).alias("h1"), limit(h2, 22.0).alias("h2"), limit(h3, 16.0).alias("h3"))
