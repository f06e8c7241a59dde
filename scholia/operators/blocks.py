"""Passes over extracted text blocks.

A document's blocks are one array column of its row, in reading order. Passes map, filter or fold that
array, so a chain of passes stays in one stage: no block is shuffled and none is gathered.
"""

from __future__ import annotations

import functools
import operator
import re
from collections import defaultdict
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.text import CHUNK, Folded, any_of, field, first_where, fold_out, joined, let, runs_of, strip, trim, trim_bound, unroll, words
from scholia.operators.cleaning import is_noise, looks_like_code

BLOCK = "struct<pos:int,page:int,y:double,type:string,text:string,font_size:double,indent:int>"
FIELDS = ("pos", "page", "y", "type", "text", "font_size", "indent")
# Signs that open list items.
BULLETS = "•‣◦⁃∙►▪▸➤➢"
DASHES = "–—‐‑\\-"


def change(b: Column, **new: Column) -> Column:
    """The block with some fields replaced."""
    return F.struct(*[new[f].alias(f) if f in new else b[f].alias(f) for f in FIELDS]).cast(BLOCK)


def heading(b: Column) -> Column:
    return b["type"].startswith("h")


def either(value: Column, *options: str | int) -> Column:
    """One of a few values. ``isin`` leaves its loop by an exception when it finds one, which takes far longer than to compare."""
    return functools.reduce(operator.or_, [value == x for x in options])


def listed(b: Column) -> Column:
    return either(b["type"], "list", "ordered_list")


def none() -> Column:
    return F.array().cast(f"array<{BLOCK}>")


def each(docs: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """``fn`` maps the array of blocks of every document."""
    return docs.withColumn("blocks", let(F.col("blocks"), fn))


def flat_map(docs: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """``fn`` gives the blocks that take the place of one."""
    return docs.withColumn("blocks", F.flatten(F.transform("blocks", lambda b: fn(b))))


def rows(docs: DataFrame) -> DataFrame:
    return unroll(docs, ["doc_id"], "blocks", "seq", {f: field(f) for f in FIELDS})


def union_sort(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Text and table block rows in page and height order: a range sort over all documents."""
    return blocks.unionByName(tables).orderBy("doc_id", "page", "y", "pos")


def repeated(values: Column) -> Column:
    """Whether an equal value came earlier, for each element: by sorting, not by comparing all pairs."""
    def flags(s: Column) -> Column:
        same = F.transform(s, lambda v, i: F.struct(v["i"].alias("i"), F.coalesce(F.get(s, i - 1)["v"] == v["v"], F.lit(False)).alias("d")))
        return F.transform(F.array_sort(same), lambda x: x["d"])
    tagged = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return let(F.array_sort(tagged), flags)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Later copies of a text over 10 characters go if they are headings or under 200 characters."""
    def run(blocks: Column) -> Column:
        def keep(norms: Column, dup: Column) -> Column:
            def test(b: Column, i: Column) -> Column:
                n = F.length(F.get(norms, i))
                return ~(F.get(dup, i) & (n > 10) & (heading(b) | (n < 200)))
            return F.filter(blocks, test)
        norms = F.transform(blocks, lambda b: F.lower(trim_bound(b["text"])))
        return let(norms, lambda v: let(repeated(v), lambda d: keep(v, d)))
    return each(docs, lambda bs: let(F.filter(bs, lambda b: b["type"] != "skip"), run))


class Overlaps:
    """Texts by key, found again by a text that is equal, or that is over 10 characters long and lies within theirs or around theirs.

    Texts under 4 characters are related to none. Few texts are compared one by one. Once there are more, each text is filed under its pieces of 4
    characters, and once more under the one that was rarest when it came: what holds the wanted text holds its rarest piece, what lies within it has
    its own one there. So a lookup tests few texts, however many there are.
    """

    SIZE, LONG, FEW = 4, 10, 32

    def __init__(self) -> None:
        self.texts: dict[str, tuple[int, str]] = {}
        self.anchors: dict[str, str] = {}
        self.anchored: dict[str, set[str]] = defaultdict(set)
        self.holders: dict[str, set[str]] = defaultdict(set)
        self.added = 0
        self.filed = False

    def _pieces(self, text: str) -> set[str]:
        return {text[i:i + self.SIZE] for i in range(len(text) - self.SIZE + 1)}

    def _file(self, key: str, text: str) -> None:
        pieces = self._pieces(text)
        if pieces:
            self.anchors[key] = min(pieces, key=lambda p: len(self.holders[p]))
            self.anchored[self.anchors[key]].add(key)
        for piece in pieces:
            self.holders[piece].add(key)

    def add(self, key: str, text: str) -> None:
        self.texts[key] = self.added, text
        self.added += 1
        if self.filed:
            self._file(key, text)
        elif len(self.texts) > self.FEW:
            self.filed = True
            for k, (_, t) in self.texts.items():
                self._file(k, t)

    def remove(self, key: str) -> None:
        _, text = self.texts.pop(key)
        if self.filed:
            for piece in self._pieces(text):
                self.holders[piece].discard(key)
            if key in self.anchors:
                self.anchored[self.anchors.pop(key)].discard(key)

    def related(self, text: str) -> list[str]:
        """Keys in the order in which they were added."""
        if len(text) < self.SIZE:
            return []
        if not self.filed:
            long = len(text) > self.LONG
            found = {k for k, (_, t) in self.texts.items() if t == text or (long and len(t) >= self.SIZE and (text in t or t in text))}
            return sorted(found, key=self.texts.__getitem__)
        pieces = self._pieces(text)
        around = min((self.holders.get(p, set()) for p in pieces), key=len)
        if len(text) > self.LONG:
            within = set().union(*(self.anchored.get(p, ()) for p in pieces))
            found = {k for k in around if text in self.texts[k][1]} | {k for k in within if self.texts[k][1] in text}
        else:
            found = {k for k in around if text == self.texts[k][1]}
        return sorted(found, key=self.texts.__getitem__)


# The number before a heading and the mark of a continued one.
_NUMBERED, _CONTINUED = re.compile(r"^\d+(?:\.\d+)*\s*"), re.compile(r"\s*\(cont\.?(?:inued)?\).*$", re.I)


def heading_survivors(kinds: Iterable[str], lines: Iterable[str]) -> list[bool]:
    """Which blocks stay when related headings of a document are reduced to the most specific one."""
    stays: list[bool] = []
    live, by_text = Overlaps(), defaultdict(list)  # headings without "(cont.)", related by what follows their numbers
    for i, (kind, line) in enumerate(zip(kinds, lines)):
        stays.append(True)
        if not kind.startswith("h"):
            continue
        full = _CONTINUED.sub("", line).strip().lower()
        bare = _NUMBERED.sub("", full).strip()
        if full in live.texts:
            stays[i] = False
            continue
        for other in live.related(bare):
            if len(full) < len(other):
                stays[i] = False
                break
            live.remove(other)
            for j in by_text.get(other, []):
                stays[j] = False
        if stays[i]:
            live.add(full, bare)
            by_text[line.strip().lower()].append(i)
    return stays


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _distinct_headings(types: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([heading_survivors(k, t) for k, t in zip(types, texts)])


def fuzzy_heading_dedup(docs: DataFrame) -> DataFrame:
    """Of headings equal up to numbering, ``(cont.)`` or containment, the longer and later stays.

    Which heading wins depends on those still standing, so a small Arrow function marks the keepers.
    """
    lines = F.transform("blocks", lambda b: F.when(heading(b), b["text"]))
    marked = docs.withColumn("_keep", _distinct_headings(F.col("blocks.type"), lines))
    kept = F.filter(F.arrays_zip("blocks", "_keep"), lambda z: z["_keep"])
    return marked.withColumn("blocks", F.transform(kept, lambda z: z["blocks"])).drop("_keep")


def layout_resolve(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Font type against layout type per block row: the font type leads, layout confirms."""
    t, lay, n = F.col("type"), F.col("layout_type"), F.length("text")
    h = t.startswith("h")
    lh = lay.startswith("h")
    final = (F.when((lay == "skip") & (t == "body"), "skip").when((t == "body") & lh & (n < 100), lay)
             .when(h & (lay == "body") & (n > 150), "body").when((lay == "list") & (t == "body"), "list").otherwise(t))
    conf = (F.when(h & lh, 0.95).when((t == "body") & lh & (n < 100), 0.7).when(h & (lay == "body") & (n > 150), 0.8)
            .when((lay == "list") & (t == "body"), 0.75).otherwise(1.0))
    return blocks.join(labels, ["doc_id", "pos"], "left").withColumn("confidence", conf).withColumn("type", final)


def heading_rank(docs: DataFrame) -> DataFrame:
    """Heading level from the rank of its font size; module and numbered headings have their own level."""
    def run(blocks: Column) -> Column:
        used = F.transform(F.filter(blocks, lambda b: heading(b) & (b["font_size"] > 0)), lambda b: F.bround(b["font_size"], 1))
        def level(sizes: Column) -> Column:
            def one(b: Column) -> Column:
                def ranked(text: Column) -> Column:
                    parts = F.regexp_extract(text, r"^(\d+(?:\.\d+)+)\s+.+$", 1)
                    rank = F.array_position(sizes, F.bround(b["font_size"], 1))
                    by_rank = lambda r: (F.when(r.between(1, 3), F.concat(F.lit("h"), r.cast("string"))).when(r > 3, "body").otherwise(b["type"]))
                    numbered = lambda x: F.when(x != "", F.when(F.size(F.split(x, r"\.")) == 2, "h2").otherwise("h3")).otherwise(let(rank, by_rank))
                    return (F.when(F.length(text) > 160, "body").when(text.rlike(r"(?i)^(?:Module|Chapter|Unit)\s+\d+"), "h1")
                            .otherwise(let(parts, numbered)))
                return change(b, type=F.when(~heading(b), b["type"]).otherwise(let(trim_bound(b["text"]), ranked)))
            return F.transform(blocks, one)
        return let(F.sort_array(F.array_distinct(used), asc=False), level)
    return each(docs, run)


# What decides about a block reaches no further than this into its text from either end.
REACH = 1000
LIGHT = "struct<type:string,page:int,indent:int,head:string,tail:string,brief:boolean,bullets:boolean,open:int>"
NEW, SPACED, GLUED, SAME, OTHER = range(5)


def _light(b: Column, reach: int | None, **facts: Callable[[Column], Column]) -> Column:
    """What a fold needs of a block, worked out once: both ends of its text, and the ``facts`` that its rule asks for."""
    def cut(x: Column, right: bool) -> Column:
        return x if reach is None else F.when(F.octet_length(x) > reach, F.right(x, F.lit(reach)) if right else F.left(x, F.lit(reach))).otherwise(x)
    def ends(t: Column) -> Column:
        found = [(facts[k](t) if k in facts else F.lit(None)).alias(k) for k in ("brief", "bullets", "open")]
        return F.struct(b["type"].alias("type"), b["page"].alias("page"), b["indent"].alias("indent"), cut(t, False).alias("head"),
                        cut(b["text"], True).alias("tail"), *found).cast(LIGHT)
    return let(trim_bound(b["text"]), ends)


def fewer_words(n: int) -> Callable[[Column], Column]:
    """Whether a text without white space at its ends has fewer words: those after the n-th are not looked for."""
    return lambda t: ~t.rlike(rf"(?U)^\S++(?:\s++\S++){{{n - 1}}}")


def has_bullets(text: Column) -> Column:
    """One range is found faster than ten signs, which all lie in it."""
    return (F.octet_length(text) > F.length(text)) & text.rlike(f"[{min(BULLETS)}-{max(BULLETS)}]") & text.rlike(f"[{BULLETS}]")


def starts(text: Column, pattern: str, n: int = 1) -> Column:
    """Whether the first characters match; a pattern tied to the start of a longer text would still be tried at each of its places."""
    return F.left(text, F.lit(n)).rlike(f"^{pattern}")


def unclosed(text: Column) -> Column:
    """Opening parentheses less closing ones."""
    return F.length(F.replace(text, F.lit(")"), F.lit(""))) - F.length(F.replace(text, F.lit("("), F.lit("")))


def ends_in(text: Column, marks: str) -> Column:
    """Whether a text without white space at its end ends in one of the characters."""
    return functools.reduce(operator.or_, [text.endswith(m) for m in marks])


def _merged(blocks: Column, rule: Callable[[Column, Column], Column], reach: int | None = REACH, **facts: Callable[[Column], Column]) -> Column:
    """Blocks joined to the one before them: ``rule(last, block)`` says how, from what ``_light`` tells (``brief`` of the next block only) of what was merged so
    far and of the next block.

    NEW: not at all; SPACED: with a space; GLUED: after taking off the hyphen; SAME: the block goes; OTHER: it takes the place of the last one. The fold carries
    numbers and the ends of texts, and the places where blocks begin are cut out afterwards, so nothing grows with the length of what is merged.
    """
    def step(a: Folded, b: Column) -> Column:
        last = a["last"]
        def after(code: Column) -> Column:
            end = lambda x, sep: F.concat(x, F.lit(sep), b["tail"])
            tail = F.when(code == SPACED, end(last["tail"], " ")).otherwise(end(F.regexp_replace(last["tail"], r"[-–—]$", ""), ""))
            joined_ = F.struct(last["type"].alias("type"), last["page"].alias("page"), last["indent"].alias("indent"), last["head"].alias("head"),
                               (F.right(tail, F.lit(reach)) if reach else tail).alias("tail"), b["brief"].alias("brief"),
                               (last["bullets"] | b["bullets"]).alias("bullets"), (last["open"] + b["open"]).alias("open")).cast(LIGHT)
            now = F.when(either(code, NEW, OTHER), b).when(code == SAME, last).otherwise(joined_)
            return F.struct(now.alias("last"), F.array(code).cast("array<int>").alias("_new"))
        return let(F.coalesce(rule(last, b), F.lit(NEW)), after)

    def build(bs: Column, codes: Column) -> Column:
        def run(part: Column, at: Column) -> Column:
            code = lambda i: F.get(codes, at + i)
            places = F.sequence(F.lit(0), F.size(part) - 1)
            base = F.coalesce(F.array_max(F.filter(places, lambda i: code(i) == OTHER)), F.lit(0))
            def text(i: Column) -> Column:
                own = F.get(part, i)["text"]
                bare = F.when(F.coalesce(code(i + 1) == GLUED, F.lit(False)) & (i + 1 < F.size(part)), F.regexp_replace(own, r"[-–—]$", "")).otherwise(own)
                return F.concat(F.when((i > 0) & (code(i) == SPACED), F.lit(" ")).otherwise(""), bare)
            def whole(k: Column) -> Column:
                more = F.transform(F.filter(places, lambda i: (i == k) | ((i > k) & either(code(i), SPACED, GLUED))), text)
                return change(F.get(part, k), text=joined(more, ""))
            return F.when(F.size(part) == 1, F.get(part, F.lit(0)).cast(BLOCK)).otherwise(let(base, whole))
        tagged = F.zip_with(bs, codes, lambda b, c: F.struct(b.alias("b"), c.alias("c")))
        return runs_of(tagged, lambda p, x: x["c"] == NEW, lambda part, at: let(F.transform(part, lambda x: x["b"]), lambda p: run(p, at)))

    def folded(bs: Column) -> Column:
        lights = F.transform(bs, lambda b: _light(b, reach, **facts))
        codes = let(lights, lambda v: fold_out(F.slice(v, 2, F.greatest(F.size(v), F.lit(1))), {"last": F.get(v, F.lit(0))}, step, "int"))
        return let(F.concat(F.array(F.lit(NEW)), codes), lambda c: F.when(F.exists(c, lambda x: x != NEW), build(bs, c)).otherwise(bs.cast(f"array<{BLOCK}>")))
    return F.when(F.size(blocks) > 0, folded(blocks)).otherwise(none())


def heading_jumps(docs: DataFrame) -> DataFrame:
    """No level skipped, one H1, no heading repeated right after itself.

    The lowered level of a heading is the least of (level + distance) over the headings before it:
    levels end at 6, so the last six decide and nothing needs to run along the document.
    """
    def lowered(blocks: Column) -> Column:
        level = lambda b: F.substring(b["type"], 2, 1).try_cast("int")
        def put(levels: Column, places: Column, before: Column) -> Column:
            def new(b: Column, i: Column) -> Column:
                run = F.floor(i / CHUNK).cast("int")
                def at(k: Column) -> Column:
                    near = F.transform(F.sequence(F.lit(0), F.least(F.lit(5), k - 1)), lambda d: F.get(levels, k - 1 - d) + d)
                    return change(b, type=F.concat(F.lit("h"), F.array_min(near).cast("string")))
                return F.when(heading(b), let((F.get(before, run) + F.array_position(F.get(places, run), i)).cast("int"), at)).otherwise(b)
            return F.transform(blocks, new)
        # The number of a heading: those in the runs of blocks before its own, and its place among those of its run.
        def placed(heads: Column) -> Column:
            spots = lambda at: F.filter(F.sequence(at, F.least(at + CHUNK, F.size(heads)) - 1), lambda i: F.get(heads, i))
            places = F.transform(F.sequence(F.lit(0), F.size(heads) - 1, F.lit(CHUNK)), spots)
            total = lambda a, x: ({"n": a["n"] + F.size(x)}, F.array(a["n"]))
            levels = F.transform(F.filter(blocks, heading), level)
            return let(places, lambda p: let(fold_out(p, {"n": F.lit(0)}, total, "int"), lambda n: let(levels, lambda v: put(v, p, n))))
        return F.when(F.exists(blocks, heading), let(F.transform(blocks, heading), placed)).otherwise(blocks)

    def single(blocks: Column) -> Column:
        def mark(first: Column, top: Column) -> Column:
            def new(b: Column, i: Column) -> Column:
                return (F.when((b["type"] == "h1") & (i + 1 != first), change(b, type=F.lit("h2")))
                        .when((first == 0) & (i + 1 == top), change(b, type=F.lit("h1"))).otherwise(b))
            return F.transform(blocks, new)
        types = F.transform(blocks, lambda b: b["type"])
        heads = F.transform(blocks, heading)
        return let(F.array_position(types, "h1"), lambda f: let(F.array_position(heads, True), lambda t: mark(f, t)))

    def merge(last: Column, b: Column) -> Column:
        both = heading(last) & heading(b)
        same = F.lower(trim_bound(last["tail"])) == F.lower(trim_bound(b["tail"]))
        return F.when(both & same, SAME).when(both & (F.length(last["tail"]) < 3) & (last["type"] == b["type"]), OTHER)

    def merged(blocks: Column) -> Column:
        follows = F.exists(F.sequence(F.lit(1), F.size(blocks) - 1), lambda i: heading(F.get(blocks, i - 1)) & heading(F.get(blocks, i)))
        return F.when((F.size(blocks) > 1) & follows, _merged(blocks, merge, None)).otherwise(F.coalesce(blocks, none()))

    return each(docs, lambda bs: _let_chain(bs, lowered, single, merged))


def _let_chain(value: Column, *steps: Callable[[Column], Column]) -> Column:
    out = value
    for s in steps:
        out = let(out, s)
    return out


def split_bullets(docs: DataFrame) -> DataFrame:
    """Two or more inline bullets make one list block per item; a single one is read or removed."""
    def marked(b: Column, text: Column) -> Column:
        single = F.when(text.rlike(f"^[{BULLETS}]"), change(b, type=F.lit("list"))).otherwise(
            change(b, text=trim(F.regexp_replace(b["text"], f"[{BULLETS}]", ""))))
        # One part more than bullets.
        def several(parts: Column) -> Column:
            items = F.filter(F.transform(parts, lambda x: trim(x)), lambda x: F.length(x) > 1)
            many = lambda v: F.when(F.size(v) > 0, F.transform(v, lambda x: change(b, type=F.lit("list"), text=x))).otherwise(F.array(b.cast(BLOCK)))
            return F.when(F.size(parts) == 2, F.array(single)).otherwise(let(items, many))
        return let(F.split(text, f"[{BULLETS}]"), several)
    def one(b: Column) -> Column:
        return F.when(has_bullets(b["text"]), let(trim_bound(b["text"]), lambda t: marked(b, t))).otherwise(F.array(b.cast(BLOCK)))
    return flat_map(docs, one)


# Fixed value: how ordered items begin.
ORDERED = r"^(?:\()?([0-9a-zA-Z]|[ivxIVX]+)(?:\.|\))(?:\s+|$)"
ORDERED_START = r"\(?(?:[0-9a-zA-Z][.)]|[ivxIVX]{2})"


def list_format(docs: DataFrame) -> DataFrame:
    """Ordered and dashed list blocks recognised, their dashes removed; a dash stuck to a sentence is cut."""
    def formatted(b: Column, text: Column) -> Column:
        bare = F.regexp_replace(text, f"^[{DASHES} ]+", "")
        def told(ordered: Column, dashed: Column) -> Column:
            kind = F.when(ordered, "ordered_list").when(dashed & (b["type"] == "body"), "list").otherwise(b["type"])
            def put(v: Column) -> Column:
                trimmed = lambda x: F.when(starts(x, f"[{DASHES}]"), trim(F.regexp_replace(x, rf"^[{DASHES}]+\s*", ""))).otherwise(trim_bound(x))
                new = (F.when(either(v["kind"], "list", "ordered_list"), trimmed(v["body"]))
                       .when((v["kind"] == "body") & v["body"].contains("-"), F.regexp_replace(v["body"], r"([:\.])\s*-([A-Z])", "$1 $2")).otherwise(v["body"]))
                return change(b, type=v["kind"], text=new)
            return let(F.struct(kind.alias("kind"), F.when(dashed, bare).otherwise(b["text"]).alias("body")), put)
        marked = lambda o: let(~o & starts(text, f"[{DASHES}].", 2) & (bare != ""), lambda d: told(o, d))
        return let(starts(text, ORDERED_START, 3) & text.rlike(ORDERED), marked)
    def one(b: Column) -> Column:
        return let(trim_bound(b["text"]), lambda t: F.when(t == "", b.cast(BLOCK)).otherwise(formatted(b, t)))
    return docs.withColumn("blocks", F.transform("blocks", one))


# Words after which a sentence goes on.
CONNECTORS = ["and", "or", "the", "of", "with", "to", "in", "a", "an", "for", "from", "by", "on", "at", "as", "is", "are", "was", "were", "be",
              "been", "being", "that", "which", "such", "including", "like", "than", "into"]


def merge_continuations(docs: DataFrame) -> DataFrame:
    """Join a block to the one before it where the sentence visibly goes on."""
    def step(p: Column, b: Column) -> Column:
        # Cheap tests come first, as the others are then often not needed.
        t = b["head"]
        lower = starts(t, r"\p{Ll}")
        first = F.regexp_extract(t, r"^\S+", 0)
        def joins(pt: Column) -> Column:
            last = F.lower(F.regexp_extract(pt, r"\S+$", 0))
            open_end = ~ends_in(pt, ".!?:\"'")
            linked = lambda marks: F.regexp_replace(last, f"[{marks}]+$", "").isin(CONNECTORS)
            body = (lower | (open_end & ((b["indent"] > 0) | (~ends_in(pt, ")") & (ends_in(pt, ",:;") | b["brief"] | ~F.right(pt, F.lit(10)).rlike("[.!?]") | linked(".,;:"))))))
            after_list = (lower | t.startswith("(") | (~ends_in(pt, ".!?") & starts(t, r"\p{Lu}") & (F.length(first) <= 5) & first.rlike("[,).]$"))
                          | (open_end & F.lower(first).isin(CONNECTORS)) | linked(","))
            items = lower & ~((F.length(pt) < 40) & (F.length(t) < 40))
            return (pt != "") & (F.when((p["type"] == "body") & (b["type"] == "body"), body)
                                 .when(listed(p) & (b["type"] == "body"), after_list).when(listed(p) & listed(b), items).otherwise(False))
        blocked = (either(p["type"], "table", "code") | either(b["type"], "table", "code") | heading(p) | heading(b) | (t == "")
                   | p["bullets"] | b["bullets"] | (p["page"] != b["page"]))
        hyphen = F.right(p["tail"], F.lit(5)).rlike(r"(?s)^.+\p{L}[-–—]$")
        return F.when(~blocked, F.when(let(trim_bound(p["tail"]), joins), F.when(hyphen, GLUED).otherwise(SPACED)))
    return each(docs, lambda bs: _merged(bs, step, brief=fewer_words(3), bullets=has_bullets))


def list_wrapping(docs: DataFrame) -> DataFrame:
    """Join list items that were wrapped onto the next block or left a parenthesis open."""
    def step(p: Column, b: Column) -> Column:
        t = b["head"]
        usable = listed(p) & (listed(b) | (b["type"] == "body")) & (p["page"] == b["page"]) & (t != "")
        def joins(pt: Column) -> Column:
            wrapped = (~ends_in(pt, ".!?:") & starts(t, r"\p{Ll}")) | (~ends_in(pt, ".!?") & b["brief"])
            short = (F.length(pt) < 40) & (F.length(t) < 40)
            return F.when(pt != "", F.when(~short & wrapped, F.when(p["tail"].endswith("-"), GLUED).otherwise(SPACED)).when(p["open"] > 0, SPACED))
        return F.when(usable, let(trim_bound(p["tail"]), joins))
    return each(docs, lambda bs: _merged(bs, step, brief=fewer_words(5), open=unclosed))


def orphan_body(docs: DataFrame) -> DataFrame:
    """Short body between two list blocks becomes a list block of the kind before it."""
    def run(blocks: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            p, n = F.get(blocks, i - 1), F.get(blocks, i + 1)
            hit = (b["type"] == "body") & listed(p) & listed(n) & (b["page"] == p["page"]) & (F.length(b["text"]) < 100)
            return F.when(hit, change(b, type=p["type"])).otherwise(b.cast(BLOCK))
        return F.transform(blocks, one)
    return each(docs, run)


# Fixed value: words that head a list.
LABEL = r"(?:Advantages|Disadvantages|Features|Benefits|Drawbacks|Characteristics|Properties|Types|Examples|Steps|Requirements)\s+(?:of\s+)?"


def split_list_headers(docs: DataFrame) -> DataFrame:
    """A list item that ends in the label of the next list gives up that label as a bold body block."""
    pattern = rf"(?i)^(.+?)\s+({LABEL}[^:]*:\s*)$"
    def split(b: Column, text: Column) -> Column:
        item, label = (trim(F.regexp_extract(text, pattern, i)) for i in (1, 2))
        bold = change(b, type=F.lit("body"), text=F.concat(F.lit("**"), label, F.lit("**")))
        return let(item, lambda x: F.when(F.length(x) > 5, F.array(change(b, text=x), bold)).otherwise(F.array(b.cast(BLOCK))))
    def one(b: Column) -> Column:
        text = trim_bound(b["text"])
        return F.when(listed(b) & text.endswith(":"), let(text, lambda t: split(b, t))).otherwise(F.array(b.cast(BLOCK)))
    return flat_map(docs, one)


def redundant_metadata(docs: DataFrame) -> DataFrame:
    """Module title lines, repeated titles and repeated module headings removed or reduced."""
    def run(blocks: Column, title: Column) -> Column:
        state = {"prev": F.lit(None).cast("string"), "module": F.lit(False), "h1": F.lit(False)}
        def told(a: Folded, b: Column, t: Column) -> Column:
            objective = trim(F.regexp_extract(t, r"(?i)(?:Module\s+)?Objective:\s*(.+)$", 1))
            bold = lambda x: change(b, text=F.concat(F.lit("**Objective:** "), x))
            rest = trim(F.regexp_extract(t, r"(?i)^Module\s+\d+\s*[–—\-]\s*(.+)", 1))
            echo = ((title != "") & a["prev"].isNotNull() & (F.length(t) < F.length(title) + 15) & F.lower(t).contains(title)
                    & ((F.lower(a["prev"]) == F.lower(t)) | (F.regexp_count(t, F.lit(" ")) < 4)))
            first = (b["type"] == "h1") & ~a["h1"]
            named = starts(t, r"(?i)(?:\*\*)?Module", 8)
            titled, standalone = named & t.rlike(r"(?i)^(?:\*\*)?Module\s+Title"), named & t.rlike(r"(?i)^Module\s+Objective:\s*")
            module = heading(b) & starts(t, "(?i)(?:Module|Chapter|Unit)", 7) & t.rlike(r"(?i)^(?:Module|Chapter|Unit)\s+\d+")
            one = lambda x: F.array_compact(F.array(x))
            kept = (F.when(first, one(b.cast(BLOCK))).when(titled, F.when(objective != "", one(bold(objective))).otherwise(none()))
                    .when(standalone, one(change(b, text=F.regexp_replace(t, r"(?i)^Module\s+Objective:", "**Objective:**")))).when(echo, none()))
            again = F.when(rest != "", one(change(b, type=F.lit("h3"), text=rest))).otherwise(none())
            def put(k: Column, reached: Column) -> Column:
                return F.struct(F.coalesce(F.get(k, F.lit(0))["text"], a["prev"]).alias("prev"), (a["module"] | reached).alias("module"),
                                (a["h1"] | first).alias("h1"), k.alias("_new"))
            return let(kept, lambda k: F.when(k.isNotNull(), put(k, F.lit(False))).otherwise(
                let(module, lambda m: let(F.when(m & a["module"], again).otherwise(one(b.cast(BLOCK))), lambda v: put(v, m & ~first)))))
        def add(a: Folded, b: Column) -> Column:
            return let(trim_bound(b["text"]), lambda t: told(a, b, t))
        return fold_out(blocks, state, add, BLOCK)
    top = lambda bs: F.coalesce(F.lower(trim(first_where(bs, lambda b: b["type"] == "h1")["text"])), F.lit(""))
    return each(docs, lambda bs: let(top(bs), lambda h: run(bs, h)))


# Fixed value: worked examples within a line. The words repeat without stepping back, so a long line needs no deep stack.
EXAMPLE = r"(?:^|\s)([A-Z][a-z]+(?:\s+[a-z]+)*+\s*:\s*\S+\s*=\s*[01]+)"


def split_examples(docs: DataFrame) -> DataFrame:
    """A body line with two or more ``Label: x = bits`` gives its lead-in and one block per example."""
    def split(b: Column, text: Column) -> Column:
        def parts(found: Column) -> Column:
            lead = trim(F.try_element_at(F.split(text, EXAMPLE, 2), F.lit(1)))
            def bold(x: Column) -> Column:
                return F.concat(F.lit("**"), trim(F.substring_index(x, ":", 1)), F.lit(":** "), trim(F.regexp_replace(x, "^[^:]*:", "")))
            texts = F.concat(F.filter(F.array(lead), lambda x: x != ""), F.transform(found, bold))
            return F.when(F.size(found) >= 2, F.transform(texts, lambda x: change(b, text=x))).otherwise(F.array(b.cast(BLOCK)))
        return let(F.regexp_extract_all(text, F.lit(EXAMPLE), F.lit(1)), parts)
    def one(b: Column) -> Column:
        whole = (b["type"] == "body") & b["text"].contains("=") & b["text"].contains(":")
        return F.when(whole, let(trim_bound(b["text"]), lambda t: split(b, t))).otherwise(F.array(b.cast(BLOCK)))
    return flat_map(docs, one)


def list_header_extract(docs: DataFrame) -> DataFrame:
    """A label that closes a body block before a list becomes its own bold block; a lone label turns bold."""
    tail = rf"(?is)^(.*?\.\s+)({LABEL}[^:]{{0,40}}:\s*)$"
    alone = rf"(?i)^({LABEL}[^:]*:\s*)$"
    def run(blocks: Column) -> Column:
        def split(b: Column, i: Column, text: Column) -> Column:
            nxt = F.coalesce(listed(F.get(blocks, i + 1)), F.lit(False))
            bold = lambda x: change(b, text=F.concat(F.lit("**"), x, F.lit("**")))
            label = trim(F.regexp_extract(text, tail, 2))
            lone = F.when(text.rlike(alone), F.array(bold(text))).otherwise(F.array(b.cast(BLOCK)))
            cut = lambda body: F.when(body != "", F.array(change(b, text=body), bold(label))).otherwise(lone)
            return F.when(nxt, let(trim(F.regexp_extract(text, tail, 1)), cut)).otherwise(lone)
        def one(b: Column, i: Column) -> Column:
            text = trim_bound(b["text"])
            return F.when((b["type"] == "body") & text.endswith(":"), let(text, lambda t: split(b, i, t))).otherwise(F.array(b.cast(BLOCK)))
        return F.flatten(F.transform(blocks, one))
    return each(docs, run)


def clean_pipeline(docs: DataFrame) -> DataFrame:
    """All passes in their order; list formatting runs twice."""
    for step in (exact_dedup, fuzzy_heading_dedup, heading_rank, heading_jumps, split_bullets, list_format, merge_continuations, list_wrapping,
                 list_format, orphan_body, split_list_headers, redundant_metadata, split_examples, list_header_extract):
        docs = step(docs)
    return docs


# Marks of Java code.
JAVA = ["public class", "public static void", "System.out", "String[] args", "import java"]


def to_markdown(docs: DataFrame) -> DataFrame:
    """Blocks of a document as Markdown with page marks.

    What stands between two blocks depends only on the pair: list after list or body is tight, a
    caption after body too, everything else and every new page is set off by a blank line. So each
    block renders on its own and the texts are joined.
    """
    def body(text: Column) -> Column:
        pattern = r"^([A-Z][a-zA-Z0-9\s/()]+?)\s*[-–—:]\s+(.+)$"
        def defined(term: Column) -> Column:
            meaning = trim(F.regexp_extract(text, pattern, 2))
            return F.when((F.length(term) > 0) & (F.length(term) < 40), F.concat(F.lit("**"), term, F.lit(":** "), meaning)).otherwise(text)
        # The first group begins with a letter, so it is empty only where nothing matches.
        return F.when((F.octet_length(text) <= 480) & (F.length(text) <= 120), let(trim(F.regexp_extract(text, pattern, 1)), defined)).otherwise(text)

    def item(text: Column) -> Column:
        t = F.regexp_replace(text, rf"^[{BULLETS}{DASHES}]+\s*", "")
        t = F.regexp_replace(t, r"^\* ", "")
        return F.when(starts(text, rf"[{BULLETS}{DASHES}*\d]"), trim(F.regexp_replace(t, r"^\d+[.)\\]\s*", ""))).otherwise(text)

    def render(b: Column, t: Column) -> Column:
        lang = F.when(any_of(t, [re.escape(m) for m in JAVA]), "java").otherwise("")
        safe = lambda x: let(x, lambda v: F.when(v.contains("<"), F.regexp_replace(v, "<(?!!--)", "&lt;")).otherwise(v))
        mark = F.concat(F.repeat(F.lit("  "), F.least(b["indent"], F.lit(1))), F.when(b["type"] == "list", "- ").otherwise("1. "))
        title = F.when(t.contains("("), trim(F.regexp_replace(t, r"(?i)\s*\(cont\.?(?:inued)?\).*$", ""))).otherwise(t)
        return (F.when(heading(b), safe(F.concat(F.repeat(F.lit("#"), F.substring(b["type"], 2, 1).try_cast("int")), F.lit(" "), title)))
                .when(b["type"] == "table", safe(b["text"])).when(listed(b), safe(F.concat(mark, item(t))))
                .when(b["type"] == "code", F.concat(F.lit("```"), lang, F.lit("\n"), t, F.lit("\n```")))
                .when(b["type"] == "body", safe(body(t))).when(b["type"] == "caption", safe(F.concat(F.lit("*"), t, F.lit("*")))))

    def weave(bs: Column) -> Column:
        def piece(b: Column, i: Column) -> Column:
            p = F.get(bs, i - 1)
            page = F.concat(F.lit("<!-- Page "), b["page"].cast("string"), F.lit(" -->\n\n"))
            tight = (listed(b) & (listed(p) | (p["type"] == "body"))) | ((b["type"] == "caption") & (p["type"] == "body"))
            lead = (F.when(p.isNull(), page).when(p["page"] != b["page"], F.concat(F.lit("\n\n"), page)).when(tight, "\n").otherwise("\n\n"))
            return F.concat(lead, let(trim_bound(b["text"]), lambda t: render(b, t)))
        return F.transform(bs, piece)

    known = lambda b: (heading(b) | listed(b) | either(b["type"], "table", "code", "body", "caption")) & (trim_bound(b["text"]) != "")
    text = joined(let(F.filter("blocks", known), weave), "")
    return docs.select("doc_id", F.concat(trim(F.regexp_replace(text, r"\n{3,}", "\n\n")), F.lit("\n")).alias("markdown"))


# Titles of slides with little to say, and words of trace captions.
SKIP_TITLES = ["outline", "table of contents", "learning outcomes", "objectives", "introduction", "summary", "conclusion", "thank you",
               "any questions", "recap", "revisions", "references", "bibliography"]
TRACE_WORDS = ["declare", "create", "assign", "change", "reference", "value", "circle", "mycircle", "yourcircle"]


def slide_filter(slides: DataFrame) -> DataFrame:
    """Slides (``slides``: array of page, title, blocks) without empty ones, repeated titles and trace captions.

    Whether a slide is skipped depends on itself alone, so skipping comes first and the slide before
    it in what is left is the one to compare titles with.
    """
    cut = lambda x: F.regexp_replace(strip(F.regexp_replace(F.lower(strip(x)), r"\s*[\(\[,;:-]?\s*cont\.?(?:inued)?[\)\]]?\s*$", "")), r"\s+", " ")
    solid = lambda s: F.exists(s["blocks"], lambda b: (b["type"] != "h1") & ~is_noise(b["text"]))
    poor = lambda s: any_of(F.lower(s["title"]), SKIP_TITLES) & (F.size(s["blocks"]) <= 5)
    hollow = lambda s: (F.size(s["blocks"]) > 0) & ~solid(s)
    def bare(b: Column) -> Column:
        return F.transform(words(F.lower(strip(b["text"]))), lambda w: F.regexp_replace(w, r"^[.,:;()]+|[.,:;()]+$", ""))
    def caption(s: Column, b: Column) -> Column:
        return (F.lower(s["title"]).contains("trace") & (b["type"] == "body") & ~looks_like_code(strip(b["text"]))
                & (F.size(words(strip(b["text"]))) <= 6) & F.arrays_overlap(bare(b), F.array(*map(F.lit, TRACE_WORDS))))
    def run(kept: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            again = F.coalesce((cut(s["title"]) != "") & (cut(F.get(kept, i - 1)["title"]) == cut(s["title"])), F.lit(False))
            return F.filter(s["blocks"], lambda b: ~(again & (b["type"] == "h1")) & ~caption(s, b))
        return F.flatten(F.transform(kept, one))
    kept = F.filter("slides", lambda s: ~((s["page"] > 1) & (poor(s) | hollow(s))))
    return slides.select("doc_id", let(kept, run).alias("blocks"))
