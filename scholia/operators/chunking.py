"""Chunk a document inside its own row; chunks come out by exploding, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import fold_out, joined, let, lines, strip, words


def chunk_words(text: Column | str, size: int = 500, overlap: int = 50) -> Column:
    """Word windows at a stride of size - overlap; a last window inside the one before it is kept."""
    def windows(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: joined(F.slice(w, i + 1, F.lit(size)), " "))
    return let(words(text), windows)


def cut_points(items: Column, weight: Callable[[Column], Column], cut: Callable[[Column, Column], Column], before: bool) -> Column:
    """Start index of every chunk under a size that resets at each cut.

    The fold carries only the running size and the cuts made so far, so it grows with the number
    of chunks and not with the text.
    """
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("size"), F.array(F.lit(0)).alias("cuts"))
    def step(a: Column, x: Column) -> Column:
        size = a["size"] + weight(x)
        hit = cut(x, size) & ((a["i"] > F.element_at(a["cuts"], -1)) if before else F.lit(True))
        place = a["i"] if before else a["i"] + 1
        return F.struct((a["i"] + 1).alias("i"),
                        F.when(hit, weight(x) if before else F.lit(0)).otherwise(size).cast("int").alias("size"),
                        F.when(hit, F.concat(a["cuts"], F.array(place))).otherwise(a["cuts"]).alias("cuts"))
    cuts = F.aggregate(items, zero, step, lambda a: a["cuts"])
    return F.filter(cuts, lambda c: c < F.size(items))


def pieces(items: Column, starts: Column, sep: str) -> Column:
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(items)))
    return F.zip_with(starts, ends, lambda a, b: joined(F.slice(items, a + 1, b - a), sep))


def chunk_chars(docs: DataFrame, size: int = 500) -> DataFrame:
    """Greedy word chunks of at least ``size`` characters, with offsets in the white-space-normalised text."""
    def cut(w: Column) -> Column:
        starts = cut_points(w, lambda x: F.length(x) + 1, lambda x, n: n >= size, before=False)
        return let(starts, lambda c: pieces(w, c, " "))
    def placed(texts: Column) -> Column:
        offsets = fold_out(texts, {"at": F.lit(0)}, lambda a, x: ({"at": a["at"] + F.length(x) + 1}, F.array(a["at"])), "int")
        return F.arrays_zip(texts.alias("text"), offsets.alias("position"))
    found = let(words("text"), lambda w: F.when(F.size(w) > 0, let(cut(w), placed)))
    rows = docs.select("doc_id", F.posexplode(found).alias("chunk_index", "_x"))
    return rows.select("doc_id", "chunk_index", "_x.text", "_x.position")


def chunk_headings(docs: DataFrame, size: int = 800) -> DataFrame:
    """Cut before a ``#`` to ``###`` line once the chunk, that line included, has reached ``size``."""
    def cut(ls: Column) -> Column:
        starts = cut_points(ls, lambda x: F.length(x) + 1, lambda x, n: (n >= size) & x.rlike(r"^#{1,3}\s"), before=True)
        return let(starts, lambda c: pieces(ls, c, "\n"))
    return docs.select("doc_id", F.posexplode(let(lines("text"), cut)).alias("chunk_index", "text"))


def chunk_breaks(docs: DataFrame, size: int = 4000) -> DataFrame:
    """Cut after a heading or a blank line once the chunk has reached ``size``; empty chunks are dropped."""
    def cut(ls: Column) -> Column:
        starts = cut_points(ls, lambda x: F.length(x) + 1,
                            lambda x, n: (n >= size) & (x.rlike(r"^#{1,4}\s") | (strip(x) == "")), before=False)
        return let(starts, lambda c: F.filter(F.transform(pieces(ls, c, "\n"), lambda x: strip(x)), lambda x: x != ""))
    return docs.select("doc_id", F.posexplode(let(lines("text"), cut)).alias("chunk_index", "text"))


def sections(docs: DataFrame, level: int = 2) -> DataFrame:
    """(header, content) split at headers of up to ``level``; a section without either is dropped."""
    is_header = lambda x: x.rlike(rf"^#{{1,{level}}}\s+")
    def cut(ls: Column) -> Column:
        heads = F.array_compact(F.transform(ls, lambda x, i: F.when(is_header(x), i)))
        def section(a: Column, b: Column) -> Column:
            first = F.get(ls, a)
            head = F.when(is_header(first), first).otherwise(F.lit(""))
            skip = F.when(is_header(first), 1).otherwise(0)
            return F.struct(head.alias("header"), strip(joined(F.slice(ls, a + 1 + skip, b - a - skip))).alias("content"))
        def spans(s: Column) -> Column:
            return F.zip_with(s, F.concat(F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), F.array(F.size(ls))), section)
        found = let(F.array_distinct(F.concat(F.array(F.lit(0)), heads)), spans)
        return F.filter(found, lambda x: (strip(x["header"]) != "") | (x["content"] != ""))
    return (docs.select("doc_id", F.posexplode(let(lines("text"), cut)).alias("section", "_x"))
            .select("doc_id", "section", "_x.header", "_x.content"))
