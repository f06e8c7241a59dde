"""Benchmark decontamination by a broadcast hash set of normalised n-grams; native expressions only.

Each n-gram (window) of a benchmark item is filed under its longest word. Texts are scanned word by word: a word that is some window's
longest one is a place to look at, and the words around it, compared with the windows of that word, confirm the hit.

Scale: one pass over the documents. The set of longest words travels in the plan and the windows by broadcast while the benchmark stays under
``SMALL`` windows, counted first; beyond it every word is a place to look at and the join is left to Spark. Only places, not words,
leave a row. The rows of one document meet again in one aggregation by row, so a passage that all documents share stays spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import ascii_lower, keep_listed
from scholia.session import cut_lineage

N = 10
SMALL = 200_000
# Everything that is no digit, letter or non-ASCII character; upper case counts as a letter here and is lowered later.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text in their own case; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda w: w != "")


def windows(items: DataFrame, n: int) -> DataFrame:
    """length, words (joined by spaces), anchor, offset, items (sorted, distinct ids as strings) of the distinct windows of item_id, text."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of(ascii_lower(F.col("text"))).alias("w")).filter("size(w) > 0")
    w = w.withColumn("length", F.least(F.size("w"), F.lit(n)))
    each = w.select("item", "length", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1),
                                                            lambda i: F.slice("w", i, F.col("length")))).alias("g"))
    longest = F.array_max(F.transform("g", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    each = each.select("item", "length", F.array_join("g", " ").alias("words"), longest.alias("anchor"),
                       (F.array_position("g", longest) - 1).cast("int").alias("offset"))
    return each.groupBy("words", "length", "anchor", "offset").agg(F.array_sort(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """rid, doc_id, n_words, n_hit, spans (start and end, exclusive, in words, merged, in order), items (sorted as strings), one row for each
    row of ``docs`` (doc_id, text; others ignored).

    Null, empty and wordless texts have no words and no hits; null items or items without words have no windows; null item ids are not reported, though
    their windows count.
    """
    found = windows(items, n)
    few = found.limit(SMALL + 1).count() <= SMALL
    test = lambda word: F.lit(True)
    if few:
        anchors = [r[0] for r in found.select(F.lower("anchor")).distinct().collect()]
        # Full lower case lets more words through than A-Z alone, never fewer; the join below is exact.
        test = (lambda word: F.lower(word).isin(anchors)) if anchors else (lambda word: F.lit(False))
        found = F.broadcast(found)
    w = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), words_of(F.col("text")).alias("w"))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: test(F.get("w", i)))
    around = F.transform(F.when(F.size("w") > 0, places), lambda i: F.struct(
        i.alias("at"), ascii_lower(F.get("w", i)).alias("anchor"), F.least(i, F.lit(n - 1)).alias("before"),
        F.transform(F.slice("w", F.greatest(i - n + 2, F.lit(1)), F.least(i, F.lit(n - 1)) + n), ascii_lower).alias("near")))
    looked = w.select("doc_id", "rid", F.size("w").cast("long").alias("n_words"), F.explode_outer(around).alias("p"))
    looked = looked.select("doc_id", "rid", "n_words", F.col("p.at").alias("at"), F.col("p.anchor").alias("_a"),
                           F.col("p.before").alias("before"), F.col("p.near").alias("near"))
    starts = F.col("before") - F.col("offset")
    same = (starts >= 0) & (F.array_join(F.slice("near", F.greatest(starts, F.lit(0)) + 1, F.col("length")), " ") == F.col("words"))
    hit = looked.join(found, (F.col("_a") == F.col("anchor")) & same, "left")
    start = (F.col("at") - F.col("offset")).cast("long")
    span = F.when(F.col("words").isNotNull(), F.struct(start.alias("start"), (start + F.col("length")).alias("end")))
    rows = hit.groupBy("rid", "doc_id").agg(F.max("n_words").alias("n_words"), F.collect_set(span).alias("spans"),
                                            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = F.aggregate(
        F.array_sort("spans"), F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when(F.size(done) == 0, F.array(s)).when(
            F.element_at(done, -1)["end"] >= s["start"],
            F.concat(F.slice(done, 1, F.size(done) - 1),
                     F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(s))))
    rows = rows.withColumn("spans", merged)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select("rid", "doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def contamination(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """The digest of ``hits``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return hits(docs, items, n).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def by_text(docs: DataFrame) -> DataFrame:
    """The texts with their digests for ids."""
    return docs.select(digest(F.col("text")).alias("doc_id"), "text")


def clean_documents(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """The rows of ``docs`` without a hit. The text alone decides: other rows of the same doc_id, or of none, stay."""
    bad = cut_lineage(hits(by_text(docs), items, n).filter("n_hit > 0").select("doc_id").distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"), digest(F.col("text")).alias("digest"))
    return keep_listed(rows, bad, "digest", "left_anti").select("row.*")


def cut_spans(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with the hit words, and the breaks after them, taken out of the texts; other texts stay to the letter.

    Equal texts are cut alike; ids play no part.
    """
    found = hits(by_text(docs), items, n).filter("n_hit > 0").groupBy(F.col("doc_id").alias("id")).agg(F.first("spans").alias("spans"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), digest(F.col("text")).alias("own"), F.size(words_of(F.col("text"))).cast("long").alias("size"))
    joined = rows.join(found, F.col("own") == F.col("id"), "left")
    text = F.col("row.text")
    # The text is gap, word, gap, word, ... gap; words count from 0.
    w, gaps = words_of(text), F.split(text, WORD, -1)
    kept = F.filter(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), lambda i: ~F.exists("spans", lambda s: (i >= s["start"]) & (i < s["end"])))
    cut = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(kept, lambda i: F.concat(F.get(w, i.cast("int")), F.get(gaps, i.cast("int") + 1))), ""))
    new = F.when(F.col("spans").isNotNull(), cut).otherwise(text)
    return joined.select(*[(new if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
