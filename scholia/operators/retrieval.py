"""Embedding a corpus, semantic and keyword search, packing and citing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.ordered import top_per_key
from scholia.functions.text import joined, let, strip, tokens
from scholia.functions.vectors import Encoder, cosine_percent, embed, hashing_encoder, topk_blocks
from scholia.operators.chunking import chunk_chars, chunk_words
from scholia.operators.cleaning import strip_images


def embed_corpus(docs: DataFrame, encoder: Encoder = hashing_encoder, size: int = 500) -> DataFrame:
    """Strip image links, chunk, embed. No shuffle: chunks are encoded where their document was read."""
    clean = docs.filter(strip("text") != "").select("doc_id", strip_images("text").alias("text"))
    return embed(chunk_chars(clean, size), "text", encoder).withColumnRenamed("doc_id", "resource_id")


def search_texts(docs: DataFrame, queries: DataFrame, encoder: Encoder = hashing_encoder, k: int = 5) -> DataFrame:
    """Rank word chunks for every query; a hit carries the first resource that holds the same chunk text.

    Equal chunk texts meet by their digest, so texts are not shuffled for the labelling.
    """
    chunks = docs.select("doc_id", F.posexplode(chunk_words("text")).alias("chunk_index", "content"))
    keyed = embed(chunks, "content", encoder).withColumn("digest", F.md5("content"))
    first = chunks.groupBy(F.md5("content").alias("digest")).agg(F.min("doc_id").alias("resource_id"))
    hits = topk_blocks(embed(queries, "query", encoder), keyed.withColumnRenamed("doc_id", "src"), k,
                       ["src", "chunk_index", "digest"], percent=False)
    return hits.join(first, "digest").select("query_id", "resource_id", "digest", "score", "rank")


def similar_documents(docs: DataFrame, encoder: Encoder = hashing_encoder, k: int = 5) -> DataFrame:
    """For each document the k most similar others of the same owner.

    The query is the first word chunk, a candidate its first 1000 characters. One more than k is
    asked for, because the document itself can take one place and is then dropped.
    """
    head = F.try_element_at(chunk_words("text"), F.lit(1))
    docs = docs.filter(strip("text") != "")
    q = embed(docs.select("owner", F.col("doc_id").alias("query_id"), head.alias("_t")), "_t", encoder)
    c = embed(docs.select("owner", "doc_id", F.substring("text", 1, 1000).alias("_t")), "_t", encoder)
    near = topk_blocks(q, c, k + 1, ["doc_id"], group="owner", percent=False).filter("doc_id <> query_id").drop("rank")
    ranked = top_per_key(near, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)
    return ranked.select(F.col("query_id").alias("doc_id"), F.col("doc_id").alias("similar_id"), "score", "rank")


def snippets(docs: DataFrame, query: str, encoder: Encoder = hashing_encoder, k: int = 3, size: int = 500) -> DataFrame:
    """Best k character chunks inside each document for one query text."""
    target = F.array(*[F.lit(float(x)) for x in encoder([query])[0]])
    chunks = embed(chunk_chars(docs, size), "text", encoder)
    scored = chunks.withColumn("score", cosine_percent(F.col("embedding"), target)).drop("embedding")
    return top_per_key(scored, ["doc_id"], [F.col("score").desc(), F.col("chunk_index")], k)


def pack_snippets(hits: DataFrame, max_chars: int = 2000) -> DataFrame:
    """Ranked snippets (query_id, rank from 1 without holes, text) joined by a blank line while they fit; an empty context where none fits.

    Empty snippets before the first text add nothing, later ones a blank line. After the first text every snippet takes two
    characters at least, so cutting ranks from there on is exact and bounds each window.
    """
    hits = hits.withColumn("text", F.coalesce("text", F.lit("")))
    first = hits.groupBy("query_id").agg(F.min(F.when(F.col("text") != "", F.col("rank"))).alias("_f"))
    near = hits.join(first, "query_id").filter((F.col("rank") >= F.col("_f")) & (F.col("rank") <= F.col("_f") + max_chars // 2 + 1))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    gaps = F.greatest(F.col("rank") - F.col("_f"), F.lit(1)) * 2
    fits = near.withColumn("_n", F.sum(F.length("text")).over(w) + gaps).filter(F.col("_n") <= max_chars)
    packed = fits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("_s"))
    return first.join(packed, "query_id", "left").select(
        "query_id", F.coalesce(joined(F.transform("_s", lambda s: s["text"]), "\n\n"), F.lit("")).alias("context"))


def pack_context(hits: DataFrame, max_chars: int = 3000) -> DataFrame:
    """``[Source n]: text`` blocks until one does not fit, and a 150-character preview per source."""
    near = hits.filter(F.col("rank") <= max_chars // 14 + 1)
    label = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]: "))
    size = F.length(label) + F.length("text") + 2
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    fits = (near.withColumn("_b", F.coalesce(F.sum(size).over(before), F.lit(0)))
            .filter(F.col("_b") + F.length("text") <= max_chars))
    part = F.struct("rank", F.concat(label, F.col("text"), F.lit("\n\n")).alias("block"), F.substring("text", 1, 150).alias("preview"))
    return fits.groupBy("query_id").agg(F.sort_array(F.collect_list(part)).alias("_s")).select(
        "query_id", joined(F.transform("_s", lambda s: s["block"]), "").alias("context"),
        F.transform("_s", lambda s: s["preview"]).alias("sources"))


# Words left out of keyword queries and of citation terms.
QUERY_STOP = ["what", "this", "that", "with", "from", "into", "have", "been", "does", "is", "a", "an", "the"]
CITE_STOP = ["the", "and", "for", "are", "was", "were", "been", "have", "that", "this", "with", "from", "into", "can", "your", "will", "also"]


def _lits(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def keyword_relevance(queries: DataFrame, items: DataFrame, min_score: float = 50.0, k: int = 5) -> DataFrame:
    """Lexical score from title hits, density in the body and adjacent pairs; best k of at least ``min_score``.

    Title hits weigh 60 points, density 52.5 (35 at most), adjacent pairs 25 at most. So a pair without a title hit needs a body of which a certain share are words
    of the query: then one of the body's rarest words, those before the share begins, is among them, and only these are joined with the queries. Pairs
    with title hits are dropped where even all asked words of the body would not do. Words that every text has lead to no pairs.
    """
    usable = F.filter(tokens(F.lower("query")), lambda w: (F.length(w) > 2) & ~F.array_contains(_lits(QUERY_STOP), w))
    q = queries.select("query_id", usable.alias("qw")).filter(F.size("qw") > 0)
    asked = q.select("query_id", F.size("qw").alias("nq"), F.explode("qw").alias("w")).groupBy("query_id", "w", "nq").agg(F.count("*").alias("times"))
    vocabulary = asked.groupBy("w").agg(F.count("*").alias("asks"))

    body = items.select("item_id", tokens(F.lower("body")).alias("bw")).select("item_id", F.size("bw").alias("nb"), F.explode("bw").alias("w"))
    in_body = body.join(vocabulary.select("w"), "w").groupBy("item_id", "w", "nb").agg(F.count("*").alias("n"))
    # Words of a body by how often they stand in it: a query's are found by one set operation each, not word by word.
    alike = lambda bag: F.transform(F.array_distinct(F.transform(bag, lambda x: x["n"])), lambda n: F.struct(
        n.alias("n"), F.transform(F.filter(bag, lambda x: x["n"] == n), lambda x: x["w"]).alias("ws")))
    bags = (in_body.groupBy("item_id", "nb").agg(F.collect_list(F.struct("w", "n")).alias("bag"), (F.sum("n") / F.col("nb")).alias("most"))
            .withColumn("bag", let(F.col("bag"), alike)))
    # Few bodies have that share at all, and only their words are ordered.
    share = (min_score - 25) / 52.5
    dense = (bags.filter(F.col("most") * F.col("nb") >= share * F.col("nb") - 1e-5).select("item_id", "nb", F.inline("bag"))
             .select("item_id", "nb", "n", F.explode("ws").alias("w")).join(vocabulary, "w"))
    rest = F.sum("n").over(Window.partitionBy("item_id", "nb").orderBy(F.col("asks").desc(), F.col("w").desc()).rowsBetween(Window.unboundedPreceding, 0))
    rare = dense.withColumn("rest", rest).filter(F.col("rest") >= share * F.col("nb") - 1e-6)
    by_body = rare.join(asked, "w").select("query_id", "item_id", F.lit(0.0).alias("t"))

    title_words = items.select("item_id", F.explode(F.array_distinct(tokens(F.lower("title")))).alias("word"))
    pieces = (title_words.select("word").distinct().withColumn("_s", F.explode(F.sequence(F.lit(1), F.length("word"))))
              .select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - F.col("_s") + 1),
                                                    lambda n: F.col("word").substr(F.col("_s"), n))).alias("w")).distinct().join(vocabulary.select("w"), "w", "left_semi"))
    in_title = title_words.join(pieces, "word").select("item_id", "w").distinct()
    by_title = in_title.join(asked, "w").select("query_id", "item_id", (F.col("times") / F.col("nq")).alias("t"))

    points = lambda d: F.col("t") * 100 * 0.60 + F.least(d * 150, F.lit(100.0)) * 0.35
    pairs = by_title.unionByName(by_body).groupBy("query_id", "item_id").agg(F.sum("t").alias("t")).join(bags, "item_id", "left")
    pairs = pairs.filter(points(F.coalesce("most", F.lit(0.0))) + 25 >= min_score - 1e-9).join(q, "query_id")
    hits = F.aggregate("bag", F.lit(0).cast("long"), lambda s, x: s + x["n"] * F.size(F.array_intersect(x["ws"], F.col("qw"))))
    pairs = pairs.select("query_id", "item_id", "qw", points(F.coalesce(hits / F.col("nb"), F.lit(0.0))).alias("points"))
    full = pairs.filter(F.col("points") + 25 >= min_score - 1e-9).join(items.select("item_id", "title", "body"), "item_id")

    def bonus(v: Column) -> Column:
        qw = v["q"]
        phrases = F.zip_with(F.slice(qw, F.lit(1), F.size(qw) - 1), F.slice(qw, 2, F.greatest(F.size(qw), F.lit(1))),
                             lambda a, b: F.concat(a, F.lit(" "), b))
        found = F.filter(phrases, lambda p: v["b"].contains(p) | v["t"].contains(p))
        return F.least(F.size(found) * 15, F.lit(100)) * 0.25
    once = F.struct(F.lower("title").alias("t"), F.lower("body").alias("b"), F.col("qw").alias("q"))
    score = F.least(F.round(F.col("points") + let(once, bonus), 9), F.lit(100.0))
    kept = full.select("query_id", "item_id", score.alias("raw")).filter(F.col("raw") >= min_score)
    rounded = kept.select("query_id", "item_id", F.bround("raw", 1).alias("score"))
    return top_per_key(rounded, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)


def cite_sentences(responses: DataFrame) -> DataFrame:
    """Put ``[n]`` at the end of the best free sentence for each source, sources in order.

    ``responses``: response_id, response, sources (array of previews; the first ten are used). Everything
    lies in the response's row; the fold over its sources carries the sentences taken so far.
    """
    mark = r"(?U)(?<=[.!?])\s+"
    base = responses.select("response_id", strip("response").alias("_r"), F.slice("sources", 1, 10).alias("_src"))
    base = base.select("response_id", "_src", F.split("_r", mark).alias("_s"), F.regexp_extract_all("_r", F.lit(mark), F.lit(0)).alias("_sep"))
    base = base.withColumn("_low", F.transform("_s", lambda s: F.lower(s)))
    terms = lambda p: F.filter(tokens(F.lower(p)), lambda w: (F.length(w) >= 3) & ~F.array_contains(_lits(CITE_STOP), w))
    base = base.withColumn("_terms", F.transform("_src", lambda p: F.when(F.length(p) >= 3, terms(p)).otherwise(F.array().cast("array<string>"))))

    def assign(taken: Column, n: Column) -> Column:
        words = F.get(F.col("_terms"), n)
        rated = F.transform("_low", lambda s, i: F.struct(
            F.size(F.filter(words, lambda w: s.contains(w))).alias("hit"), (-i).alias("at")))
        free = F.filter(rated, lambda r: (r["hit"] > 0) & (r["hit"] * 100 / F.size(words) >= 40)
                        & ~F.exists(taken, lambda t: t["at"] == -r["at"]))
        best = F.array_max(free)
        return F.when(best.isNotNull(), F.concat(taken, F.array(F.struct((-best["at"]).alias("at"), (n + 1).alias("n"))))).otherwise(taken)

    none = F.array().cast("array<struct<at:int,n:int>>")
    places = F.when(F.size("_src") > 0, F.sequence(F.lit(0), F.size("_src") - 1)).otherwise(F.array().cast("array<int>"))
    base = base.withColumn("_taken", F.aggregate(places, none, assign))

    def tagged(sentences: Column, taken: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            n = F.get(F.filter(taken, lambda t: t["at"] == i), F.lit(0))["n"]
            tag = F.concat(F.lit(" ["), n.cast("string"), F.lit("]"))
            ended = F.concat(F.regexp_replace(s, r"[.!?]\z", ""), tag, F.regexp_extract(s, r"([.!?])\z", 1))
            return F.when(n.isNotNull() & ~s.rlike(r"(?m)^\s*\|.*\|\s*$"), ended).otherwise(s)
        return F.transform(sentences, one)

    out = F.zip_with(let(F.col("_taken"), lambda taken: tagged(F.col("_s"), taken)), "_sep", lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return base.select("response_id", joined(out, "").alias("cited_text"))
