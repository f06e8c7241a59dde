"""Latest, top-k, paging, pairing and set operations."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.exprs import seconds_between
from scholia.functions.ordered import add_rank, top_per_key
from scholia.params import at

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def recent_attempts(answers: DataFrame, k: int = 5) -> DataFrame:
    """Answered or graded questions, newest answer first, a missing answer time counting as 0."""
    done = answers.filter(F.col("answer").isNotNull() | F.col("graded"))
    timed = done.withColumn("answer_time", F.coalesce("answer_time", F.lit(0)))
    return top_per_key(timed, ["user_id"], [F.col("answer_time").desc(), F.col("question_id")], k)


def recent_feed(resources: DataFrame, exercises: DataFrame, notes: DataFrame, subjects: DataFrame,
                per_kind: int = 10, total: int = 20) -> DataFrame:
    """Per user: the newest of each kind, merged, newest first.

    Each branch is trimmed per key before it is shuffled, so the union holds a few rows per user.
    """
    cols = ["user_id", "type", "id", "title", "updated_at", "subject_id"]
    newest = [F.col("updated_at").desc(), F.col("id")]
    def branch(t: DataFrame, kind: str) -> DataFrame:
        return top_per_key(t.withColumn("type", F.lit(kind)).select(*cols), ["user_id"], newest, per_kind).drop("rank")
    merged = branch(resources, "resource").unionByName(branch(exercises, "exercise")).unionByName(branch(notes, "note"))
    names = subjects.select("subject_id", F.col("name").alias("subject_name"))
    order = [F.col("updated_at").desc(), F.col("type"), F.col("id")]
    return top_per_key(merged, ["user_id"], order, total).join(names, "subject_id", "left").drop("subject_id")


def sorted_positions(t: DataFrame, mode: str, id_col: str) -> DataFrame:
    """Position of each row under a name or date order; a missing date counts as the epoch."""
    date = F.coalesce("created_at", F.expr(EPOCH))
    orders = {"name_asc": [F.col("name").asc()], "name_desc": [F.col("name").desc()],
              "date_asc": [date.asc()], "date_desc": [date.desc()]}
    return add_rank(t, [], orders[mode] + [F.col(id_col)])


def pinned_first(t: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    return add_rank(t, keys, [F.col("is_pinned").desc(), F.col("version").desc(), F.col(id_col)])


def active_or_recent(tasks: DataFrame, as_of: datetime.datetime, minutes: int = 5) -> DataFrame:
    fresh = F.col("status").isin("completed", "failed") & (seconds_between(at(as_of), F.col("updated_at")) <= minutes * 60)
    return (tasks.filter((F.col("status").isin("pending", "running") | fresh) & (F.col("task_type") != "chat"))
            .orderBy("updated_at", "task_id"))


def thread_pages(turns: DataFrame, page: int = 256) -> DataFrame:
    """Messages of each thread in order, in pages of consecutive turns.

    A thread of any length is cut by turn number, so no array or task holds a whole thread.
    """
    return (turns.withColumn("page", F.floor(F.col("turn") / page))
            .groupBy("conversation_id", "page")
            .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")))


def context_tail(messages: DataFrame, n: int = 3, cut: int = 300, descending: bool = False) -> DataFrame:
    """Last n exchanges of each thread as one text; long answers are cut."""
    tail = top_per_key(messages, ["conversation_id"], [F.col("turn").desc()], n)
    ordered = F.sort_array(F.collect_list(F.struct(F.col("rank") if descending else F.col("turn"), "message", "response")))
    lines = F.transform("m", lambda x, i: F.concat(
        F.lit("\n[Message "), (i + 1).cast("string"), F.lit("]\nQ: "), x["message"],
        F.lit("\nA: "), F.substring(F.coalesce(x["response"], F.lit("")), 1, cut), F.lit("...")))
    return (tail.groupBy("conversation_id").agg(ordered.alias("m"))
            .select("conversation_id", F.concat(F.lit("Previous conversation context:\n"),
                                                F.array_join(lines, "\n")).alias("context")))


def pair_turns(turns: DataFrame) -> DataFrame:
    """Question and the answer in the next turn, by an equi-join on (thread, turn)."""
    answers = (turns.filter(F.col("role") == "assistant")
               .select("conversation_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")))
    return (turns.filter(F.col("role") == "user").join(answers, ["conversation_id", "turn"])
            .select("conversation_id", "turn", F.col("text").alias("question"), "answer"))


#: Hash buckets of keys, of which a list may be broadcast.
BUCKETS = 1 << 18


def items_of(sets: DataFrame, key: str, items: str, item: str) -> DataFrame:
    """The distinct (key, item) pairs of rows with a key and an array."""
    return sets.select(key, F.explode(items).alias(item)).distinct()


def overlap(a: DataFrame, b: DataFrame, key: str, items: str) -> DataFrame:
    """Per key of b: how many of its distinct items a has too, how many it has, and the share. Rows are a key and an array of items."""
    asked = a.join(b.select(key).distinct(), key, "left_semi")  # other sets are not unrolled
    found = items_of(asked, key, items, "_item").withColumn("_f", F.lit(1))
    return (items_of(b, key, items, "_item").join(found, [key, "_item"], "left").groupBy(key)
            .agg(F.count("_f").alias("found"), F.count("*").alias("expected"))
            .withColumn("recall", F.bround(F.col("found") / F.col("expected"), 6)))


def difference(a: DataFrame, b: DataFrame, key: str, items: str, item: str) -> DataFrame:
    """Distinct (key, item) rows on one side only: in b, missing from a; in a, extra. Rows are a key and an array of distinct items.

    A key with one row a side at most is settled within that row, so neither sets nor items are shuffled. Keys that share a hash bucket with a
    repeated key are unrolled and compared by item, and null ones, which are equal to none of the other side. The buckets are so few that
    those of repeated keys are broadcast.
    """
    side = lambda t, x, y: t.select(key, F.lit(x).alias("_a"), F.lit(y).alias("_b"))
    times = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy(key).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    crowded = F.broadcast(times.filter((F.col("_a") > 1) | (F.col("_b") > 1)).select(bucket.alias("_bucket")).distinct())
    in_crowd, known = bucket == F.col("_bucket"), F.col(key).isNotNull()
    single = lambda t: t.filter(known).join(crowded, in_crowd, "left_anti")
    pairs = lambda t: items_of(t.filter(known).join(crowded, in_crowd, "left_semi").unionByName(t.filter(~known)), key, items, item)

    def beyond(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        others = single(y).join(x.select(key), key, "left_semi").select(key, F.col(items).alias("_o"))
        within = single(x).join(others, key, "left").withColumn("_o", F.coalesce("_o", F.array().cast(dict(y.dtypes)[items])))
        apart = pairs(x).join(pairs(y), [key, item], "left_anti")
        return within.select(key, F.explode(F.array_except(items, "_o")).alias(item)).unionByName(apart).withColumn("side", F.lit(name))
    return beyond(b, a, "missing").unionByName(beyond(a, b, "extra"))


def distinct_first(t: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """First position of each distinct value within its group."""
    return t.groupBy(*keys).agg(F.min(pos).alias(pos))


ANCHOR = 4


def containing(short: DataFrame, s: str, long: DataFrame, l: str) -> DataFrame:
    """Pairs of rows where the text ``l`` contains the text ``s``; all columns of both, whose names differ. Null texts pair with none.

    Each short text is filed under one anchor: of its pieces of four characters the one that the fewest long texts hold, or itself where it
    is shorter. Long texts are looked up under their pieces of the lengths that anchors have, so a text of n characters sends 4 n rows at
    most, and usually n.
    """
    size = lambda c: F.least(F.length(c), F.lit(ANCHOR))

    def pieces(t: DataFrame, c: str) -> DataFrame:
        starts = F.explode(F.sequence(F.lit(1), F.length(c) - F.col("_n") + 1))
        return (t.filter(F.col("_n") <= F.length(c)).withColumn("_at", starts)
                .withColumn("piece", F.expr(f"substring({c}, _at, _n)")).drop("_at", "_n").distinct())

    sizes = short.agg(F.collect_set(size(s))).scalar()  # five values at most
    held = pieces(long.withColumn("_all", sizes).withColumn("_n", F.explode("_all")).drop("_all"), l)
    spread = held.groupBy("piece").agg(F.count("*").alias("_holders"))
    anchored = (pieces(short.withColumn("_n", size(s)), s).join(spread, "piece")
                .groupBy(*short.columns).agg(F.min_by("piece", F.struct("_holders", "piece")).alias("piece")))
    return anchored.join(held, "piece").filter(F.col(l).contains(F.col(s))).drop("piece")


def title_matches(cited: DataFrame, resources: DataFrame) -> DataFrame:
    """Resource for each cited title: the exact title, else the first that contains it or is in it.

    Containment is a join on anchors, checked afterwards. Equal titles share one id: the last one given, in the place of the first.
    """
    titles = resources.groupBy("title").agg(F.min("resource_id").alias("ord"), F.max("resource_id").alias("resource_id"))
    wanted = cited.select(F.trim("cited").alias("cited")).filter("cited <> ''").distinct()
    exact = wanted.join(titles, F.col("cited") == F.col("title")).select("cited", "resource_id", F.lit(-1).cast("long").alias("ord"))
    rest = wanted.join(titles, F.col("cited") == F.col("title"), "left_anti").select("cited", F.lower("cited").alias("lc"))
    low = titles.select(F.lower("title").alias("lt"), "ord", "resource_id")
    found = [containing(low, "lt", rest, "lc"), containing(rest, "lc", low, "lt")]
    return (exact.unionByName(found[0].select("cited", "resource_id", "ord")).unionByName(found[1].select("cited", "resource_id", "ord"))
            .groupBy("cited").agg(F.min_by("resource_id", "ord").alias("resource_id")))
