"""Spelling variants by permuterm rotations.

Every word is closed by a terminator and turned round: the word cut into head and tail gives ``tail $ head``. Sorted, all rotations that start with the same
``tail $ head`` lie together: the rotation that is just that is the word without any letter at the cut, and each longer one by a letter is a word with that
letter there. So a group holds the words that differ in this one place by a replacement, and by an insertion or deletion the word that skips it.
A group has at most one word per letter of the alphabet and the one that skips it, whatever the corpus. Groups are scanned, and each member gets how many
neighbours it has there and the commonest of them; no pair is made.

A pair that differs by a replacement meets in one group. One that differs by a letter of a run (``aa``) meets once per letter of it and is counted at the first.

Scale: words are counted before they are shuffled; what follows has 2 * length + 1 small rows per distinct word, dealt out by rotation, so no
common word, prefix or document makes a hot key. Roots are found by pointer doubling: forms grow tenfold a step, so chains are short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import ascii_lower, stored

# What a word is, which words are garbled, which are kept.
LETTERS, GARBLED, MIN_LENGTH, MIN_COUNT, FACTOR = r"[A-Za-zÀ-ÿ]", 31, 7, 2, 10
END = "$"


def counted(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, n: the distinct words of at least ``min_length`` letters of all texts, with their occurrences.

    A run of letters whose crc32 together with the doc_id (null: the empty text) is a multiple of 31 has lost one letter.
    """
    runs = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(LETTERS + f"{{{min_length},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.char_length("run")).cast("int")
    garbled = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = each.select(F.when(h % GARBLED == 0, garbled).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """start (``tail $ head``), letter and n: every rotation cut before its last letter, and whole with no letter."""
    size = F.char_length("word")
    turn = lambda i, skip: F.concat(F.substr("word", i + 1 + skip), F.lit(END), F.substr("word", F.lit(1), i))
    skipped = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(turn(i, 1).alias("start"), F.substr("word", i + 1, F.lit(1)).alias("letter")))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(turn(i, 0).alias("start"), F.lit("").alias("letter")))
    return words.filter(size > 0).select("n", F.inline(F.concat(skipped, whole)))


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best (the near word of largest n, the first in code-point order of several) and best_n of every word with a near one.

    ``words``: word and n, distinct words of one letter or more without the terminator.
    """
    # Rotations go to the task of their start, are sorted there, and lie in groups.
    turned = rotations(words).repartition("start")
    group = Window.partitionBy("start")
    shared = turned.withColumn("members", F.count("*").over(group)).filter("members > 1")
    head, tail = F.substring_index("start", END, -1), F.substring_index("start", END, 1)
    shared = shared.withColumns({"word": F.concat(head, F.col("letter"), tail), "skips": F.col("letter") == "",
                                 # The same letter goes before: this pair is counted there.
                                 "again": (F.col("letter") != "") & (F.col("letter") == F.substr(head, F.lit(-1)))})
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "word")).over(group)), 1, 2)
    shared = shared.withColumns({"first": ranked, "gap": F.max("skips").over(group), "doubled": F.max("again").over(group)})
    near = F.when(F.col("skips"), F.col("members") - 1 - F.col("doubled").cast("long")).otherwise(
        F.col("members") - 1 - (F.col("gap") & F.col("again")).cast("long"))
    best = F.when(F.get("first", F.lit(0))["word"] == F.col("word"), F.get("first", F.lit(1))).otherwise(F.get("first", F.lit(0)))
    told = shared.select("word", near.alias("near"), best.alias("best")).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return told.select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form: where the forms lead to in the end. Forms lead in no circle."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        # Everyone takes the pointer of the word pointed to.
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if now.join(further, "root", "left_semi").isEmpty():
            return now
        now = stored(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of ``docs`` (doc_id, text; more columns are ignored) with ``min_count`` occurrences.

    form: the commonest near word, if it is ``factor`` times as common, else null. Null and empty texts have no words; repeated rows count as often as they occur;
    an empty table gives no rows.
    """
    words = stored(counted(docs, min_length).filter(F.col("n") >= min_count), "words")
    near = words.join(neighbours(words), "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    has = F.col("best_n") >= factor * F.col("n")
    told = stored(near.select("word", F.when(has, F.col("best")).alias("form"), "n", "n_near", F.when(has, F.col("best_n")).alias("form_n")), "forms")
    found = roots(told.filter("form is not null"))
    return told.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
