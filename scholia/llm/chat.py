"""Chat formatting in relational steps; native expressions only.

Turns are collected per conversation as structs and sorted, adjacent turns of one role are merged into blocks by an array fold, and blocks
are joined to one string. Control strings start and divide blocks:

    <|turn|>role<|text|>text<|next|>text of a merged turn<|end|>

Inside roles and texts a backslash is doubled and every control string gets one after its first character, so none can be forged and
removing one backslash each restores the text to the letter. Strings of other common templates are escaped as well.

Scale: one shuffle on the conversation, which is one output row and so is gathered whole in any case; nothing else is. Folds run within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
# Control strings that texts must not hold; "<|" covers this template's own.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        out = F.replace(out, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return out


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, mask from conv_id, turn, role, text (more columns are ignored).

    Null roles and texts are empty; null conv_ids are one conversation; turns with equal numbers (null first) go by role, then text, and repeated
    rows stay. ``mask``: start and end (code points, end exclusive) of the assistant's texts within ``formatted``, one span per turn.
    """
    own = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # A turn opens a block unless it has the role of the turn before it, and closes one unless the next has its role.
    n = F.size("turns")
    other = lambda i, j: ~F.get("turns", i)["role"].eqNullSafe(F.get("turns", j)["role"])
    pieces = F.transform("turns", lambda t, i: F.struct(
        F.when(other(i, i - 1), F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))).otherwise(F.lit(NEXT)).alias("head"), escape(t["text"]).alias("body"),
        F.when((i == n - 1) | other(i, i + 1), F.lit(END)).otherwise(F.lit("")).alias("tail"), (t["role"] == "assistant").alias("learn")))
    whole = whole.select("conv_id", pieces.alias("pieces"))
    size = lambda p, k: F.char_length(p[k]).cast("long")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    mask = F.aggregate("pieces", F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), lambda a, p: F.struct(
        (a["at"] + size(p, "head") + size(p, "body") + size(p, "tail")).alias("at"),
        F.when(p["learn"], F.concat(a["out"], F.array(F.struct((a["at"] + size(p, "head")).alias("start"), (a["at"] + size(p, "head") + size(p, "body")).alias("end")))))
        .otherwise(a["out"]).alias("out")), lambda a: a["out"])
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return whole.select("conv_id", text.alias("formatted"), mask.alias("mask"))


def read_back(done: DataFrame) -> DataFrame:
    """conv_id and turns (role, text) read from the strings alone."""
    blocks = F.filter(F.split("formatted", r"<\|turn\|>"), lambda b: b != "")
    def turns(b: Column) -> Column:
        role = unescape(F.substring_index(b, TEXT, 1))
        inside = F.substr(b, F.locate(TEXT, b) + len(TEXT), F.char_length(b))
        texts = F.split(F.substring_index(inside, END, 1), r"<\|next\|>", -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))
    return done.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"), "formatted", "mask")


def digests(done: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the formatted strings and their masks."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
    return read_back(done).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), learnt.alias("_l"), "formatted").select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("_l").cast("long").alias("loss_chars"), F.sha2("_l", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
