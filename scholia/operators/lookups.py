"""Projections, filters and predicates."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.exprs import seconds_between
from scholia.params import at


def owned_lookup(rows: DataFrame, asked: DataFrame, id_col: str, owner_col: str) -> DataFrame:
    """Ownership-checked get for a table of (id, owner) requests."""
    return rows.join(asked.select(id_col, owner_col).distinct(), [id_col, owner_col], "left_semi")


def optional_filters(t: DataFrame, order: list[Column], **equals) -> DataFrame:
    """Conjunction of the filters that were given; None means not given."""
    for name, value in equals.items():
        if value is not None:
            t = t.filter(F.col(name) == value)
    return t.orderBy(*order)


def in_list(t: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Asked keys with whether each was found; complete when none is missing."""
    found = t.select(key).distinct().withColumn("found", F.lit(True))
    return keys.select(key).distinct().join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def ci_equality(users: DataFrame, asked: DataFrame) -> DataFrame:
    """Users whose e-mail equals an asked one in any case, other than the asker itself."""
    a = asked.select(F.lower("email").alias("_key"), F.col("exclude_id"))
    return (users.withColumn("_key", F.lower("email")).join(a, "_key")
            .filter(F.col("exclude_id").isNull() | (F.col("user_id") != F.col("exclude_id")))
            .select("user_id", "email"))


def prefix_match(t: DataFrame, col: str, prefix: str) -> DataFrame:
    """``startswith``, not LIKE: ids contain ``_``, which LIKE reads as a wildcard."""
    return t.filter(F.col(col).startswith(prefix))


def not_equal_or_null(t: DataFrame, col: str, value) -> DataFrame:
    return t.filter(F.col(col).isNull() | (F.col(col) != value))


def own_or_shared(templates: DataFrame, user_id) -> DataFrame:
    return (templates.filter((F.col("user_id") == user_id) | F.col("user_id").isNull())
            .orderBy(F.col("is_default").desc(), F.col("name"), F.col("id")))


def substring_search(t: DataFrame, cols: list[str], needle: str) -> DataFrame:
    hits = [F.coalesce(F.lower(c), F.lit("")).contains(needle.lower()) for c in cols]
    return t.filter(reduce(lambda a, b: a | b, hits))


def is_hung(as_of: datetime.datetime, seconds: int = 3600) -> Column:
    return F.col("status").isin("pending", "running") & (seconds_between(at(as_of), F.col("updated_at")) > seconds)


def token_status(invites: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """First failed rule, or ok: used, expired, wrong address (link-only invites are exempt)."""
    reason = (F.when(F.col("is_used"), "used")
              .when(F.col("expires_at") < at(as_of), "expired")
              .when(~F.col("link_only") & (F.lower("invited_email") != F.lower("presented_email")), "wrong_email")
              .otherwise("ok"))
    return invites.select("token", (reason == "ok").alias("is_valid"), reason.alias("reason"))


def ip_rules(requests: DataFrame, rules: DataFrame, lockdown: bool) -> DataFrame:
    """Lock-down admits private addresses only; then single-address blacklist rules apply."""
    ip = F.col("ip")
    private = (ip.startswith("127.") | ip.startswith("192.168.") | ip.startswith("10.") | (ip == "::1"))
    blocked = (rules.filter((F.col("rule_type") == "specific_ip") & (F.col("filter_type") == "blacklist"))
               .select(F.col("value").alias("ip")).distinct().withColumn("_blocked", F.lit(True)))
    reason = (F.when(F.lit(lockdown) & ~private, "lockdown").when(F.col("_blocked").isNotNull(), "blacklisted")
              .otherwise("ok"))
    return (requests.join(blocked, "ip", "left")
            .select("request_id", (reason == "ok").alias("allowed"), reason.alias("reason")))


def entity_type(col: Column) -> Column:
    """Kind of an entity, from the type tag its id starts with."""
    return (F.when(col.startswith("rs_"), "resource").when(col.startswith("nt_"), "note")
            .when(col.startswith("ex_"), "exercise").otherwise("unowned"))


def byte_size(col: Column) -> Column:
    """Bytes in B, KB, MB or GB with one decimal."""
    def unit(power: int, label: str) -> Column:
        return F.concat(F.format_string("%.1f", F.bround(col / F.lit(float(1024 ** power)), 1)), F.lit(label))
    return (F.when(col < 1024, F.concat(col.cast("string"), F.lit(" B")))
            .when(col < 1024 ** 2, unit(1, " KB")).when(col < 1024 ** 3, unit(2, " MB")).otherwise(unit(3, " GB")))


def study_time(minutes: Column) -> Column:
    m = minutes.cast("string")
    return F.when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "),
                                          F.pmod(minutes, F.lit(60)).cast("string"), F.lit("m"))
                  ).otherwise(F.concat(m, F.lit("m")))


def title_words(col: Column) -> Column:
    """``snake_case`` to capitalised words; the rest of each word is kept."""
    return F.array_join(F.transform(F.split(col, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                                                        w.substr(F.lit(2), F.length(w)))), " ")


def parameter_label(mode: Column, fmt: Column, method: Column) -> Column:
    """``Mode in Format (Method)`` of the parts that are present."""
    parts = F.filter(F.array(mode, fmt, method), lambda p: p.isNotNull() & (p != ""))
    labels = F.transform(parts, title_words)
    n = F.size(labels)
    first, second, third = (F.try_element_at(labels, F.lit(i)) for i in (1, 2, 3))
    return (F.when(n == 3, F.concat(first, F.lit(" in "), second, F.lit(" ("), third, F.lit(")")))
            .when(n == 2, F.concat(first, F.lit(" in "), second)).when(n == 1, first).otherwise(F.lit("")))


# MIME substrings per file family, first match wins.
MIME_FAMILIES = [("PDF", ["pdf"]), ("PowerPoint", ["presentation", "powerpoint", "pptx"]),
                 ("Image", ["image", "png", "jpeg", "jpg"]), ("Word", ["word", "docx", "document"]),
                 ("Excel", ["spreadsheet", "excel", "xlsx"])]


def mime_family(mime: Column) -> Column:
    low = F.lower(mime)
    out = F.when(F.coalesce(mime, F.lit("")) == "", "DOCUMENT")
    for label, marks in MIME_FAMILIES:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(m) for m in marks]), label)
    return out.otherwise(F.upper(F.coalesce(F.try_element_at(F.split(low, "/"), F.lit(2)), low)))


def validity(t: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """Reason code of every broken rule, in rule order; a row without any is valid."""
    reasons = F.array_compact(F.array(*[F.when(~ok, F.lit(code)) for code, ok in rules.items()]))
    return t.select(id_col, (F.size(reasons) == 0).alias("is_valid"), F.array_join(reasons, ",").alias("reasons"))
