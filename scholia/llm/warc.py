"""Revisit records that say "not modified", resolved to the response they stand for.

Each revisit meets the latest earlier full response of its canonical URL (an as-of join), its validators are checked against that response, and the
headers that a 304 may update are merged into the stored ones.

Scale: only keys and validators are ordered. A URL's records are cut into chunks of time; windows run within a chunk, and a second one over the
chunks' last responses, so a URL that holds most records is many groups. Headers and payload are fetched by record id at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import let

CHUNK_SECONDS = 86_400
# Query parameters that never change the page, and header fields that a 304 does not update.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid|phpsessid)(=|$)"
KEPT_FIELDS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
               "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., user and default port; path without a closing slash; sorted query without tracking; no scheme and fragment."""
    host = F.lower(F.regexp_extract(url, AUTHORITY, 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@|:(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, PATH, 1), "/+$", "")
    fields = F.filter(F.split(F.regexp_extract(url, QUERY, 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    return let(F.array_join(F.array_sort(fields), "&"), lambda q: F.concat(host, path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def weak(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^\s*W/", "")


def latest_before(records: DataFrame, what: Column, name: str, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Adds ``name``: ``what`` of the latest record of the same ``key`` with a non-null ``what`` and a smaller (date, record_id); key and date are not null."""
    rows = records.withColumn("_what", what).withColumn("_chunk", F.floor(F.col("date").cast("long") / chunk_seconds))
    order = F.struct("date", "record_id")
    before = Window.partitionBy("key", "_chunk").orderBy("date", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    lasts = rows.filter("_what is not null").groupBy("key", "_chunk").agg(F.max_by("_what", order).alias("_last"))
    # Only chunks that hold something are listed; each row of the data finds the latest listed chunk before its own.
    chunks = rows.select("key", "_chunk").distinct().join(lasts, ["key", "_chunk"], "left")
    earlier = Window.partitionBy("key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    found = rows.withColumn("_own", F.last("_what", ignorenulls=True).over(before)).join(chunks, ["key", "_chunk"])
    return found.withColumn(name, F.coalesce("_own", "_before")).drop("_what", "_chunk", "_own", "_before")


def resolve(records: DataFrame, carry: list[str]) -> DataFrame:
    """One row per revisit: record_id, key (canonical URL), outcome, response_id, headers and the ``carry`` columns of the response.

    ``records``: record_id, url, date, kind ("response" or "revisit"), status, headers (lower-case names), and ``carry``. Full responses have
    status 200. Outcomes: ``resolved``; ``mismatch`` (the latest earlier response has another ETag, weakly compared, or without an ETag in
    the revisit another Last-Modified); ``unchecked`` (the revisit has no validator); ``no_response`` (none earlier, or no url or date). Only
    resolved rows have headers (stored ones, updated by what a 304 may update) and carried columns. Of responses with one record_id one is
    used; repeated revisits stay.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    key = records.select("record_id", "date", "kind", "status", canonical_url(F.col("url")).alias("key"), F.col("headers")["etag"].alias("etag"),
                         F.col("headers")["last-modified"].alias("modified"))
    known = key.filter("key is not null and date is not null and record_id is not null")
    stored = F.when(full, F.struct(F.col("record_id").alias("response_id"), "etag", "modified"))
    found = latest_before(known, stored, "stored").filter(F.col("kind") == "revisit")
    same = (F.when(F.col("etag").isNotNull(), weak(F.col("etag")).eqNullSafe(weak(F.col("stored.etag"))))
            .when(F.col("modified").isNotNull(), F.col("modified").eqNullSafe(F.col("stored.modified"))))
    outcome = (F.when(F.col("stored").isNull(), "no_response").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch"))
    found = found.select("record_id", "key", outcome.alias("outcome"), F.col("stored.response_id").alias("response_id"))
    lost = key.filter("kind = 'revisit' and (key is null or date is null or record_id is null)").select(
        "record_id", "key", F.lit("no_response").alias("outcome"), F.lit(None).cast(dict(records.dtypes)["record_id"]).alias("response_id"))
    revisits = records.filter("kind = 'revisit'").select(F.col("record_id").alias("_r"), F.col("headers").alias("_sent")).dropDuplicates(["_r"])
    responses = records.filter(full).select(F.col("record_id").alias("_s"), F.col("headers").alias("_stored"), *carry).dropDuplicates(["_s"])
    # Rows that need no response go by their own id, so that they do not meet in one task.
    resolved = F.col("outcome") == "resolved"
    needed = F.when(resolved, F.col("response_id")).otherwise(F.col("record_id"))
    out = found.join(revisits, F.col("record_id") == F.col("_r"), "left").join(responses, (needed == F.col("_s")) & resolved, "left")
    sent = F.map_filter("_sent", lambda k, v: ~k.isin(KEPT_FIELDS))
    merged = F.map_concat(F.map_filter("_stored", lambda k, v: ~F.map_contains_key(sent, k)), sent)
    out = out.select("record_id", "key", "outcome", "response_id", F.when(F.col("_s").isNotNull(), merged).alias("headers"), *carry)
    return out.unionByName(lost, allowMissingColumns=True)


# -- records of the supplied pages -------------------------------------------------------------------

START = 1_700_000_000


def page_records(pages: DataFrame) -> DataFrame:
    """A crawl history of ``pages``: per page a full response, a revisit a week later, and for some an earlier revisit that nothing precedes.

    The first hex digit of the html's MD5 decides the validators of the revisit: the same ETag, the same but weak, another one, or only the date.
    Carries payload_sha256 and payload_bytes.
    """
    html, at = F.coalesce("html", F.lit("")), F.lit(START) + F.col("page_id") * 60
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(html), 1, 1))
    base = pages.select("page_id", "url", F.md5(html).alias("md5"), at.alias("at"), digit.alias("digit"), F.sha2(html, 256).alias("payload_sha256"),
                        F.octet_length(html).cast("long").alias("payload_bytes"))
    quoted = F.concat(F.lit('"'), F.col("md5"), F.lit('"'))
    modified = F.col("at").cast("string")
    kind = F.col("digit") % 4
    etag = F.when(kind == 0, quoted).when(kind == 1, F.concat(F.lit("W/"), quoted)).when(kind == 2, F.lit('"other"'))
    fields = lambda *kv: F.map_filter(F.create_map(*kv), lambda k, v: v.isNotNull())
    text = F.lit
    full = fields(text("etag"), quoted, text("last-modified"), modified, text("content-type"), text("text/html"),
                  text("content-length"), F.col("payload_bytes").cast("string"), text("cache-control"), text("max-age=60"))
    again = fields(text("etag"), etag, text("last-modified"), F.when(kind == 3, modified), text("content-length"), text("0"),
                   text("cache-control"), text("max-age=120"), text("x-seen"), text("again"))
    row = lambda n, kind_, status, shift, headers: F.struct(
        (F.col("page_id") * 4 + n).alias("record_id"), "url", F.timestamp_seconds(F.col("at") + shift).alias("date"), text(kind_).alias("kind"),
        text(status).alias("status"), headers.alias("headers"), "payload_sha256", "payload_bytes")
    rows = F.array(row(0, "response", 200, 0, full), row(1, "revisit", 304, 604_800, again), row(2, "revisit", 304, -1, again))
    return base.select(F.inline(F.filter(rows, lambda r: (r["record_id"] % 4 != 2) | (F.col("digit") > 12))))
