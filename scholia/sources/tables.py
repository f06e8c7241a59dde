"""Lazy handles on the supplied Parquet tables and the domain tables derived from them.

A learning platform has users, subject groups, subjects, resources, notes, study sessions,
tasks and chat messages. Each is one projection (or one equi-join) over a supplied table, so
column pruning and filters still reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.text import let

TEXTS = ("documents", "pages", "conversations")
TEXT_PARTITIONS = "scholia.text.partitions"
NAMES = ("benchmark conversations customer documents embeddings events labels lineitem nation orders "
         "pages part region supplier").split()


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return self._spread(df) if name in TEXTS else df
        raise AttributeError(name)

    def _spread(self, df: DataFrame) -> DataFrame:
        """Text tables keep their splits unless the session names a number of partitions to deal them out to.

        ``scholia.text.partitions`` is for inputs of few row groups, which few cores would read and process alone.
        """
        n = self.spark.conf.get(TEXT_PARTITIONS, None)
        return df.repartition(int(n)) if n else df

    # -- people and the group > subject > resource > note hierarchy ------------------------

    @property
    def users(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("full_name"),
            F.when(F.col("c_acctbal") > 0, F.concat(F.lit("u"), F.col("c_custkey").cast("string"))).alias("nickname"),
            F.lower(F.concat(F.col("c_name"), F.lit("@example.com"))).alias("email"),
            F.lower("c_mktsegment").alias("tier"),
            F.col("c_nationkey").cast("long").alias("subject_id"),
        )

    @property
    def groups(self) -> DataFrame:
        return self.region.select(F.col("r_regionkey").cast("long").alias("group_id"), F.col("r_name").alias("name"))

    @property
    def subjects(self) -> DataFrame:
        region = F.col("n_regionkey").cast("long")
        return self.nation.select(
            F.col("n_nationkey").cast("long").alias("subject_id"),
            F.col("n_name").alias("name"),
            F.when(region != 4, region).alias("group_id"),
        )

    @property
    def user_subjects(self) -> DataFrame:
        """Subjects with an owner (one supplier is one subject, its nation number the owner)."""
        return self.supplier.select(
            F.col("s_suppkey").alias("subject_id"),
            F.col("s_name").alias("name"),
            F.col("s_nationkey").cast("long").alias("user_id"),
        )

    @property
    def user_groups(self) -> DataFrame:
        return self.nation.select(
            F.col("n_nationkey").cast("long").alias("group_id"),
            F.col("n_name").alias("name"),
            F.col("n_regionkey").cast("long").alias("user_id"),
        )

    @property
    def resources(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("resource_id"),
            F.col("o_custkey").alias("user_id"),
            F.concat(F.lit("Resource "), F.col("o_orderkey").cast("string")).alias("title"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("kind"),
            F.col("o_orderdate").alias("created_at"),
            F.pmod("o_custkey", F.lit(25)).alias("subject_id"),
            (F.floor("o_totalprice") * 100).alias("file_size"),
        )

    @property
    def notes(self) -> DataFrame:
        part = [F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
        return self.lineitem.select(
            F.concat_ws("_", F.lit("nt"), *part, F.date_format("l_shipdate", "yyyyMMdd")).alias("note_id"),
            F.col("l_orderkey").alias("resource_id"),
            F.col("l_linenumber").cast("long").alias("version"),
            F.col("l_shipdate").alias("created_at"),
            F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("user_id"),
            (F.col("l_returnflag") == "A").alias("is_pinned"),
            F.col("l_quantity").cast("long").alias("n_words"),
        )

    # -- activity --------------------------------------------------------------------------

    @property
    def sessions(self) -> DataFrame:
        minutes = F.floor("value")
        k = F.get_json_object("props", "$.k").cast("long")
        kind = (F.when(F.col("event_type") == "view", "short_break")
                .when(F.col("event_type") == "signup", "long_break").otherwise("study"))
        return self.events.select(
            F.col("event_id").alias("id"),
            "user_id",
            F.when(k != 0, k).alias("resource_id"),
            kind.alias("session_type"),
            minutes.alias("duration_minutes"),
            F.pmod(minutes, F.lit(11)).alias("attempted"),
            F.pmod(minutes, F.pmod(minutes, F.lit(11)) + 1).alias("correct"),
            F.when(F.col("event_type") == "click", F.col("value")).alias("score"),
            F.col("ts").alias("created_at"),
        )

    @property
    def tasks(self) -> DataFrame:
        status = (F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running")
                  .when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
                  .otherwise("cancelled"))
        kind = (F.when(F.pmod("event_id", F.lit(3)) == 0, "ocr").when(F.pmod("event_id", F.lit(3)) == 1, "chat")
                .otherwise("exercise"))
        return self.events.select(
            F.col("event_id").alias("task_id"), "user_id", kind.alias("task_type"), status.alias("status"),
            F.when(F.col("value") < 100, F.floor("value")).alias("progress"), F.col("ts").alias("updated_at"))

    @property
    def audit_log(self) -> DataFrame:
        action = F.when(F.col("event_type") == "signup", "login").otherwise(F.col("event_type"))
        return self.events.select(F.col("event_id").alias("log_id"), "user_id", action.alias("action"),
                                  F.col("ts").alias("created_at"))

    @property
    def questions_asked(self) -> DataFrame:
        """Chat messages without text: one per click, for counting."""
        return (self.events.filter(F.col("event_type") == "click")
                .select(F.col("event_id").alias("message_id"), "user_id",
                        F.get_json_object("props", "$.k").cast("long").alias("conversation_id"),
                        F.col("ts").alias("created_at")))

    @property
    def requests(self) -> DataFrame:
        """Web requests: path from the pages table's URLs, status and time from the events."""
        path = (F.when(F.col("event_type") == "click", F.concat(F.lit("/chat/"), F.col("event_id").cast("string")))
                .when(F.col("event_type") == "view", F.concat(F.lit("/note/"), F.col("event_id").cast("string")))
                .when(F.col("event_type") == "purchase", "/notes/list")
                .when(F.col("event_type") == "signup", F.concat(F.lit("/uploads/"), F.col("user_id").cast("string")))
                .otherwise("/health"))
        status = (F.when(F.col("event_type") == "error", 500)
                  .when(F.pmod("event_id", F.lit(17)) == 0, 404).otherwise(200))
        return self.events.select(F.col("event_id").alias("request_id"), "user_id", F.col("ts"), path.alias("path"),
                                  status.alias("status"), F.col("value").alias("duration_ms"))

    # -- conversations ---------------------------------------------------------------------

    @property
    def turns(self) -> DataFrame:
        return self.conversations.select(
            F.col("conv_id").alias("conversation_id"), "turn", "role", "text",
            F.pmod("conv_id", F.lit(150)).alias("user_id"),
            F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, turn)").alias("created_at"))

    @property
    def chat_messages(self) -> DataFrame:
        """User turn with the assistant turn that follows it: an equi-join, never a per-thread sort."""
        t = self.turns
        asked = t.filter(F.col("role") == "user")
        answered = (t.filter(F.col("role") == "assistant")
                    .select("conversation_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")))
        conv = F.col("conversation_id")
        scope = F.pmod(conv, F.lit(4))
        return (asked.join(answered, ["conversation_id", "turn"], "left")
                .select("conversation_id", "turn", "user_id", F.col("text").alias("message"), "response", "created_at",
                        F.when(F.col("turn") <= 1, F.substring("text", 1, 40)).alias("title"),
                        (F.pmod(conv, F.lit(7)) == 0).alias("is_pinned"),
                        ((F.pmod(conv, F.lit(5)) == 0) & (F.col("turn") > 1)).alias("is_favourite"),
                        F.when(scope == 1, conv).alias("resource_id"),
                        F.when(scope.isin(1, 2), F.pmod(conv, F.lit(25))).alias("subject_id"),
                        F.when(scope == 3, F.pmod(conv, F.lit(5))).alias("group_id"),
                        F.when(F.pmod(conv, F.lit(3)) == 0, F.pmod(conv, F.lit(10))).alias("exercise_id")))

    # -- documents with the marks a fixture lacks ---------------------------------------------
    #
    # The supplied prose has no Markdown. Each line keeps its text and gets the marks of its place
    # in a fixed cycle, or a line of marks above it, so every document carries headings, lists, tables, fences and boilerplate.

    def _marked(self, shape) -> DataFrame:
        return self.documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), shape), "\n").alias("text"))

    @property
    def markdown(self) -> DataFrame:
        def shape(x, i):
            m = F.pmod(i, F.lit(14))
            pre = lambda mark: F.concat(F.lit(mark), x)
            return (F.when(m == 0, pre("# ")).when(m == 2, pre("- ")).when(m == 3, pre("## ")).when(m == 4, pre("1. "))
                    .when(m == 5, F.concat(F.lit("| "), F.replace(x, F.lit(" "), F.lit(" | ")), F.lit(" |")))
                    .when(m == 6, pre("|---|---|\n")).when(m == 7, pre("#### ")).when(m.isin(8, 10), pre("```\n"))
                    .when(m == 9, F.concat(F.lit("x = f("), x, F.lit(");")))
                    .when(m == 11, pre("\n")).when(m == 12, F.concat(F.lit("![fig]("), F.substring(x, 1, 3), F.lit(".png) see figure 2 "), x))
                    .when(m == 13, pre("# Topic 4: ")).otherwise(x))
        return self._marked(shape)

    @property
    def slides(self) -> DataFrame:
        def shape(x, i):
            m = F.pmod(i, F.lit(11))
            return (F.when(m == 0, F.concat(F.lit("### "), x, F.lit(" (1 of 3)")))
                    .when(m == 1, F.concat(F.lit("© 2024 "), x)).when(m == 2, F.concat(F.lit("•\n"), x))
                    .when(m == 3, F.concat(F.lit("<!-- Start of picture text -->\n"), x))
                    .when(m == 4, F.concat(F.substring(x, 1, 9), F.lit("<br>"), x))
                    .when(m == 5, F.concat(F.lit("<!-- End of picture text -->\n"), x)).when(m == 6, F.concat(F.lit("##### "), x)).when(m == 7, F.concat(F.lit(" 12 \n"), x))
                    .when(m == 8, F.concat(x, F.lit(" All rights reserved"))).when(m == 9, F.concat(F.lit("# "), x)).otherwise(x))
        return self._marked(shape)

    @property
    def scans(self) -> DataFrame:
        def shape(x, i):
            m = F.pmod(i, F.lit(13))
            above = lambda mark: F.concat(F.lit(mark + "\n"), x)
            return (F.when(m == 0, above("SECTION ALPHA-BETA")).when(m == 1, F.concat(F.lit("• "), x)).when(m == 2, above("1 2 3.5 4 5"))
                    .when(m == 3, above(">}")).when(m == 4, F.concat(x, F.lit("-"))).when(m == 5, above("Page 3")).when(m == 6, above("www.example.com"))
                    .when(m == 7, F.concat(F.lit("1. "), x)).when(m == 8, F.concat(x, F.lit("|| _____ x·")))
                    .when(m == 9, F.concat(F.lit("  q  "), x)).when(m == 10, F.concat(F.lit("Page 3 of "), F.length(x).cast("string"), F.lit("\n"), x))
                    .when(m == 11, above("KPI: 12 ROWS!")).when(m == 12, F.concat(F.lit("Chapter 2 "), x)).otherwise(x))
        return self._marked(shape)

    # -- blocks, spans and images as an extractor would give them -------------------------------

    @property
    def blocks(self) -> DataFrame:
        """One row per document with its block array; line i of the text is block i."""
        def block(x, i):
            m = F.pmod(i, F.lit(12))
            num = F.floor(i / 12).cast("string")
            cat = F.concat
            lit = F.lit
            kind = (F.when(m == 0, "h1").when(m == 5, "h2").when(m == 7, "h3").when(m.isin(2, 4, 9), "list").when(m == 11, "ordered_list")
                    .otherwise("body"))
            text = (F.when(m == 0, cat(lit("Chapter "), num, lit(" "), x))
                    .when((m == 1) & (F.pmod(F.col("doc_id"), lit(4)) == 1), cat(x, lit(" Letter: A = 0101 Number: 9 = 1001")))
                    .when(m == 3, cat(lit("and "), x))
                    .when(m == 5, cat(lit("2."), num, lit(" "), x))
                    .when(m == 6, cat(lit("• "), F.substring(x, 1, 20), lit(" • "), F.substring(x, 21, 1_000_000_000), lit(" ‣ z")))
                    .when(m == 7, cat(x, lit(" (cont.)"))).when(m == 8, cat(lit("- -"), x, lit(": -Tail")))
                    .when(m == 9, cat(x, lit(" Advantages of it: ")))
                    .when(m == 10, cat(x, lit(". Types of nets:"))).when(m == 11, cat(lit("1. "), x)).otherwise(x))
            size = F.when(m == 0, 24.0).when(m == 5, 18.0).when(m == 7, 14.04).otherwise(11.0)
            return F.struct(i.alias("pos"), (F.floor(i / 20) + 1).cast("int").alias("page"), (F.pmod(i, lit(20)) * 10.0).alias("y"),
                            kind.alias("type"), text.alias("text"), size.alias("font_size"),
                            F.when(m.isin(3, 4), 1).otherwise(0).alias("indent"))
        kind = "array<struct<pos:int,page:int,y:double,type:string,text:string,font_size:double,indent:int>>"
        return self.documents.select("doc_id", F.transform(F.split("text", "\n"), block).cast(kind).alias("blocks"))

    @property
    def span_pages(self) -> DataFrame:
        """One row per page (a line of the text) with its spans: six words each, two spans to a row."""
        page = self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        page = page.select("doc_id", (F.col("line_no") + 1).alias("page"), "line")
        two = F.pmod("page", F.lit(7)) == 0
        def cut(w):
            def span(g):
                r, c = F.floor(g / 2), F.pmod(g, F.lit(2))
                text = F.array_join(F.slice(w, (g * 6 + 1).cast("int"), F.lit(6)), " ")
                bullet = F.pmod(r, F.lit(4)) == 3
                text = F.when(bullet & (c == 0), F.concat(F.lit("• "), text)).otherwise(text)
                x0 = F.when(c == 1, 320.0).when(bullet, 70.0).otherwise(50.0)
                size = F.when((r == 0) & (F.pmod("page", F.lit(3)) == 1), 24.0).when((r == 0) & (F.pmod("page", F.lit(3)) == 2), 18.0).otherwise(11.0)
                top = 60.0 + r * 14
                name = F.when(F.pmod("page", F.lit(5)) == 4, "Courier").otherwise("Arial")
                def build(x):
                    x1 = F.when(two, x0 + F.least(F.length(x) * 5, F.lit(200))).otherwise(x0 + F.when(c == 0, 269.0).otherwise(F.length(x) * 5.0))
                    return F.struct(g.cast("int").alias("span_no"), x.alias("text"), name.alias("font_name"), size.alias("font_size"),
                                    (size > 20).alias("is_bold"), F.lit(False).alias("is_italic"), x0.alias("x0"), x1.cast("double").alias("x1"),
                                    top.cast("double").alias("top"), (top + size).cast("double").alias("bottom"))
                return let(text, build)
            n = F.ceil(F.size(w) / 6)
            spans = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), span)
            return F.when(n > 0, F.struct(spans.alias("spans"), (180.0 + F.ceil(n / 2) * 14).cast("double").alias("height")))
        # Inlined, as a filter on the struct would work the spans out once more.
        made = page.select("doc_id", "page", F.inline(F.array_compact(F.array(let(F.filter(F.split("line", r"\s+"), lambda x: x != ""), cut)))))
        return made.select("doc_id", "page", F.lit(600.0).alias("width"), "height", "spans")

    @property
    def images(self) -> DataFrame:
        v = F.floor("value").cast("double")
        k = F.get_json_object("props", "$.k").cast("int")
        shape = F.when(F.col("event_type") == "click", "chart").when(F.col("event_type") == "view", "picture").otherwise("other")
        return self.events.select(
            F.col("user_id").alias("doc_id"), F.col("event_id").alias("image_id"), (F.pmod(k, F.lit(4)) + 1).alias("page"),
            (k * 5.0).alias("x"), (v * 3).alias("y"), (v * 20).alias("width"), (k * 8.0).alias("height"), F.lit(600.0).alias("page_width"),
            F.lit(800.0).alias("page_height"), shape.alias("shape"), F.md5("props").alias("md5"),
            F.concat(F.lit("![img]("), F.col("event_id").cast("string"), F.lit(".png)")).alias("ref"))
