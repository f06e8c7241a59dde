"""Versions, titles, ranges, task and request metrics, correction and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.exprs import exact_sum
from scholia.functions.ordered import add_rank, top_per_key


def next_versions(notes: DataFrame, new_notes: DataFrame, order: list[Column]) -> DataFrame:
    """Version of each new note: the resource's highest so far plus its place among the new ones."""
    top = notes.groupBy("resource_id").agg(F.max("version").alias("_max"))
    return (add_rank(new_notes, ["resource_id"], order, "_n").join(top, "resource_id", "left")
            .withColumn("next_version", F.coalesce("_max", F.lit(0)) + F.col("_n")).drop("_max", "_n"))


def next_title(titles: DataFrame, bases: DataFrame) -> DataFrame:
    """Next free `` N`` suffix. The bare title counts as 1; no title with the prefix leaves it bare.

    A title's candidate bases are its own prefixes, so this is an equi-join on the prefix.
    """
    n = F.regexp_extract("title", r" (\d+)$", 1)
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.length("title")), lambda i: F.col("title").substr(F.lit(1), i)))
    hits = (titles.filter("title <> ''").select("title", F.when(n != "", n.cast("long")).alias("_n"), prefixes.alias("base_title"))
            .join(bases.select("base_title").distinct(), "base_title")
            .withColumn("_n", F.when(F.col("title") == F.col("base_title"), F.lit(1)).otherwise(F.coalesce("_n", F.lit(0))))
            .groupBy("base_title").agg(F.max("_n").alias("_n")))
    free = F.when(F.coalesce("_n", F.lit(0)) > 0, F.concat(F.col("base_title"), F.lit(" "), (F.col("_n") + 1).cast("string")))
    return (bases.select("base_title").distinct().join(hits, "base_title", "left")
            .select("base_title", F.coalesce(free, F.col("base_title")).alias("next_title")))


def number_ranges(numbers: DataFrame, key: str, n: str) -> DataFrame:
    """Sorted distinct numbers as ``1-3, 5``; exactly two ranges are joined by ``&``.

    64 neighbouring numbers are the bits of one long, made before the shuffle. A run starts where the bit below is absent and ends where the
    bit above is; where a long begins or ends within a run, the two sides cancel. Only run ends are gathered per key, which is the size of
    the text that is written.
    """
    num, one = F.col(n).cast("long"), F.lit(1).cast("long")
    bit = F.call_function("shiftleft", one, num.bitwiseAND(F.lit(63)).cast("int"))
    longs = numbers.groupBy(key, F.shiftright(num, 6).alias("w")).agg(F.bit_or(bit).alias("m"))
    m, none = F.col("m"), F.array().cast("array<bigint>")

    def places(bits: Column) -> Column:
        on = F.filter(F.sequence(F.lit(0), F.length(F.bin(bits)) - 1), lambda i: F.getbit(bits, i) == 1)
        return F.coalesce(F.transform(on, lambda i: F.col("w") * 64 + i), none)
    # Without the first bit as a start and the last as an end: those depend on the neighbouring long.
    inner = longs.filter("m is null or m <> -1").select(
        key, places(m.bitwiseAND(F.bitwise_not(F.shiftleft(m, 1))).bitwiseAND(F.lit(-2))).alias("s"),
        places(m.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(m, 1))).bitwiseAND(F.lit(2**63 - 1))).alias("e"))
    sides = F.array_compact(F.array(F.when(m.bitwiseAND(one) == 1, F.struct(F.col("w").alias("at"), F.lit(True).alias("starts"))),
                                    F.when(m < 0, F.struct((F.col("w") + 1).alias("at"), F.lit(False).alias("starts")))))
    seams = (longs.select(key, F.inline(sides)).groupBy(key, "at").agg(F.bool_and("starts").alias("a"), F.bool_or("starts").alias("o")).filter("a = o")
             .select(key, F.when(F.col("a"), F.array(F.col("at") * 64)).otherwise(none).alias("s"),
                     F.when(F.col("a"), none).otherwise(F.array((F.col("at") - 1) * 64 + 63)).alias("e")))
    edges = inner.unionByName(seams).groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("s"),
                                                      F.sort_array(F.flatten(F.collect_list("e"))).alias("e"))
    label = F.zip_with("s", "e", lambda a, b: F.when(a == b, a.cast("string")).otherwise(
        F.concat(a.cast("string"), F.lit("-"), b.cast("string"))))
    return edges.select(key, F.when(F.size("s") == 2, F.array_join(label, " & ")).otherwise(F.array_join(label, ", ")).alias("ranges"))


def expand_ranges(titles: DataFrame) -> DataFrame:
    """Numbers behind a ``Topic``, ``Chapter``, ``Lec``, ``Lecture``, ``Sec`` or ``Section`` label.

    The label is kept only where all titles of the set carry the same one.
    """
    pattern = r"(?i)(Topic|Chapter|Lec|Lecture|Sec|Section)\s*(\d+(?:[-–,\s\d]+)*)"
    raw = F.regexp_extract("title", pattern, 1)
    t = titles.select("set_id", "title_id", F.when(raw != "", F.initcap(raw)).alias("label"),
                      F.regexp_extract("title", pattern, 2).alias("nums"))
    same = t.groupBy("set_id").agg((F.count_distinct("label") == 1).alias("_one"), (F.count("label") == F.count("*")).alias("_all"))
    part = F.explode(F.transform(F.split("nums", ","), lambda x: F.trim(x)))
    bounds = t.filter(F.col("label").isNotNull()).select("set_id", "title_id", "label", part.alias("p"))
    ends = F.transform(F.split("p", "[-–]"), lambda x: F.trim(x).try_cast("int"))
    first, last = F.try_element_at(ends, F.lit(1)), F.coalesce(F.try_element_at(ends, F.lit(2)), F.try_element_at(ends, F.lit(1)))
    return (bounds.withColumn("a", first).withColumn("b", last).filter("a <= b")
            .select("set_id", "title_id", "label", F.explode(F.sequence("a", "b")).alias("n")).distinct()
            .join(same, "set_id").select("title_id", F.when(F.col("_one") & F.col("_all"), F.col("label")).alias("label"), "n"))


def unique_violations(t: DataFrame, keys: list[Column], where: Column | None = None) -> DataFrame:
    kept = t if where is None else t.filter(where)
    return kept.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def active_progress(tasks: DataFrame) -> DataFrame:
    active = tasks.filter(F.col("status").isin("pending", "processing", "running"))
    return (active.groupBy("user_id")
            .agg((F.sum(F.coalesce("progress", F.lit(0))) / F.count("*")).alias("overall_progress")))


def marks_total(grades: DataFrame) -> DataFrame:
    """Marks of a session from its map of question scores; older entries count as one mark."""
    g = grades.select("session_id", F.explode("question_scores").alias("question", "g"))
    known = F.col("g.is_correct").isNotNull()
    max_marks = F.coalesce(F.nullif(F.col("g.total_max"), F.lit(0)), F.when(known, 1).otherwise(0))
    awarded = F.coalesce(F.col("g.total_awarded"), F.when(F.col("g.is_correct"), 1).otherwise(0))
    return g.groupBy("session_id").agg(F.sum(max_marks).alias("total_max"), F.sum(awarded).alias("total_awarded"))


def task_performance(runs: DataFrame, keys: list[str], history: int = 100) -> DataFrame:
    """Mean score and time over all runs, and the mean of the newest ``history`` scores.

    The exact mean is taken; truncating the running mean after every run would drift.
    """
    all_runs = runs.groupBy(*keys).agg(F.count("*").alias("n"), (exact_sum("score") / F.count("*")).alias("avg_score"),
                                       (exact_sum("ms") / F.count("*")).alias("avg_ms"))
    tail = top_per_key(runs.select(*keys, "score", "at", "run_id"), keys, [F.col("at").desc(), F.col("run_id")], history)
    return all_runs.join(tail.groupBy(*keys).agg((exact_sum("score") / F.count("*")).alias("recent_score")), keys)


def path_bucket(path: Column) -> Column:
    return (F.when(path.startswith("/note/"), "/note/{id}").when(path.startswith("/notes/"), "/notes/{id}")
            .when(path.startswith("/chat/"), "/chat/*").otherwise(path))


def request_metrics(requests: DataFrame, top: int = 20) -> DataFrame:
    """Totals, status counts and the busiest paths as (metric, key, value) rows.

    Requests are reduced once to counts per (bucket, status); every metric is read off those.
    """
    ms = F.greatest(F.col("duration_ms").cast("long"), F.lit(0))
    base = (requests.groupBy(path_bucket(F.col("path")).alias("bucket"), "status")
            .agg(F.count("*").alias("n"), F.sum(ms).alias("ms")))
    total = base.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("status") >= 500, F.col("n")).otherwise(0)).alias("e"),
                     F.sum("ms").alias("ms"))
    def item(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("metric"), F.lit("").alias("key"), value.cast("double").alias("value"))
    totals = total.select(F.inline(F.array(
        item("requests_total", F.coalesce("n", F.lit(0))), item("errors_total", F.coalesce("e", F.lit(0))),
        item("avg_duration_ms", F.coalesce(F.bround(F.col("ms") / F.col("n"), 2), F.lit(0.0))))))
    status = base.groupBy("status").agg(F.sum("n").alias("n")).select(
        F.lit("status").alias("metric"), F.col("status").cast("string").alias("key"), F.col("n").cast("double").alias("value"))
    paths = (base.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "bucket").limit(top)
             .select(F.lit("path").alias("metric"), F.col("bucket").alias("key"), F.col("n").cast("double").alias("value")))
    return totals.unionByName(status).unionByName(paths)


# -- correction feedback and run reports -------------------------------------------------------


def correction_types(corrections: DataFrame) -> DataFrame:
    counts = corrections.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("type", "n", (F.col("n") / total * 100).alias("pct")).orderBy(F.col("n").desc(), "type")


# Words that reveal where a corrected text came from; the first rule that fits wins.
SOURCE_WORDS = [("PPTX", ["slide", "slide number"]), ("PDF", ["page", "figure", "chapter"]), ("Scanned", ["ocr", "conf"])]


def source_class(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("Unknown")
    for label, words in reversed(SOURCE_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, label).otherwise(out)
    return out


# Fixed values: (target, correction types, least count, divisor, highest confidence).
TUNING_RULES = [
    ("SmartPipeline.pptx_heading_thresholds", ["heading_level", "mark_heading"], 3, 20, 0.95),
    ("ImagePreprocessor.clahe_clip_limit", ["ocr_correction"], 3, 15, 0.85),
    ("SignalMerger.list_detection", ["mark_list", "mark_olist", "mark_body"], 3, 15, 0.85),
]


def threshold_tuning(corrections: DataFrame) -> DataFrame:
    """Suggestions per correction file: grouped counts against the rules, and often ignored images."""
    counts = corrections.groupBy("file", "type").agg(F.count("*").alias("n"))
    rule = F.lit(None).cast("int")
    for i, r in enumerate(TUNING_RULES):
        rule = F.when(F.col("type").isin(r[1]), i).otherwise(rule)
    fired = counts.withColumn("r", rule).filter("r is not null").groupBy("file", "r").agg(F.sum("n").alias("n"))
    def pick(i):
        out = F.lit(TUNING_RULES[0][i])
        for k, r in enumerate(TUNING_RULES):
            out = F.when(F.col("r") == k, F.lit(r[i])).otherwise(out)
        return out
    general = (fired.filter(F.col("n") >= pick(2))
               .select("file", pick(0).alias("target"), F.lit("").alias("subject"), F.col("n").alias("correction_count"),
                       F.least(F.col("n") / pick(3), pick(4)).alias("confidence")))
    images = (corrections.filter(F.col("type") == "ignore_image").groupBy("file", F.col("image_path").alias("subject"))
              .agg(F.count("*").alias("n")))
    often = top_per_key(images, ["file"], [F.col("n").desc(), F.col("subject")], 3).filter("n >= 2")
    return general.unionByName(often.select(
        "file", F.lit("ImageClassifier.skip_images").alias("target"), "subject", F.col("n").alias("correction_count"),
        F.least(F.col("n") / 5, F.lit(0.95)).alias("confidence")))


def report_summary(results: DataFrame) -> DataFrame:
    n = F.count("score")
    r4 = lambda c: F.bround(F.coalesce(c, F.lit(0.0)), 4)
    return results.groupBy("run_id").agg(
        F.count("*").alias("files"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        r4(F.try_divide(exact_sum("score"), n)).alias("avg_score"), r4(F.max("score")).alias("max_score"),
        r4(F.min("score")).alias("min_score"), F.sum(F.coalesce("images", F.lit(0))).alias("images"),
        F.sum(F.coalesce("warnings", F.lit(0))).alias("warnings"))


def score_trend(reports: DataFrame) -> DataFrame:
    """Mean of the last three runs against the mean of those before.

    With two runs "recent" is both and "older" the first; with exactly three there is nothing
    older and its mean is 0. Older sums are totals minus the newest, so no history is gathered.
    """
    last = top_per_key(reports.select("series", "run_at", "score"), ["series"], [F.col("run_at").desc()], 3)
    newest = last.groupBy("series").agg(F.sum(F.col("score").cast("decimal(28,9)")).alias("r"), F.count("*").alias("rn"),
                                        F.min_by("score", "run_at").alias("first"))
    total = reports.groupBy("series").agg(F.sum(F.col("score").cast("decimal(28,9)")).alias("t"), F.count("*").alias("runs"))
    recent = F.col("r").cast("double") / F.col("rn")
    rest = F.col("runs") - F.col("rn")
    older = (F.when(F.col("runs") == 2, F.col("first")).when(rest > 0, (F.col("t") - F.col("r")).cast("double") / rest).otherwise(0.0))
    change = recent - older
    enough = F.col("runs") >= 2
    return newest.join(total, "series").select(
        "series", "runs",
        F.when(enough & (change > 0.01), "up").when(enough & (change < -0.01), "down").otherwise("stable").alias("direction"),
        F.when(enough, F.bround(change, 4)).alias("change"), F.when(enough, F.bround(recent, 4)).alias("recent_avg"),
        F.when(enough, F.bround(older, 4)).alias("older_avg"))


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.75, "B").when(score >= 0.5, "C").otherwise("D")


def scanned(pages: DataFrame) -> DataFrame:
    """Characters per page decide whether a document is a scan, and how surely."""
    base = pages.groupBy("doc_id").agg(F.count("page").alias("_p"), F.sum(F.length(F.trim("text"))).alias("_c"))
    per_page = F.try_divide(F.col("_c").cast("double"), F.col("_p").cast("double"))
    conf = (F.when(F.col("_p") == 0, 1.0).when(per_page < 20, 0.95).when(per_page < 50, 0.75).when(per_page < 200, 0.30).otherwise(0.05))
    return base.select("doc_id", per_page.alias("chars_per_page"),
                       ((F.col("_p") == 0) | (per_page < 200)).alias("is_scanned"), conf.alias("confidence"))
