"""Small hand-made inputs, expected results worked out by hand or by a plain loop."""

import difflib
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scholia.functions import ordered
from scholia.functions import vectors as V
from scholia.operators import blocks as B
from scholia.operators import chunking, cleaning, images, joins, layout, quality, questions, ranking, reports, retrieval
from scholia.operators import rewriting as R
from scholia.sources import writers
from scholia.streaming import state as S


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def apply(spark, fn, *texts):
    return [r.x for r in docs(spark, *texts).select("doc_id", fn(F.col("text")).alias("x")).orderBy("doc_id").collect()]


# -- chunking -----------------------------------------------------------------------------------


def greedy(text, size):
    """Brute force: words into the open chunk until its length with blanks reaches the size."""
    out, cur, start, at = [], [], 0, 0
    for w in text.split():
        if not cur:
            start = at
        cur.append(w)
        at += len(w) + 1
        if sum(len(x) + 1 for x in cur) >= size:
            out.append((" ".join(cur), start))
            cur = []
    return out + ([(" ".join(cur), start)] if cur else [])


def test_chunk_chars(spark):
    rng = random.Random(3)
    texts = [" ".join("x" * rng.randint(1, 9) for _ in range(n)) for n in (1, 5, 40, 300)] + ["", "   ", "a\n b\tc"]
    got = chunking.chunk_chars(docs(spark, *texts), 50).orderBy("doc_id", "chunk_index").collect()
    for i, text in enumerate(texts):
        assert [(r.text, r.position) for r in got if r.doc_id == i] == greedy(text, 50)
        assert " ".join(r.text for r in got if r.doc_id == i) == " ".join(text.split())


def test_chunk_words_keeps_covered_tail(spark):
    text = " ".join(f"w{i}" for i in range(100))
    chunks = apply(spark, lambda c: chunking.chunk_words(c, 60, 20), text)[0]
    assert [c.split()[0] for c in chunks] == ["w0", "w40", "w80"]


def test_chunk_headings(spark):
    lines = ["# a", "x" * 20, "## b", "y" * 5, "## c", "z"]
    got = [r.text for r in chunking.chunk_headings(docs(spark, "\n".join(lines)), 25).orderBy("chunk_index").collect()]
    assert got == ["# a\n" + "x" * 20, "## b\nyyyyy\n## c\nz"]


def test_chunk_breaks(spark):
    text = "\n".join(["a" * 30, "", "b" * 10, "## h", "", "c" * 30, ""])
    got = [r.text for r in chunking.chunk_breaks(docs(spark, text), 20).orderBy("chunk_index").collect()]
    assert got == ["a" * 30, "b" * 10 + "\n## h\n\n" + "c" * 30] or got == ["a" * 30, "b" * 10 + "\n## h", "c" * 30]


# -- rewrites -----------------------------------------------------------------------------------


def test_validate_markdown(spark):
    cases = {
        "# A\n- x\n## B\ntext": "# A\n- x\n**B**\n\ntext",
        "# A\n# B\n## \n## End of Topic\nz": "# A\n## B\nz",
        "```\ncode\n# H": "```\ncode\n```\n# H\n```\n```",
        "Topic 3: Sets\nbody": "# Topic 3: Sets\n\nTopic 3: Sets\nbody",
        "# A\n\n\n\n\n\nb": "# A\n\n\nb",
        "": "",
    }
    assert apply(spark, R.validate_markdown, *cases) == list(cases.values())


def test_slide_headings(spark):
    text = "## Goals (1 of 2)\na\n## Goals (2 of 2)\nb\n# One\n# Two\n##### deep"
    assert apply(spark, R.slide_headings, text) == ["## Goals\na\nb\n# One\n## Two\n### deep\n"]
    assert apply(spark, R.slide_headings, "\n# Chapter 2\n\nGraphs\nThird edition\nx") == ["# Chapter 2: Graphs\n\nx\n"]


def test_duplicate_fences(spark):
    assert apply(spark, R.duplicate_fences, "a\n```\nx\n```\n```\nx\n```\n```\ny\n```") == ["a\n```\nx\n```\n```\ny\n```"]


def test_table_overlap(spark):
    table = "| one two | three four |"
    near, far = "one two three four", "one two three four five six"
    text = "\n".join([table, near, far, "x", near, table, "- one two three four"])
    assert apply(spark, R.table_overlap, text) == ["\n".join([table, far, "x", near, table, "- one two three four"])]


def test_punctuation_spacing(spark):
    assert apply(spark, cleaning.punctuation_spacing, "a,b A,b 1.0 end.Next U.S.A x;y") == ["a, b A,b 1.0 end. Next U.S.A x; y"]


def test_code_prose_split(spark):
    line = "Circle[] arr = new Circle[10]; f(x = 1); An array of objects is a list of values"
    [found] = apply(spark, cleaning.code_prose_split, line)
    assert (found[0].code, found[0].prose) == ("Circle[] arr = new Circle[10]; f(x = 1);", "An array of objects is a list of values")


def test_code_prose_split_of_a_very_long_line(spark):
    """Every position of the line was once tried as the cut, each found from the line's start."""
    line = "f(xy = 1);  The rest " + "word; " * 100_000
    started = time.time()
    [found, none] = apply(spark, cleaning.code_prose_split, line, "f(xy = 1)" + "x" * 500 + "; The rest " + "word " * 9)
    assert [(x.code, x.prose) for x in found] == [("f(xy = 1);", line[12:-1])] and none == []
    assert time.time() - started < 20


def test_final_answer(spark):
    cases = {
        '{"final_answer": " yes "}': "yes", '```json\n{"title": "t"}\n```': "t", "so: [1, [2]] end": "[1, [2]]",
        "<think>a</think> <FINAL_ANSWER>long answer</FINAL_ANSWER>": "long answer",
        "===START=== a ===END=== ===START=== the longer one ===END===": "the longer one",
        "talk Final Answer: it is seven": "it is seven", "plain text": "plain text",
        "Wait, so\nActually, no\nThe real answer stands in this line": "The real answer stands in this line",
    }
    assert apply(spark, R.final_answer, *cases) == list(cases.values())


def test_json_recover(spark):
    cases = {'so {x} {"a": "} {", "b": ["\\"]"]} ok': '{"a": "} {", "b": ["\\"]"]}', '[1] {bad} ': "[1]", 'x \\{"k": [1, 2]}': '{"k": [1, 2]}',
             '{"a": 1}': '{"a": 1}', 'x {"a": {"b": 2}} y': '{"a": {"b": 2}}', "see [bad and [1]": "[1]", "none": None,
             "t\n```json\n[3]\n```": "[3]"}
    assert apply(spark, R.json_recover, *cases) == list(cases.values())


def test_no_line_of_a_text_is_lost(spark):
    """Each fixture made of the documents holds their lines, up to what its marks do to single characters."""
    from scholia.plans import cleaning as P
    from scholia.sources.tables import Tables
    from tests.conftest import SF
    t = Tables(spark, SF)
    plain = lambda c: F.regexp_replace(F.replace(c, F.lit("ð"), F.lit("o")), r"[\s|]+", " ")
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim(plain(F.col("line"))).alias("line")).filter("line <> ''").distinct()
    for made in (P.prompted(t), P.noisy(t), P.code_lines(t)):
        whole = made.select("doc_id", plain(F.col("text")).alias("made"))
        assert lines.join(whole, "doc_id").filter(~F.contains("made", "line")).isEmpty()


def test_long_lines_pass(spark):
    """A line of 100,000 characters without a break that patterns wait for."""
    long = "Word " + "abcd " * 20_000
    for fn in (R.validate_markdown, R.slide_headings, R.duplicate_fences, R.table_overlap, R.final_answer, R.json_recover, R.segments):
        assert len(apply(spark, fn, long)) == 1
    for text in (long, "A" * 100_000, "1." * 50_000, "| - " * 25_000, "[" * 50_000 + "]" * 50_000, '{"' * 50_000):
        assert len(apply(spark, R.json_recover, text)) == 1 and len(apply(spark, R.validate_markdown, text)) == 1
    rows = [(i, [(0, 1, 0.0, "body", x, 11.0, 0), (1, 1, 1.0, "body", "then it goes on", 11.0, 0)]) for i, x in enumerate((long, "1." * 50_000, "A" * 100_000))]
    docs = spark.createDataFrame(rows, f"doc_id int, blocks array<{B.BLOCK}>")
    assert B.to_markdown(B.clean_pipeline(docs)).count() == 3


def test_folds_are_linear(spark):
    """Four times the blocks take about four times as long: lists that grow are not copied at every step."""
    import time
    took = []
    for n in (4_000, 16_000):
        rows = [(0, [(i, 1, float(i), "body" if i % 3000 < 1500 else "list", f"some words that go on {i} and", 11.0, 0) for i in range(n)])]
        docs = spark.createDataFrame(rows, f"doc_id int, blocks array<{B.BLOCK}>")
        for step in (B.merge_continuations, B.redundant_metadata):
            step(docs).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        for step in (B.merge_continuations, B.redundant_metadata):
            step(docs).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0]


def test_merged_blocks(spark):
    """Hyphens, parentheses over several blocks, and words beyond the reach of a fold."""
    make = lambda *b: spark.createDataFrame([(0, [(i, 1, float(i), k, x, 11.0, 0) for i, (k, x) in enumerate(b)])], f"doc_id int, blocks array<{B.BLOCK}>")
    texts = lambda df: [b.text for b in df.first().blocks]
    tail = "x " * 3000
    assert texts(B.merge_continuations(make(("body", "The exam-"), ("body", "ple goes"), ("body", "on. "), ("body", "Next one."), ("h2", "head")))) == [
        "The example goes on. ", "Next one.", "head"]
    assert texts(B.merge_continuations(make(("body", tail + "and"), ("body", "Then " + tail), ("body", "last.")))) == [f"{tail}and Then {tail} last."]
    assert texts(B.list_wrapping(make(("list", "one (two"), ("list", "Three"), ("list", "Four)"), ("list", "Five")))) == ["one (two Three Four)", "Five"]


# -- blocks -------------------------------------------------------------------------------------


def blocks(spark, *items):
    rows = [(i, 1, float(i), kind, text, 11.0, 0) for i, (kind, text) in enumerate(items)]
    return spark.createDataFrame([(1, rows)], f"doc_id long, blocks array<{B.BLOCK}>")


def shown(docs_):
    return [(r.type, r.text) for r in B.rows(docs_).orderBy("seq").collect()]


def test_heading_survivors_equal_a_plain_loop():
    """Every heading against all that still stand."""
    def plain(lines):
        stays, live, placed = [True] * len(lines), {}, {}
        for i, line in enumerate(lines):
            full = line.split(" (cont")[0].strip()
            bare = full.lstrip("0123456789.").strip()
            if full in live:
                stays[i] = False
                continue
            for other, known in list(live.items()):
                same = bare == known or (len(bare) > 10 and (bare in known or known in bare))
                if min(len(bare), len(known)) < 4 or not same:
                    continue
                if len(full) < len(other):
                    stays[i] = False
                    break
                del live[other]
                for j in placed.get(other, []):
                    stays[j] = False
            if stays[i]:
                live[full] = bare
                placed.setdefault(line.strip(), []).append(i)
        return stays

    rng = random.Random(11)
    lost = 0
    for _ in range(300):
        lines = []
        for _ in range(rng.randint(0, 25)):
            words = " ".join(rng.choice(["tree", "trees", "a", "sort", "of", "heap", "balanced tree"]) for _ in range(rng.randint(0, 4)))
            lines.append(rng.choice(["", "", "1.2 ", "3 "]) + words + rng.choice(["", "", " (cont.)", " (continued) x"]))
        got = B.heading_survivors(["h2"] * len(lines), lines)
        assert got == plain(lines)
        lost += got.count(False)
    assert lost > 300


def test_many_headings_take_linear_time():
    def took(n):
        lines = [f"{i} chapter on subject {i * 7919 % 100003:06d}" for i in range(n)]
        start = time.process_time()
        assert all(B.heading_survivors(["h1"] * n, lines))
        return time.process_time() - start
    took(500)
    assert took(16_000) < 12 * took(4_000)


def test_fuzzy_headings(spark):
    """The continuation is shorter than the numbered heading and goes; the longest heading holds that one's words and takes its place; the last is part of it."""
    d = blocks(spark, ("h1", "1.1 Networks"), ("body", "x"), ("h2", "Networks (cont.)"), ("h2", "Networks and protocols"), ("h3", "Networks and"))
    assert shown(B.fuzzy_heading_dedup(d)) == [("body", "x"), ("h2", "Networks and protocols")]


def test_merge_continuations(spark):
    d = blocks(spark, ("body", "This ends with the"), ("body", "Next word here now."), ("body", "and so on"), ("list", "An item that goes on and"), ("body", "on"),
               ("h2", "head"), ("body", "some-"), ("body", "thing"))
    assert shown(B.merge_continuations(d)) == [("body", "This ends with the Next word here now. and so on"), ("list", "An item that goes on and on"),
                                               ("h2", "head"), ("body", "something")]


def test_list_wrapping(spark):
    long = "This is a long list item that does not end in a stop but"
    d = blocks(spark, ("list", long), ("body", "goes on."), ("list", "Devices of many kinds here (such as phones,"),
               ("list", "Tablets and many other quite different things)."), ("list", "A"), ("list", "b"))
    assert shown(B.list_wrapping(d)) == [
        ("list", long + " goes on."), ("list", "Devices of many kinds here (such as phones, Tablets and many other quite different things)."), ("list", "A"), ("list", "b")]


def test_heading_jumps(spark):
    d = blocks(spark, ("h1", "aaa"), ("h4", "bbb"), ("h4", "ccc"), ("h1", "ddd"), ("h1", "DDD"), ("h5", "eee"))
    assert [t for t, _ in shown(B.heading_jumps(d))] == ["h1", "h2", "h3", "h2", "h2"]
    assert [t for t, _ in shown(B.heading_jumps(blocks(spark, ("body", "x"), ("h3", "aaa"), ("h5", "bbb"))))] == ["body", "h1", "h4"]


def test_redundant_metadata(spark):
    d = blocks(spark, ("h1", "Nets"), ("body", "Module Title: Nets Module Objective: Learn"), ("body", "Module Objective: See"), ("body", "Nets"),
               ("h2", "Module 1 Intro"), ("h2", "Module 1 - Terms"), ("h2", "Module 2"))
    assert shown(B.redundant_metadata(d)) == [("h1", "Nets"), ("body", "**Objective:** Learn"), ("body", "**Objective:** See"), ("h2", "Module 1 Intro"), ("h3", "Terms")]


def test_to_markdown(spark):
    d = blocks(spark, ("h1", "T (cont.)"), ("body", "Term: a < b"), ("list", "• x"), ("list", "2. y"), ("code", "if a<b"), ("caption", "c"), ("skip", "no"))
    [r] = B.to_markdown(d).collect()
    assert r.markdown == "<!-- Page 1 -->\n\n# T\n\n**Term:** a &lt; b\n- x\n- y\n\n```\nif a<b\n```\n\n*c*\n"


def test_passes_are_stable(spark):
    d = blocks(spark, ("h1", "A title here"), ("list", "one"), ("body", "two three"), ("list", "four"), ("h2", "A title here"))
    once = B.exact_dedup(d)
    assert shown(B.exact_dedup(once)) == shown(once)


def test_slide_filter(spark):
    b = lambda kind, text: (0, 1, 0.0, kind, text, 11.0, 0)
    slides = [(1, "Start", [b("h1", "Start")]), (2, "Summary", [b("body", "s")]), (3, "Loops", [b("h1", "Loops"), b("body", "l")]),
              (4, "Loops (cont.)", [b("h1", "Loops (cont.)"), b("body", "more")]), (5, "Trace", [b("body", "assign value"), b("body", "keep this text")])]
    df = spark.createDataFrame([(1, slides)], f"doc_id long, slides array<struct<page:int,title:string,blocks:array<{B.BLOCK}>>>")
    assert [t for _, t in shown(B.slide_filter(df))] == ["Start", "Loops", "l", "more", "keep this text"]


def test_image_place(spark):
    d = docs(spark, "<!-- Page 1 -->\nsee figure 1\nx\n<!-- Page 2 -->\ny")
    im = spark.createDataFrame([(0, 1, 1, "A"), (0, 2, 1, "B"), (0, 3, 2, "C"), (0, 4, 9, "D")], "doc_id long, image_id long, page int, ref string")
    got = images.image_place(d, im).orderBy("pos", "page", "rank").collect()
    assert [r.markdown for r in got] == ["<!-- Page 1 -->", "see figure 1", "A", "x", "B", "<!-- Page 2 -->", "y", "C", "D"]


# -- layout -------------------------------------------------------------------------------------

SPAN = "span_no:int,text:string,font_name:string,font_size:double,is_bold:boolean,is_italic:boolean,x0:double,x1:double,top:double,bottom:double"


def page(spark, *spans):
    rows = [(i, t, "Arial", size, False, False, x0, x0 + 5.0 * len(t), top, top + size) for i, (t, size, x0, top) in enumerate(spans)]
    return spark.createDataFrame([(1, 1, 600.0, 800.0, rows)], f"doc_id long, page int, width double, height double, spans array<struct<{SPAN}>>")


def test_lines_and_blocks(spark):
    p = page(spark, ("world", 11.0, 90.0, 100.0), ("hello", 11.0, 50.0, 100.0), ("next", 11.0, 50.0, 113.0), ("far", 11.0, 50.0, 200.0), ("• item", 11.0, 90.0, 213.0), ("12", 11.0, 50.0, 790.0))
    lines = layout.spans_to_lines(p)
    assert [x.text for x in lines.collect()[0].lines] == ["hello world", "next", "far", "• item", "12"]
    kept = layout.drop_headers_footers(lines)
    got = [(r.text, r.indent) for r in layout.lines_to_blocks(kept).orderBy("block_no").collect()]
    assert got == [("hello world next", 0), ("far", 0), ("• item", 2)]


def test_keyword_relevance_against_a_plain_loop(spark):
    """Title hits, dense bodies and adjacent pairs, with repeated words; a pair's words are not looked for one by one."""
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) for _ in range(n))
    queries, items = [(i, text(rng.randint(1, 6))) for i in range(12)], [(i, text(rng.randint(0, 2)), text(rng.choice((0, 1, 3, 30)))) for i in range(40)]
    got = retrieval.keyword_relevance(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(items, "item_id long, title string, body string"), k=100)
    want = {}
    for q, query in queries:
        qw = query.split()
        for i, title, body in items:
            bw = body.split()
            hit, dense = sum(w in title for w in qw) / len(qw) * 60, min(sum(w in qw for w in bw) / max(len(bw), 1) * 150, 100) * 0.35
            raw = round(hit + dense + min(15 * sum(f"{a} {b}" in body or f"{a} {b}" in title for a, b in zip(qw, qw[1:])), 100) * 0.25, 9)
            if raw >= 50:
                want[q, i] = round(min(raw, 100.0), 1)
    rows = got.collect()
    assert want and {(r.query_id, r.item_id): r.score for r in rows} == pytest.approx(want) and len(rows) == len(want)
    assert "array_contains(qw" not in got._jdf.queryExecution().optimizedPlan().toString()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_number_ranges_across_longs(spark):
    """Runs that begin, end or go on where 64 numbers are full; one shuffle of the numbers."""
    sets = {"a": [*range(-70, 200), 202], "b": [63, 64, 128, 191, 192], "c": [None], "d": [None, 2**63 - 1, -2**63], "e": [*range(64, 128)], None: [1, 2]}
    numbers = spark.createDataFrame([(k, n) for k, ns in sets.items() for n in ns for _ in (0, 1)], "key string, n long")
    got = reports.number_ranges(numbers, "key", "n")
    assert {r.key: r.ranges for r in got.collect()} == {"a": "-70-199 & 202", "b": "63-64, 128, 191-192", "c": "",
                                                        "d": "-9223372036854775808 & 9223372036854775807", "e": "64-127", None: "1-2"}
    assert "LeftAnti" not in got._jdf.queryExecution().executedPlan().toString()


def test_cascade_delete_goes_by_the_parent(spark):
    """A row goes with its parent; another row of the same key and another parent stays, as does one without a parent."""
    top = spark.createDataFrame([(1,), (2,)], "g long")
    mid = spark.createDataFrame([(10, 1), (10, 2), (11, 2), (12, None)], "m long, g long")
    low = spark.createDataFrame([("x", 10), ("x", 11), ("y", 12), ("z", 11), (None, 10)], "l string, m long")
    kept = writers.cascade_delete([(top, "g", None), (mid, "m", "g"), (low, "l", "m")], top.filter("g = 1"))
    assert [sorted(map(tuple, k.collect()), key=str) for k in kept] == [[(2,)], [(10, 2), (11, 2), (12, None)], [("x", 11), ("y", 12), ("z", 11)]]


def test_owner_of_entities_counts_notes_once(spark):
    """Repeated notes count once, repeated resources as often as they are there, and entities are shuffled once."""
    entities = spark.createDataFrame([("nt_1",), ("nt_2",), ("nt_2",), ("nt_3",), ("rs_7",), ("zz",), (None,)], "entity_id string")
    notes = spark.createDataFrame([("nt_1", 7, 5), ("nt_1", 7, 5), ("nt_2", 8, 5), ("nt_2", 9, 6), ("nt_3", None, None)], "note_id string, resource_id long, user_id long")
    resources = spark.createDataFrame([(7, 1), (7, 1), (7, 2), (8, None)], "resource_id long, user_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.owner_of_entities(entities, notes, resources)
        assert exchanges(got) <= 5
        rows = sorted(map(tuple, got.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == sorted([("nt_1", "1"), ("nt_1", "1"), ("nt_1", "2"), *[("nt_2", "5"), ("nt_2", "6")] * 2, ("nt_3", "unowned"),
                           ("rs_7", "1"), ("rs_7", "1"), ("rs_7", "2"), ("zz", "unowned"), (None, "unowned")], key=str)


def test_set_difference_of_word_sets(spark):
    """Keys of one row a side are settled in the row; repeated ones and null ones by item. Whole sets are not shuffled item by item."""
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"]), (2, ["y", "x"]), (3, []), (4, None), (None, ["n"]), (None, ["n", "m"]), (6, ["z"])], "k long, i array<string>")
    b = spark.createDataFrame([(1, ["y", "w"]), (2, ["y"]), (3, ["q"]), (5, ["r"]), (None, ["n"]), (6, ["z"]), (6, ["z", "u"])], "k long, i array<string>")
    got = ranking.difference(a, b, "k", "i", "word")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        (1, "w", "missing"), (3, "q", "missing"), (5, "r", "missing"), (6, "u", "missing"), (None, "n", "missing"),
        (1, "x", "extra"), (2, "x", "extra"), (None, "n", "extra"), (None, "m", "extra")], key=str)


def test_one_key_with_a_million_runs(spark):
    odd = spark.range(1_000_000).select(F.lit("k").alias("key"), (F.col("id") * 2 + 1).alias("n"))
    few = spark.createDataFrame([("m", n) for n in (3, 1, 2, 2, 7)], "key string, n long")
    got = reports.number_ranges(odd.unionByName(few), "key", "n").select("key", F.substring("ranges", 1, 10).alias("head"), F.length("ranges").alias("n"),
                                                                        F.substring_index("ranges", ", ", -1).alias("tail"))
    size = sum(len(str(2 * i + 1)) + 2 for i in range(1_000_000)) - 2
    assert {tuple(r) for r in got.collect()} == {("k", "1, 3, 5, 7", size, "1999999"), ("m", "1-3 & 7", 7, "1-3 & 7")}


def test_columns(spark):
    spans = [(w, 11.0, x, 100.0 + 16 * i) for i in range(4) for x, w in ((50.0, "left side text here"), (320.0, "right side text here"))]
    got = layout.columns(page(spark, *spans)).orderBy("span_no").collect()
    assert [r.column_no for r in got] == [0, 1] * 4
    assert {r.column_no for r in layout.columns(page(spark, *spans[:4])).collect()} == {0}


def test_font_hierarchy(spark):
    p = page(spark, ("body text that is long", 11.0, 50.0, 100.0), ("T", 24.0, 50.0, 50.0), ("S", 18.0, 50.0, 70.0), ("s", 11.3, 50.0, 90.0))
    got = {r.font_size: (r.level, r.is_body) for r in layout.font_hierarchy(p).collect()}
    assert got == {11.0: (None, True), 24.0: ("h1", False), 18.0: ("h2", False), 11.3: (None, False)}


def test_point_in_box(spark):
    b = spark.createDataFrame([(1, 1, 0, 10.0, 20.0, 10.0, 20.0)], "doc_id long, page int, block_no int, x0 double, x1 double, top double, bottom double")
    boxes = spark.createDataFrame([(1, 1, 0, "big", 0.0, 0.0, 500.0, 500.0, 0.9), (1, 1, 1, "small", 0.0, 0.0, 40.0, 40.0, 0.5), (1, 1, 2, "same", 0.0, 0.0, 40.0, 40.0, 0.5)],
                                  "doc_id long, page int, box_no int, label string, bx0 double, by0 double, bx1 double, by1 double, conf double")
    assert [r.label for r in layout.point_in_box(b, boxes).collect()] == ["small"]


# -- questions and quality ------------------------------------------------------------------------


def test_extract_pairs(spark):
    got = questions.extract_pairs(docs(spark, "# Question 1\nWhat is it?\n## Jawapan / Answer\nA thing\nof sorts", "Intro\nWhy _____?\n\nAnswer: because\nof x\n\nrest\nWho?", "nothing")).orderBy("doc_id", "n").collect()
    assert [(r.doc_id, r.question_text, r.answer_text, r.question_type) for r in got] == [
        (0, "What is it?", "A thing of sorts", "subjective"), (1, "Why _____?", "because of x", "fill_in_the_blank"),
        (1, "Who?", questions.NO_ANSWER, "subjective")]


def test_normalize_structure(spark):
    q = '{"id": "7", "question_text": "q", "sub_parts": [{"max_marks": 2}, {"label": "z", "sub_parts": [{"max_marks": 3}, {}]}]}'
    df = spark.createDataFrame([("s", 0, q)], "set_id string, q_no int, question_json string")
    [r] = questions.normalize_structure(df).collect()
    assert r.question.max_marks == 6
    assert [(p.id, p.max_marks) for p in r.question.sub_parts] == [("7a", 2), ("7z", 4)]
    assert [p.id for p in r.question.sub_parts[1].sub_parts] == ["7za", "7zb"]
    assert r.question.marking_scheme[0].criterion == "Overall correctness" and r.question.marking_scheme[0].max_points == 6


def test_heading_diff(spark):
    a, b = docs(spark, "# A\n### B\n#### C\n##### E"), docs(spark, "# A\n## B")
    got = sorted((r.diff_type, r.level, r.text) for r in quality.heading_diff(a, b).collect())
    assert got == [("extra_heading", 3, "B"), ("extra_heading", 4, "C"), ("extra_heading", 5, "E"), ("hierarchy_jump", 3, "B"), ("missing_heading", 2, "B")]


def test_similarity(spark):
    a, b = "x\ny\nz", "x\nz\nw"
    d = docs(spark, a, b)
    [r] = quality.similarity(quality.leader_pairs(d), d).collect()
    assert r.ratio == round(difflib.SequenceMatcher(None, a.split("\n"), b.split("\n")).ratio(), 6)


# -- vectors --------------------------------------------------------------------------------------


def test_encoder():
    v = V.hashing_encoder(["one two", "two one", ""])
    assert (v[0] == v[1]).all() and abs((v[0] ** 2).sum() - 1) < 1e-12 and not v[2].any()


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_topk_blocks_is_exact(spark, block):
    rng = random.Random(5)
    rows = [(i, i % 2, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(23)]
    q = spark.createDataFrame(rows, "query_id long, g int, embedding array<float>")
    items = q.withColumnRenamed("query_id", "item")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) ** .5) * (sum(y * y for y in b) ** .5) + 1e-9) * 100, 1)
    want = {(i, j) for i, g, v in rows for j in [j for _, j in sorted((-cos(v, w), j) for j, h, w in rows if h == g)[:3]]}
    got = {(r.query_id, r.item) for r in V.topk_blocks(q, items, 3, ["item"], group="g", block=block).collect()}
    assert got == want


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(V.cosine_zero(F.col("a"), F.col("b")), V.cosine_raw(F.col("a"), F.col("b")), V.cosine_percent(F.col("a"), F.col("b"))).collect()
    assert abs(got[0][0] - 0.5 ** 0.5) < 1e-12 and got[1][0] == 0.0 and got[1][1] is None and got[0][2] == 70.7


def test_search_labels_first_copy(spark):
    d = docs(spark, "other words", "same text here", "same text here")
    q = spark.createDataFrame([(1, "same text here")], "query_id long, query string")
    got = retrieval.search_texts(d, q, k=2).orderBy("rank").collect()
    assert [r.resource_id for r in got] == [1, 1] and got[0].score == 1.0


def test_similar_documents(spark):
    d = docs(spark, "a b c", "a b c d", "x y", "a b").withColumn("owner", F.when(F.col("doc_id") == 3, "p").otherwise("o"))
    got = retrieval.similar_documents(d, k=1).collect()
    assert {(r.doc_id, r.similar_id) for r in got if r.doc_id < 2} == {(0, 1), (1, 0)} and all(r.similar_id != r.doc_id for r in got)


def test_pack_edges(spark):
    hits = spark.createDataFrame([("q", 1, "a" * 10), ("q", 2, "b" * 8), ("q", 3, "c"), ("r", 1, "d" * 30)], "query_id string, rank int, text string")
    got = {r.query_id: r.context for r in retrieval.pack_snippets(hits, 20).collect()}
    assert got == {"q": "a" * 10 + "\n\n" + "b" * 8, "r": ""}  # where nothing fits the context is empty


def test_cite(spark):
    df = spark.createDataFrame([("r", "Cats chase small mice. Dogs bark loudly! | a b |", ["dogs bark loudly", "cats chase mice", "zzz yyy"])],
                               "response_id string, response string, sources array<string>")
    assert retrieval.cite_sentences(df).collect()[0].cited_text == "Cats chase small mice [2]. Dogs bark loudly [1]! | a b |"


# -- order and state ------------------------------------------------------------------------------


def test_add_rank_on_a_hot_key(spark):
    rows = [(1 if i % 3 else i, (i * 7) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = ordered.add_rank(df, ["k"], [F.col("v")], partitions=7).collect()
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    assert all(sorted(by[r.k])[r.position - 1] == r.v for r in got) and len(got) == 1000


def test_containing_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    short = ["", "a", "ab", "aba", "é", None, "abab", "never in it"] + [word(n) for n in (4, 5, 6, 7, 7, 9)]
    long = ["", "a", None, "éa", "abab", "b" * 3000] + [word(n) for n in (3, 8, 20, 20, 40, 60)] + ["abab" * 20] * 2
    a = spark.createDataFrame(list(enumerate(short)), "i int, s string")
    b = spark.createDataFrame(list(enumerate(long)), "j int, l string")
    got = {(r.i, r.j) for r in ranking.containing(a, "s", b, "l").collect()}
    assert got == {(i, j) for i, s in enumerate(short) for j, l in enumerate(long) if s is not None and l is not None and s in l}
    assert ranking.containing(a.limit(0), "s", b, "l").isEmpty() and ranking.containing(a, "s", b.limit(0), "l").isEmpty()


def test_title_matches_first_wins(spark):
    res = spark.createDataFrame([("Set", 5), ("Sets", 6), ("Set", 9)], "title string, resource_id long")
    cited = spark.createDataFrame([("Sets",), ("sets theory",), ("et",), ("none",)], "cited string")
    assert {r.cited: r.resource_id for r in ranking.title_matches(cited, res).collect()} == {"Sets": 6, "sets theory": 9, "et": 9}


def test_lockout_rules():
    from scholia.streaming.lockout import step
    state, seen = (0, 0.0), []
    for now, ok in [(0, False)] * 5 + [(10, True), (1801, False), (1802, True), (3700, True)]:
        f, l, refused = step(*state, now, ok, False, False, 5, 1800.0)
        state = (f, l)
        seen.append((refused, f))
    assert seen == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (True, 5), (False, 6), (True, 6), (False, 0)]
    # What the other scope refuses counts for nothing; the scope that is asked second has no say then.
    assert step(4, 0.0, 1, False, True, True, 5, 9.0) == (4, 0.0, False)
    assert step(5, 9.0, 1, True, True, False, 5, 9.0) == (5, 9.0, False) and step(5, 9.0, 1, True, True, True, 5, 9.0) == (5, 9.0, True)


def replay(attempts, user_max, ip_max, seconds):
    """One after the other, with all counts and locks."""
    count, lock, out = {}, {}, {}
    for i, ts, user, ip, ok in attempts:
        scopes = [(k, v, most) for k, v, most in (("ip", ip, ip_max), ("user", user, user_max)) if v is not None]
        refused = next((k for k, v, _ in scopes if lock.get((k, v), 0) > ts), None)
        out[i] = f"{refused}_locked" if refused else "success" if ok else "failure"
        for k, v, most in scopes if not refused else []:
            count[k, v] = 0 if ok else count.get((k, v), 0) + 1
            if ok or count[k, v] >= most:
                lock[k, v] = 0 if ok else ts + seconds
    return out


def test_lockout_equals_a_replay(spark):
    """Many accounts behind few addresses: verdicts hang on each other over many rounds."""
    import datetime
    import random
    from scholia.session import cut_lineage
    from scholia.streaming.lockout import ATTEMPT, lockout_batch
    rng = random.Random(4)
    own = [(i, t, rng.choice([None, *range(12)]), rng.choice([None, "a", "b", "c", "d"]), rng.random() < 0.12) for i, t in enumerate(sorted(rng.randint(0, 30_000) for _ in range(1500)))]
    rows = [(i, datetime.datetime.fromtimestamp(10**9 + t), u, ip, ok) for i, t, u, ip, ok in own]
    got = lockout_batch(spark.createDataFrame(rows, ATTEMPT).repartition(7), cut_lineage, user_max=3, ip_max=5, minutes=20).collect()
    want = replay(own, 3, 5, 1200)
    assert {r.event_id: r.outcome for r in got} == want and set(want.values()) == {"ip_locked", "user_locked", "success", "failure"}


def test_rejected_requests_do_not_count():
    recent, flags = [], []
    for now in (0, 1, 2, 3, 60, 61):
        recent, ok = S.admit(recent, now, 2, 60)
        flags.append(ok)
    assert flags == [True, True, False, False, True, True]


def ten_files(spark, folder, mixed):
    """The events as ten files in the order of arrival, updates up to 20 hours late if ``mixed``; and as a feed that reads one file a batch."""
    import os
    import scholia.plans.load  # noqa: F401
    from scholia.streaming.run import Feed
    from tests.conftest import SF
    events = spark.read.parquet(f"{SF}/events.parquet")
    delay = F.pmod(F.xxhash64("event_id"), F.lit(72_000)) if mixed else F.lit(0)
    arrived = events.withColumn("file", F.ntile(10).over(Window.orderBy(F.unix_timestamp(F.col("ts").cast("timestamp")) + delay, "event_id")))
    for i in range(1, 11):
        part = folder / f"f{i:02d}.parquet"
        arrived.filter(F.col("file") == i).drop("file").coalesce(1).write.parquet(str(folder / f"d{i}"))
        next((folder / f"d{i}").glob("*.parquet")).rename(part)
        os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/f*.parquet")
    return Feed(spark, SF, files=live)


@pytest.mark.parametrize("mixed", [False, True])
def test_rate_limit_over_many_batches(spark, tmp_path, mixed):
    from scholia.plans.streams import policy, requests
    from scholia.streaming.run import drain
    feed = ten_files(spark, tmp_path, mixed)
    out = drain(S.rate_limit(requests(feed.stream), policy(spark)), "append", "limit-test", feed=feed)
    last = feed.table.agg(F.max("ts")).first()[0]
    stream = sorted((r.event_id, r.accepted) for r in out.filter(F.col("ts").cast("timestamp_ntz") <= F.lit(last)).collect())
    batch = S.rate_limit_batch(requests(feed.table.withColumn("ts", F.col("ts").cast("timestamp"))), policy(spark))
    assert stream == sorted((r.event_id, r.accepted) for r in batch.collect()) and len({a for _, a in stream}) == 2


def test_limiter_forgets_idle_keys():
    """Nothing is left of a key once its requests have left the window."""
    from pyspark.sql import Row
    class Value:
        def __init__(self): self.v = None
        def get(self): return self.v
        def update(self, v): self.v = v
        def clear(self): self.v = None
    class Many(Value):
        def get(self): return iter(self.v or [])
        def put(self, v): self.v = list(v)
        def appendList(self, v): self.v = (self.v or []) + list(v)
    class Handle:
        def __init__(self): self.timers, self.states = set(), []
        def getValueState(self, *a): self.states.append(Value()); return self.states[-1]
        def getListState(self, *a): self.states.append(Many()); return self.states[-1]
        def registerTimer(self, ms): self.timers.add(ms)
        def deleteTimer(self, ms): self.timers.discard(ms)
    class Clock:
        def __init__(self, s): self.s = s
        def getCurrentWatermarkInMs(self): return self.s * 1000
    import datetime
    h, limiter = Handle(), S.RateLimiter()
    limiter.init(h)
    at = datetime.datetime.fromtimestamp
    limiter.handleInputRows(("k",), iter([Row(ts=at(50), event_id=2, most=1, window=10.0), Row(ts=at(45), event_id=1, most=1, window=10.0), Row(ts=at(70), event_id=3, most=1, window=10.0)]), None)
    seen = []
    for watermark in (40, 55, 100, 200):
        for ms in sorted(t for t in h.timers if t <= watermark * 1000):
            h.timers.discard(ms)
            seen += [(r.event_id, r.accepted) for r in limiter.handleExpiredTimer(("k",), Clock(watermark), None)]
    assert seen == [(1, True), (2, False), (3, True)] and not h.timers and all(s.v is None for s in h.states)


@pytest.mark.parametrize("mixed", [False, True])
def test_lockout_over_many_batches(spark, tmp_path, mixed):
    from scholia.plans.streams import MINUTES, attempts
    from scholia.streaming.lockout import LockoutTable
    from scholia.streaming.run import drain
    feed = ten_files(spark, tmp_path, mixed)
    table = LockoutTable(spark, str(tmp_path / "lockout"), buckets=4, minutes=MINUTES)
    drain(attempts(feed.stream), "append", "lockout-test", each=table.apply, feed=feed)
    own = attempts(feed.table).orderBy("ts", "event_id").collect()
    want = replay([(r.event_id, r.ts.timestamp(), r.user, r.ip, r.ok) for r in own], 5, 10, MINUTES * 60)
    assert {r.event_id: r.outcome for r in table.read(spark).collect()} == want


@pytest.mark.parametrize("name", ["str_rate_offered", "str_request_metrics", "str_study_daily", "str_active_sessions", "str_task_latest"])
def test_windows_over_many_batches(spark, con, tmp_path, name, monkeypatch):
    """Ten files give what one gives."""
    import scholia.plans.load  # noqa: F401
    from scholia.plans import streams
    from scholia.plans.registry import ORACLES, QUERIES
    from tests.compare import compare
    from tests.conftest import SF
    feed = ten_files(spark, tmp_path, True)
    monkeypatch.setattr(streams, "Feed", lambda *a: feed)
    monkeypatch.setattr(streams, "stream_table", lambda *a: spark.readStream.schema(feed.table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/f*.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp")))
    assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) == ""


def test_jdbc_reads_in_ranges(spark):
    from scholia.sources.readers import jdbc
    url, options = "jdbc:derby:memory:scholia;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.range(100).select(F.col("id").cast("int").alias("ID"), (F.col("id") * 2).cast("int").alias("V"))
    df.write.jdbc(url, "numbers", mode="overwrite", properties=options)
    back = jdbc(spark, url, "numbers", "ID", 0, 100, 4, **options)
    assert back.rdd.getNumPartitions() == 4
    assert back.filter("ID < 10").agg(F.sum("V")).collect()[0][0] == 90


def test_digests_of_long_files(spark, tmp_path, monkeypatch):
    """Files longer than one value may be are hashed in turns, over several tasks, whatever their bytes."""
    import hashlib
    import random

    import pyarrow as pa

    from scholia.sources import readers as R
    rng, mark = random.Random(3), b"\xef\xbb\xbf"
    many = [rng.randbytes(rng.randint(2000, 9000)) for _ in range(3)]
    made = {"a b%20+c.bin": many[0], "[d]{e}.bin": many[1] + b"\n", "mark.bin": mark + many[2], "mark_end.bin": mark + mark + many[2] + b"\r\n", "zeros.bin": bytes(3000), "ends.bin": b"\n" * 3001,
            "one.bin": b"\n" + b"x" * 3000, "text.bin": b"a\r\nb\n\n" * 700, "short.bin": b"short\n", "other.txt": many[0], "t.gz.bin": many[0]}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(R, "WHOLE", 1000)
    monkeypatch.setattr(R, "TURN", 1500)
    conf = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.sources.binaryFile.maxLength": "1000"}
    old = {k: spark.conf.get(k) for k in conf}
    rows = spark.conf.get(R.ARROW_ROWS)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.path: r.md5 for r in R.file_digests(spark, str(tmp_path), "*.bin").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {n: hashlib.md5(d).hexdigest() for n, d in made.items() if n.endswith(".bin")}
    assert spark.conf.get(R.ARROW_ROWS) == rows
    monkeypatch.setattr(R, "RUN", 4)  # long lines are stored in parts
    batch = lambda *lines: pa.RecordBatch.from_pylist([{"file": "f", "block": 0, "value": v} for v in lines])
    runs = [b.to_pylist()[0] for b in R.line_runs(iter([batch(b"abcdefg", b""), batch(b"hi")]))]
    assert [(r["no"], r["size"], r["bytes"]) for r in runs] == [(0, 4, b"abcd"), (1, 4, b"efg\n"), (2, 1, b"\n"), (3, 3, b"hi\n")]


def test_replacement_over_batches(spark, tmp_path):
    """Changed, blanked, replayed and blank-only batches."""
    from scholia.sources.writers import create_buckets, read_buckets
    from scholia.streaming import windows as W
    path = str(tmp_path / "chunks")
    create_buckets(spark, path, W.CHUNKS)
    apply = W.embed_changes(path)
    now = lambda: {r.resource_id: r.text for r in read_buckets(spark, path, W.CHUNKS).collect()}
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id bigint, text string, version int")
    apply(rows((1, "one", 1), (2, "two", 1), (2, "two again", 2)), 0)
    assert now() == {1: "one", 2: "two again"}
    for _ in range(2):
        apply(rows((1, "  ", 2), (3, "three", 1)), 1)
        assert now() == {2: "two again", 3: "three"}
    apply(rows((2, None, 3), (3, "", 2)), 2)
    assert now() == {}
    apply(rows((1, "back", 3)), 3)
    assert now() == {1: "back"}


def test_means_keep_their_decimals(spark):
    from scholia.operators import reports
    rows = spark.createDataFrame([(1, 0.9444, None, 1, 0)] * 3, "run_id int, score double, error string, images int, warnings int")
    got = reports.report_summary(rows).first()
    assert got.avg_score == got.max_score == 0.9444


def test_snippets_are_packed_with_empty_ones(spark):
    rows = [(1, i + 1, "") for i in range(8)] + [(1, 9, "abc"), (2, 1, "ab"), (2, 2, ""), (2, 3, "c"), (2, 4, "d"), (3, 1, "x" * 20)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, text string")
    got = {r.query_id: r.context for r in retrieval.pack_snippets(hits, 10).collect()}
    assert got == {1: "abc", 2: "ab\n\n\n\nc\n\nd", 3: ""}


def test_marked_texts_keep_every_line(spark):
    from scholia.sources.tables import Tables
    from tests.conftest import SF
    t = Tables(spark, SF)
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''").distinct()
    for name in ("markdown", "slides", "scans"):
        made = getattr(t, name).select("doc_id", F.col("text").alias("made"))
        lost = lines.join(made, "doc_id").filter(~F.contains("made", "line") & ~F.contains(F.replace("made", F.lit(" | "), F.lit(" ")), F.col("line")))
        assert lost.isEmpty()


@pytest.mark.parametrize("mixed", [False, True])
def test_hung_tasks_over_many_batches(spark, con, tmp_path, mixed):
    """Ten files in the order of arrival, with updates up to 20 hours late, give what the whole table gives."""
    import scholia.plans.load  # noqa: F401
    from scholia.plans.registry import ORACLES
    from scholia.plans.streams import task_updates
    from scholia.streaming.run import drain
    feed = ten_files(spark, tmp_path, mixed)
    out = drain(S.hung_tasks(task_updates(feed.stream).select("task_id", "event_id", "ts", "status")), "append", "hung-test", feed=feed)
    got = sorted((r.task_id, r.hung_at.replace(tzinfo=None)) for r in out.select("task_id", F.col("hung_at").cast("timestamp_ntz")).collect())
    assert got == sorted(con.execute(ORACLES["str_task_hung"]).fetchall())


def test_hung_tasks_need_no_python_per_task(spark, tmp_path):
    """A timer per task in Python took a millisecond or more a task. Silence of exactly the limit is no hang; of equal times the larger event_id is last."""
    rows = [(1, 1, "10:00:00", "pending"), (1, 2, "11:00:00", "running"), (1, 3, "12:00:01", "completed"), (2, 5, "10:00:00", "running"),
            (2, 4, "10:00:00", "failed"), (3, 6, "10:00:00", "running"), (3, 7, "10:00:00", "failed"), (4, 8, "10:00:00", None)]
    made = spark.createDataFrame(rows, "task_id long, event_id long, at string, status string")
    made.select("task_id", "event_id", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "at")).alias("ts"), "status").write.parquet(str(tmp_path / "t"))
    batch = S.hung_tasks(spark.read.parquet(str(tmp_path / "t")))
    assert sorted((r.task_id, str(r.h)) for r in batch.select("task_id", F.col("hung_at").cast("string").alias("h")).collect()) == [
        (1, "2024-01-01 12:00:00"), (2, "2024-01-01 11:00:00")]
    live = S.hung_tasks(spark.readStream.schema(spark.read.parquet(str(tmp_path / "t")).schema).parquet(str(tmp_path / "t")))
    assert "TransformWithState" not in live._jdf.queryExecution().analyzed().toString()


def test_catalog_names_tables_of_many_files(spark, tmp_path):
    """A table may be one file, a folder of files, or one folder per value."""
    from scholia.sources import readers
    from scholia.sources.tables import Tables
    spark.range(4).repartition(2).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(4).withColumn("k", F.col("id") % 2).write.partitionBy("k").parquet(str(tmp_path / "events.parquet"))
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "nation.parquet")
    (tmp_path / "notes.txt").write_text("no table")
    assert [r.table_name for r in readers.catalog(Tables(spark, str(tmp_path))).collect()] == ["events", "nation", "orders"]
    assert [r.table_name for r in readers.catalog(Tables(spark, f"file:{tmp_path}/")).collect()] == ["events", "nation", "orders"]


@pytest.mark.parametrize("percent", [True, False])
def test_best_pairs_are_those_of_all_products(percent):
    """What single precision leaves out, ties, zeros, tiny lengths and missing numbers change nothing; sorting all products took ten times as long."""
    import numpy as np
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(500, 64)), rng.normal(size=(5000, 64))
    holes = np.where(np.arange(5000)[:, None] % 1000 < 998, np.nan, b)
    cases = [(a, b), (a[:5], b[:3]), (np.sign(a[:, :4]), np.sign(b[:, :4])), (np.round(a / 2), np.round(b / 2)), (a * (np.arange(500) % 3 > 0)[:, None], b * (np.arange(5000) % 900 < 3)[:, None]),
             (a[:50] * 1e-6, b * 1e-5), (a[:50], holes), (-np.abs(a[:50]), np.abs(b))]
    for x, y in cases:
        scale = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
        all_ = np.round(x @ y.T / (scale + 1e-9) * 100, 1) if percent else np.round(np.divide(x @ y.T, scale, out=np.zeros_like(scale), where=scale > 0), 9)
        top = np.argsort(-all_, axis=1, kind="stable")[:, :5]
        rows, at, scores = V.best_pairs(x, y, 5, percent)
        assert np.array_equal(rows, np.repeat(np.arange(len(x)), top.shape[1])) and np.array_equal(at, top.ravel())
        assert np.array_equal(scores, all_[rows, at], equal_nan=True)


def test_a_line_is_stripped_once(spark):
    """Inside a lambda every mention of an expression is worked out again: one strip a line, not one for each mark, count and column."""
    from scholia.operators import cleaning as C
    df = docs(spark, "# T\n\n- a\n| x | y |\n```\nbody", "", None)
    strips = lambda c: df.select(c)._jdf.queryExecution().optimizedPlan().toString().count(r"(?U)^\s+|\s+$")
    assert strips(F.inline(C.line_kinds("text"))) == 1 and strips(C.markdown_segments("text").alias("x")) == 1 and strips(C.classified_lines("text").alias("x")) == 2
    counts = df.select("doc_id", F.inline(C.line_kinds("text"))).orderBy("doc_id").collect()
    assert [tuple(r) for r in counts] == [(0, 5, 1, 1, 1, 2), (1, 0, 0, 0, 0, 0), (2, None, None, None, None, None)]
    assert strips(R.validate_markdown(F.col("text")).alias("x")) < 20


def test_pages_and_fonts_are_worked_out_once(spark):
    """The spans of a page are cut in one place of the plan, not again for a filter; a span's font is named once, not at every comparison; a line is stripped once."""
    from scholia.sources.tables import Tables
    from tests.conftest import SF
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    pages = Tables(spark, SF).span_pages
    assert plan(pages).count("inline(") == 1 and plan(pages.select("spans")).count(r"split(line") <= 1
    assert plan(layout.spans_to_lines(pages)).count("format_string") == 1
    rows = spark.createDataFrame([(10.0, [("a", 1.0, 2.0)])], "height double, lines array<struct<text:string,top:double,bottom:double>>")
    assert plan(layout.drop_headers_footers(rows)).count(r"(?U)^\s+|\s+$") == 1


def test_trim_equals_strip(spark):
    """For every character, at both ends, within a text and alone."""
    from scholia.functions.text import strip, trim, trim_bound
    df = spark.createDataFrame([(chr(i),) for i in range(0x10000) if not 0xD800 <= i < 0xE000] + [("",), (None,), ("😀",)], "c string")
    for s in (F.col("c"), F.concat(F.col("c"), F.lit(" a b\r"), F.col("c"), F.lit(" ")), F.concat(F.lit("a"), F.col("c"), F.lit("b"))):
        x = df.select(s.alias("x"))
        assert x.filter(~trim("x").eqNullSafe(strip("x")) | ~trim_bound(F.col("x")).eqNullSafe(strip("x"))).isEmpty()


def test_block_passes_are_cheap(spark):
    """Inside a lambda every mention of an expression is worked out again. No pass strips by a pattern or looks into short lists, and each pattern stands in few places."""
    d = blocks(spark, ("h1", "Nets"), ("body", "• one • two"), ("list", "a"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for step in (B.exact_dedup, B.heading_rank, B.heading_jumps, B.split_bullets, B.list_format, B.merge_continuations, B.list_wrapping, B.orphan_body,
                 B.split_list_headers, B.redundant_metadata, B.split_examples, B.list_header_extract, B.to_markdown):
        told = plan(step(d))
        assert "(?U)^\\s+|\\s+$" not in told and " IN (" not in told and told.count("regexp") <= 12, step.__name__


def test_block_edges(spark):
    """White space of other scripts, marks at either end, and blocks that a cheap test lets pass although the pattern does not."""
    many = [("h1", "Nets"), ("body", " (iv) four "), ("body", "(iv four"), ("body", "ix"), ("body", "- -x"), ("body", "-"), ("list", "– dash"), ("body", "a: -B")]
    assert shown(B.list_format(blocks(spark, *many))) == [
        ("h1", "Nets"), ("ordered_list", "(iv) four"), ("body", "(iv four"), ("body", "ix"), ("list", "x"), ("body", "-"), ("list", "dash"), ("body", "a: B")]
    assert shown(B.split_bullets(blocks(spark, ("body", "…"), ("body", "•"), ("body", "x • y "), ("body", "••"), ("body", "a • bc • d • ef")))) == [
        ("body", "…"), ("list", "•"), ("body", "x  y"), ("body", "••"), ("list", "bc"), ("list", "ef")]
    runs = blocks(spark, *[("h2" if i % 130 == 129 else "h1" if i == 0 else "body", f"text {i}") for i in range(400)], ("h5", "Last"), ("h5", "LAST"))
    assert [t for t, _ in shown(B.heading_jumps(runs)) if t != "body"] == ["h1", "h2", "h2", "h2", "h3"]
    assert [b.blocks for b in B.heading_jumps(runs.select("doc_id", F.lit(None).cast(f"array<{B.BLOCK}>").alias("blocks"))).collect()] == [[]]
    lines = [f"{i} chapter on subject {i:03d}" for i in range(40)] + ["chapter on subject", "40 chapter on subject 007 and more"]
    assert B.heading_survivors(["h2"] * 42, lines) == [i != 7 and i != 40 for i in range(42)]
