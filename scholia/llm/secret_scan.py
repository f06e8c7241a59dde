"""Secrets by patterns and by character Markov models; native expressions only.

Base patterns find assignments, access keys and hex strings. Further spans are tokens that a first-order Markov model of
random strings explains better than one of ordinary identifiers. The models are trained on the corpus as the base patterns label it: the
secrets they find are random, all other tokens are ordinary. As these secrets may know one alphabet only, a token is
also held against even draws from the characters of its own kinds. How much better is enough follows from the models: see ``cut_offs``.
Training counts tokens, then their character pairs, in Spark; what reaches the driver is one number per pair of ASCII characters.

Scale: every text is scanned within its row; no shuffle but for the training counts. Positions come from the lengths of the matches and of the
gaps between them, which is linear in the text.
"""

from __future__ import annotations

import math
import random
import string
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import Folded, fold_out
from scholia.session import cut_lineage

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

# Where the shortest match that counts begins no later than the plain pattern's, the length stands in the pattern: fewer matches to drop.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]

TOKEN, MIN_TOKEN = "[A-Za-z0-9+/_=.-]", 16
BACK_OFF = 8.0
SQUARE = 128 * 128
# Kinds of characters in a token and how many there are of each; hex is told apart as the base patterns have it.
CLASSES = [("[0-9]", 10), ("[a-z]", 26), ("[A-Z]", 26), ("[+/_=.-]", 6)]
HEX_ONLY, HEX_SIZE = "^([0-9a-f]*[a-f][0-9a-f]*|[0-9A-F]*[A-F][0-9A-F]*)$", 16
# Ordinary tokens that may pass: of those the model makes up, and of held-out ones. Random ones that may not, where both cannot be had.
PASS_MODEL, PASS_HELD, MISS = 1e-9, 1e-3, 0.005
LONGEST, DRAWN, ENOUGH = 64, 1000, 100
DRAWN_FROM = ["0123456789abcdef", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters,
              string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"]


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end (code points, end exclusive) and value (of ``group``) of every match of a pattern that never matches the empty string."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    of = "struct<start:bigint,end:bigint,value:string>"
    zipped = F.filter(F.arrays_zip(whole.alias("m"), gaps.alias("g"), value.alias("v")), lambda x: x["m"].isNotNull())

    def step(done: Folded, x: Column) -> tuple[dict[str, Column], Column]:
        start = done["at"] + F.char_length(x["g"])
        end = start + F.char_length(x["m"])
        return {"at": end}, F.array(F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value")))

    found = fold_out(zipped, {"at": F.lit(0).cast("long")}, step, of)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{of}>"))


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_assign``, ``_access``, ``_hex``: the base matches with what they hold as value."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"_assign": F.filter(located(whole, ASSIGN, 2), lambda x: F.char_length(x["value"]) >= 6),
                           "_access": located(whole, LONG_ACCESS), "_hex": located(whole, LONG_HEX)})


def pairs_of(token: Column) -> Column:
    """Numbers (first * 128 + second) of the character pairs of an ASCII token, in order."""
    codes = F.transform(F.split(token, ""), F.ascii)
    return F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a * 128 + b)


def scored(token: Column, model: list[float]) -> Column:
    """n, score and digits of a token: its distinct pairs, so that a run of one character counts once, by how much (log) they are likelier if random,
    and whether it is a number."""
    numbers = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<double>")
    ratios, costs = numbers(model[:SQUARE]), numbers(model[SQUARE:2 * SQUARE])
    own = sum((F.when(token.rlike(kind), size).otherwise(0) for kind, size in CLASSES), F.lit(0))
    even = F.log(F.when(token.rlike(HEX_ONLY), HEX_SIZE).otherwise(own))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("ratio"), F.lit(0.0).alias("cost"))
    step = lambda s, p: F.struct((s["n"] + 1).alias("n"), (s["ratio"] + F.get(ratios, p)).alias("ratio"), (s["cost"] + F.get(costs, p)).alias("cost"))
    return F.aggregate(F.array_distinct(pairs_of(token)), start, step, lambda s: F.struct(
        s["n"].alias("n"), F.greatest(s["ratio"], s["cost"] - even * s["n"]).alias("score"), (~token.rlike("[^0-9]")).alias("digits")))


def cut_offs(model: list[float], held: dict[int | None, tuple[int, float]]) -> list[float]:
    """The least score of a random token by its number of distinct pairs (0 to LONGEST; beyond, in proportion).

    ``model`` holds ratios and costs, ``held`` the number of held-out ordinary tokens and the score per pair that few of them pass, by ``band`` and
    (None) of all. A score of t is reached by at most exp(-t) of the tokens that the ordinary model makes up, for each of the laws a token is held
    against. A corpus whose held-out tokens score as random ones do, as where bare secrets abound, must not hide these: the cut-off never
    exceeds what all but MISS of the tokens drawn evenly from each alphabet reach. Plain numbers, ordinary and random ones alike, get no such help.
    """
    laws = 2 ** len(CLASSES) + 2
    bound = math.log(laws / PASS_MODEL)
    rng, reached = random.Random(8), [[[] for _ in range(LONGEST + 1)] for _ in DRAWN_FROM]
    for letters, at in zip(DRAWN_FROM, reached):
        kinds = sum(n for kind, n in zip((string.digits, string.ascii_lowercase, string.ascii_uppercase, "+/"), (10, 26, 26, 6)) if set(kind) & set(letters))
        even = math.log(HEX_SIZE if letters == DRAWN_FROM[0] else kinds)
        for _ in range(DRAWN):
            last, seen, ratio, cost = ord(rng.choice(letters)), set(), 0.0, 0.0
            for _ in range(LONGEST):
                c = ord(rng.choice(letters))
                pair, last = last * 128 + c, c
                if pair not in seen:
                    seen.add(pair)
                    ratio, cost = ratio + model[pair], cost + model[SQUARE + pair]
                    at[len(seen)].append(max(ratio, cost - even * len(seen)))
    cuts = [bound]
    for n in range(1, LONGEST + 1):
        count, per_pair = held.get(band(n), (0, 0.0))
        if count < ENOUGH:
            per_pair = held.get(None, (0, 0.0))[1]
        ceiling = min((sorted(a[n])[int(len(a[n]) * MISS)] for a in reached if len(a[n]) >= DRAWN // 2), default=math.inf)
        # Scores this short of the bound are left out: on so few pairs nobody can tell.
        cuts.append(round(max(bound / 2, min(max(bound, per_pair * n), ceiling)), 3))
    return cuts


def band(n: int) -> int:
    """Lengths that share a cut-off per pair: up to 23 pairs, 24 to 31, and so on."""
    return min(max(n // 8, 2), LONGEST // 8)


def tokens_of(docs: DataFrame) -> DataFrame:
    """half, token, n: how often every ordinary token of four characters or more occurs in each half of the texts; copies fall into the same one.
    With half null every secret that the base patterns find, once."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, ASSIGN, " "), LONG_ACCESS, " "), LONG_HEX, " ")
    half = F.pmod(F.xxhash64(whole, F.lit("half")), F.lit(2)).cast("int")
    row = lambda half: lambda token: F.struct(half.alias("half"), token.alias("token"))
    secrets = F.transform(F.concat("_assign", "_access", "_hex"), lambda x: row(F.lit(None).cast("int"))(x["value"]))
    ordinary = F.transform(F.regexp_extract_all(bare, F.lit(TOKEN + "{4,}"), F.lit(0)), row(half))
    each = with_base(docs.select("text")).select(F.inline(F.concat(secrets, ordinary)))
    return each.groupBy("half", "token").agg(F.when(F.col("half").isNull(), 1).otherwise(F.count("*")).alias("n"))


def fitted(seen: list[dict[int, int]]) -> list[float]:
    """Ratios and costs from the numbers of pairs in ordinary tokens and in secrets."""
    symbols = [c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=.-"]
    rows = [{a: sum(seen[kind].get(a * 128 + b, 0) for b in symbols) for a in symbols} for kind in (0, 1)]
    alone = [{b: (sum(seen[kind].get(a * 128 + b, 0) for a in symbols) + 1) / (sum(rows[kind].values()) + len(symbols)) for b in symbols} for kind in (0, 1)]
    table = [0.0] * (2 * SQUARE)
    for a in symbols:
        for b in symbols:
            own = [(seen[kind].get(a * 128 + b, 0) + BACK_OFF * alone[kind][b]) / (rows[kind][a] + BACK_OFF) for kind in (0, 1)]
            table[a * 128 + b], table[SQUARE + a * 128 + b] = round(math.log(own[1] / own[0]), 3), round(-math.log(own[0]), 3)
    return table


def train(docs: DataFrame) -> list[float]:
    """For every pair of ASCII characters (first * 128 + second) the log-likelihood ratio, random over ordinary; then for every pair what it costs the
    ordinary model (-log); then the cut-offs. Without ordinary tokens there are none, and no token counts as random.

    All distinct secrets and all ordinary tokens of all texts count. For the cut-offs the tokens of each half are scored by a model of the other
    half's. Pairs are backed off to how often the second character occurs, those to one extra count each, so an empty table gives ratios of zero.
    What reaches the driver is bounded: a number per pair, and one per score of three decimals.
    """
    tokens = cut_lineage(tokens_of(docs))
    pairs = tokens.select("half", "n", F.explode(pairs_of(F.col("token"))).alias("pair")).filter("pair is not null")
    seen: dict[int | None, dict[int, int]] = {0: {}, 1: {}, None: {}}
    for r in pairs.groupBy("half", "pair").agg(F.sum("n").alias("n")).collect():
        seen[r["half"]][r["pair"]] = r["n"]
    every = {pair: seen[0].get(pair, 0) + seen[1].get(pair, 0) for pair in seen[0] | seen[1]}
    table = fitted([every, seen[None]])
    if not every:
        return table
    held: dict[int | None, Counter] = defaultdict(Counter)
    for half in (0, 1):
        if seen[1 - half]:
            long = tokens.filter((F.col("half") == half) & (F.length("token") >= MIN_TOKEN))
            rated = long.select("n", scored(F.col("token"), fitted([seen[1 - half], seen[None]])).alias("s")).select(
                "n", F.least(F.greatest(F.floor(F.col("s.n") / 8), F.lit(2)), F.lit(LONGEST // 8)).cast("int").alias("band"),
                F.ceil(F.col("s.score") / F.col("s.n") * 1000).alias("rate"))
            for r in rated.groupBy("band", "rate").agg(F.sum("n").alias("n")).collect():
                held[r["band"]][r["rate"]] += r["n"]
                held[None][r["rate"]] += r["n"]
    return table + cut_offs(table, {at: (rates.total(), passed_by(rates) / 1000) for at, rates in held.items()})


def passed_by(rates: Counter) -> float:
    """The least of the numbers that all but PASS_HELD are at most."""
    most, below = (1 - PASS_HELD) * rates.total(), 0
    for rate in sorted(rates):
        below += rates[rate]
        if below >= most:
            return rate
    return 0.0


def with_spans(df: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """``with_base`` and ``_spans``: all spans (start, kind's number, end) in order. Random tokens hold a letter and touch no base span; numbers, which are
    random and ordinary alike (cards, accounts, times), are left to the base patterns."""
    df = with_base(df, text)
    whole = F.coalesce(F.col(text), F.lit(""))
    tokens = F.filter(located(whole, TOKEN + f"{{{MIN_TOKEN},}}"), lambda x: x["value"].rlike("[0-9A-Za-z]"))
    df = df.withColumn("_tokens", tokens)
    cuts = model[2 * SQUARE:]
    least = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<double>")

    def is_random(x: Column) -> Column:
        beyond = F.greatest(F.lit(1.0), x["n"] / F.lit(float(LONGEST)))
        return ~x["digits"] & (x["score"] >= F.get(least, F.least(x["n"], F.lit(LONGEST))) * beyond)

    flat = lambda c, kind: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    df = df.withColumn("_base", F.array_sort(F.concat(flat(F.col("_assign"), 0), flat(F.col("_access"), 1), flat(F.col("_hex"), 2))))
    free = F.filter("_tokens", lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])) & (
        is_random(scored(x["value"], model)) if cuts else F.lit(False)))
    return df.withColumn("_spans", F.array_sort(F.concat("_base", flat(free, 3))))


def _told(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame, model: list[float]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points) for every row; null texts are empty."""
    count = lambda c: F.size(c).cast("long")
    return with_spans(docs.select("doc_id", "text"), model).select(
        "doc_id", count("_assign").alias("n_assign"), count("_access").alias("n_access"), count("_hex").alias("n_hex"),
        F.sha2(_told("_base"), 256).alias("base_sha256"), _told("_spans").alias("spans"))


def redact(docs: DataFrame, model: list[float], mark: str = "[SECRET]", count: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark``, overlapping ones by one; texts without spans stay to the letter, null ones null.

    ``count`` names a column to get the new number of code points where a text has changed.
    """
    found = with_spans(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text")), model, "_text")

    def step(done: Folded, x: Column) -> tuple[dict[str, Column], Column]:
        gap = F.substr(F.col("_text"), (done["at"] + 1).cast("int"), (x["start"] - done["at"]).cast("int"))
        new = F.when(x["start"] < done["at"], F.array().cast("array<string>")).otherwise(F.array(F.concat(gap, F.lit(mark))))
        return {"at": F.greatest(done["at"], x["end"])}, new

    rest = lambda d, out: F.concat(F.array_join(out, ""), F.substr(F.col("_text"), (d["at"] + 1).cast("int")))
    text = fold_out(F.col("_spans"), {"at": F.lit(0).cast("long")}, step, "string", rest)
    new = F.when(F.size("_spans") > 0, text).otherwise(F.col("_text"))
    told = {"text": new}
    if count:
        told[count] = F.when(F.size("_spans") > 0, F.char_length(new).cast(dict(docs.dtypes)[count])).otherwise(F.col("_row")[count])
    return found.select(*[told.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
