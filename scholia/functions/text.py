"""Text column helpers. A document is one row, so lines and words live in arrays of that row:
cleaning a corpus needs no shuffle and never gathers rows of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``.

    A plain column used inside a lambda would be evaluated again for every array element.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def unroll(df, keys: list[str], items: Column | str, index: str, fields: dict[str, Callable[[Column], Column]]):
    """One row per element with the wanted fields as plain columns.

    Reading fields of an exploded struct would make the optimiser split the array into one array per
    field and evaluate its expression for each of them.
    """
    flat = F.transform(col(items), lambda x, i: F.struct(i.alias(index), *[get(x).alias(n) for n, get in fields.items()]))
    return df.select(*keys, F.inline(flat))


def field(name: str) -> Callable[[Column], Column]:
    """Field, or field of a field, of a struct element."""
    def get(x: Column) -> Column:
        for part in name.split("."):
            x = x[part]
        return x
    return get


def strip(c: Column | str) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)\s+$", "")


# The characters that (?U)\s matches.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column | str) -> Column:
    """What ``strip`` gives, without a pattern."""
    return F.btrim(col(c), F.lit(SPACE))


def trim_bound(c: Column) -> Column:
    """``trim`` of a column or bound value, which is mentioned several times: a text that visible ASCII characters begin and end is left as it is."""
    plain = lambda at: F.substring(c.cast("binary"), at, 1).between(F.lit(b"!"), F.lit(b"\x7f"))
    return F.when(plain(1) & plain(-1), c).otherwise(trim(c))


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


def words(c: Column | str) -> Column:
    """Split on runs of white space, no empty words."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def tokens(c: Column | str) -> Column:
    """Letters, digits and underscore in any script."""
    return F.regexp_extract_all(col(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def joined(items: Column, sep: str = "\n") -> Column:
    return F.array_join(items, sep)


def map_lines(c: Column | str, fn: Callable[[Column], Column]) -> Column:
    return joined(F.transform(lines(c), lambda x: fn(x)))


def keep_lines(c: Column | str, fn: Callable[[Column], Column]) -> Column:
    return joined(F.filter(lines(c), lambda x: fn(x)))


def is_upper(c: Column) -> Column:
    """At least one upper-case letter and no lower-case one."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}|\p{Lt}")


def is_title(c: Column) -> Column:
    """Upper case exactly at the start of each run of letters."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Lu}\p{Ll}]\p{Lu}") & ~c.rlike(r"(^|[^\p{Lu}\p{Ll}])\p{Ll}")


def any_of(c: Column, patterns: list[str]) -> Column:
    """One alternation of all patterns: one scan of the text."""
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def first_where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(items, lambda x: test(x)), F.lit(1))


def last_where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(items, lambda x: test(x)), F.lit(-1))


def replace_all(c: Column | str, mapping: dict[str, str]) -> Column:
    """Single characters by translate, longer keys one by one, longer keys first."""
    out = col(c)
    for old in sorted((k for k in mapping if len(k) > 1), key=len, reverse=True):
        out = F.replace(out, F.lit(old), F.lit(mapping[old]))
    single = {k: v for k, v in mapping.items() if len(k) == 1}
    if single:
        out = F.translate(out, "".join(single), "".join(single.values()))
    return out


CHUNK = 128


class Folded:
    """What a step of ``fold_out`` sees: its state by name, and the list so far as full chunks and the elements after them."""

    def __init__(self, state: Column, chunks: Column) -> None:
        self.state, self.chunks, self.rest = state, chunks, state["_out"]

    def __getitem__(self, name: str) -> Column:
        return self.state[name]

    def last(self, n: Column) -> Column:
        """The last ``n`` elements; null if there are fewer."""
        k = F.least(F.size(self.chunks), n)
        near = F.concat(F.flatten(F.slice(self.chunks, F.size(self.chunks) - k + 1, k)), self.rest)
        return let(near, lambda v: F.when(F.size(v) >= n, F.slice(v, F.size(v) - n + 1, n)))


def fold_out(items: Column, start: dict[str, Column], step: Callable[[Folded, Column], tuple[dict[str, Column], Column]], of: str,
             finish: Callable[[Column, Column], Column] = lambda state, out: out) -> Column:
    """Fold that collects a list: ``step(state, item)`` gives the next state and an array (of ``of``) to add, or one struct of
    both (``_new`` is the array) where they are worked out together; ``finish(state, list)`` gives the result.

    A fold copies all that it carries at every step. So items are folded in runs of ``CHUNK``, which carry what this run has collected, and a fold over
    the runs carries the rest: the cost per item does not grow with the list, up to millions of items.
    """
    none, kept = F.array().cast(f"array<{of}>"), F.array().cast(f"array<array<{of}>>")
    pack = lambda state, out: F.struct(*[state[k].alias(k) for k in start], out.alias("_out"))
    bind = lambda value, zero, body: F.aggregate(F.array(value), zero, body)

    def whole(all_: Column) -> Column:
        def one_run(a: Column, at: Column) -> Column:
            def add(s: Column, x: Column) -> Column:
                told = step(Folded(s, a["_chunks"]), x)
                stepped = told if isinstance(told, Column) else F.struct(*[told[0][k].alias(k) for k in start], told[1].cast(f"array<{of}>").alias("_new"))
                return bind(stepped, s, lambda s, v: pack(v, F.concat(s["_out"], v["_new"])))
            done = F.aggregate(F.slice(all_, at * CHUNK + 1, F.lit(CHUNK)), pack(a, none), add)
            return bind(done, a, lambda a, d: F.struct(*[d[k].alias(k) for k in start], F.concat(a["_chunks"], F.array(d["_out"])).alias("_chunks")))
        runs = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
        zero = F.struct(*[start[k].alias(k) for k in start], kept.alias("_chunks"))
        return F.when(all_.isNotNull(), F.aggregate(runs, zero, one_run, lambda a: finish(a, F.flatten(a["_chunks"]))))
    return let(items, whole)


def running_count(items: Column, test: Callable[[Column], Column]) -> Column:
    """How many elements up to and including each one pass the test."""
    def step(a: Folded, x: Column) -> tuple[dict[str, Column], Column]:
        n = a["n"] + F.when(test(x), 1).otherwise(0)
        return {"n": n}, F.array(n)
    return fold_out(items, {"n": F.lit(0)}, step, "int")


def runs_of(items: Column, starts: Callable[[Column, Column], Column], build: Callable[[Column, Column], Column]) -> Column:
    """Cut an array where ``starts(previous, item)`` holds and build one element per run."""
    def cut(xs: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | starts(F.get(xs, i - 1), F.get(xs, i)))
        def runs(f: Column) -> Column:
            ends = F.concat(F.slice(f, 2, F.greatest(F.size(f), F.lit(1))), F.array(F.size(xs)))
            return F.zip_with(f, ends, lambda a, b: build(F.slice(xs, a + 1, b - a), a))
        return let(firsts, runs)
    return let(items, cut)
