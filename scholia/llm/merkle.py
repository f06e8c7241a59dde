"""Merkle manifest of a dataset: one digest per row, folded up to one root per group and one over all groups.

Nodes of a level are numbered within their tree. Every level equijoins the nodes with the computed indices of their siblings (for two to a run
that is the index XOR 1, otherwise the other slots of the run), and the rows of slot zero emit the parents. Going down again, every node
takes the path of its parent and puts its own siblings before it.

Scale: a level has a third of the nodes of the one below, so all levels together cost half as much again as the leaves. Joins are on (tree, index), which is
unique, so a group that holds most rows is dealt out like any other; numbers within groups come from range partitions (``add_rank``).
Texts are read once and leave their row as digests. Levels are tables in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.ordered import add_rank
from scholia.llm.common import stored

ARITY = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def told(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Digest of a row's ``FIELDS``, some of them perhaps ``changed``."""
    return digest(*[told(changed.get(c, F.col(c))) for c in FIELDS])


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds ``left`` and ``right``: the digests of the other nodes of the run before and after each node, as one string each."""
    slot = F.col("idx") % arity
    for step in range(1, arity):
        other = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("digest").alias(f"_s{step}"))
        wanted = F.col("idx") - slot + (slot + step) % arity
        nodes = nodes.join(other.hint("merge"), (F.col("tree") == F.col("_tree")) & (wanted == F.col("_idx")), "left").drop("_tree", "_idx")
    said = [F.coalesce(F.col(f"_s{step}"), F.lit("")) for step in range(1, arity)]
    wraps = lambda step: slot + step >= arity
    return nodes.withColumns({
        "left": F.concat(*[F.when(wraps(i + 1), s).otherwise("") for i, s in enumerate(said)]),
        "right": F.concat(*[F.when(wraps(i + 1), "").otherwise(s) for i, s in enumerate(said)])}).drop(*[f"_s{s}" for s in range(1, arity)])


def grow(nodes: DataFrame, arity: int = ARITY) -> list[tuple[DataFrame, DataFrame]]:
    """Levels of all trees at once, from tree (not null), idx (from 0), n (nodes of the tree), digest; more columns stay with the leaves.

    Each level is a pair: the nodes that have a parent, with left and right, and the trees that end there (their one node). A last run of fewer nodes,
    even one, is hashed like any other; a tree of one leaf is that leaf.
    """
    levels = []
    while True:
        tops = nodes.filter("n = 1")
        inner = stored(with_siblings(nodes.filter("n > 1"), arity), "merkle")
        levels.append((inner, tops))
        if inner.isEmpty():
            return levels
        first = inner.filter(F.col("idx") % arity == 0)
        nodes = first.select("tree", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"),
                             digest(F.col("digest"), F.col("right")).alias("digest"))


STEP = "struct<left:string,right:string>"


def paths(levels: list[tuple[DataFrame, DataFrame]], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with ``path``, the (left, right) of every level from the leaf up, and with the columns of ``above``.

    ``above`` has one row per tree: tree, path (of its root, upwards) and whatever else belongs to the tree.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    known = None
    for depth in range(len(levels) - 1, -1, -1):
        inner, tops = levels[depth]
        extra = [] if depth else [c for c in inner.columns if c not in ("left", "right", "n")]
        columns = extra or ["tree", "idx"]
        # Roots are few against their leaves; each meets its own tree's row.
        here = tops.select(*columns).join(above.hint("merge"), "tree").select(*columns, "path", *more)
        if known is not None:
            up = known.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("path").alias("_path"), *more)
            met = inner.join(up.hint("merge"), (F.col("tree") == F.col("_tree")) & (F.floor(F.col("idx") / arity) == F.col("_idx")))
            here = here.unionByName(met.select(*columns, F.concat(F.array(F.struct("left", "right")), F.col("_path")).alias("path"), *more))
        # Written level by level: small plans, and no table of a level is sent to the driver to be broadcast.
        known = stored(here, "paths") if depth else here
    return known


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level from the leaf, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, start, lambda now, s: digest(s["left"], now, s["right"]))


def manifest(docs: DataFrame, seen: Column | None = None, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, seen, subroot, root and path of every row of ``docs`` (the columns ``FIELDS``; more are ignored).

    ``seen`` is another digest of the row, carried along (null if none is given). One tree per source, its leaves by doc_id (null ids first, repeated ids
    by digest, equal rows in the order they are read), and one over the sources' roots, by source (null first, then by UTF-8 bytes). An empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"), "doc_id", leaf().alias("digest"),
                       (F.lit(None).cast("string") if seen is None else seen).alias("seen"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "leaves")
    sizes = rows.groupBy("tree").agg(F.count("*").alias("n"))
    placed = add_rank(rows, ["tree"], [F.col("doc_id"), F.col("digest"), F.col("row")], "idx").withColumn("idx", F.col("idx") - 1)
    # Sizes follow from the numbers: the last leaf of a tree knows how many there are. One row per source, joined to salted leaves.
    trees = grow(stored(with_sizes(placed, sizes).select("tree", "idx", "n", "digest", "doc_id", "seen"), "numbered"), arity)
    roots = reduce(DataFrame.unionByName, [tops.select("tree", "digest") for _, tops in trees])
    roots = stored(roots, "subroots")
    many = roots.count()
    over = add_rank(roots.withColumnRenamed("tree", "name"), [], [F.col("name")], "idx").select(
        F.lit("").alias("tree"), (F.col("idx") - 1).alias("idx"), F.lit(many).cast("long").alias("n"), "digest", "name")
    top = grow(over, arity)
    root = reduce(DataFrame.unionByName, [tops.select("tree", F.col("digest").alias("root")) for _, tops in top])
    above = root.withColumn("path", F.array().cast(f"array<{STEP}>"))
    above = stored(paths(top, above, arity).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "above")
    return paths(trees, above, arity).select("doc_id", F.col("digest").alias("leaf"), "seen", "subroot", "root", "path")


SALTS = 64


def with_sizes(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds ``n`` of each row's tree. Rows are salted by index, sizes are repeated per salt: the largest tree is spread over ``SALTS`` keys."""
    salted = sizes.select("tree", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return placed.withColumn("salt", (F.col("idx") % SALTS).cast("int")).join(salted.hint("merge"), ["tree", "salt"]).drop("salt")


def tampered() -> Column:
    """The rows' digest after tampering: texts lose their line feeds where 2 divides the unsigned crc32 of the decimal id; null for the others and for null ids."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(hit, leaf(text=F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf, if the row was tampered with) and verified of every row."""
    made = manifest(docs, tampered())
    out = made.withColumn("folded_root", folded(F.coalesce("seen", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
