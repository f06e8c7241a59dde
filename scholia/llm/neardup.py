"""Near-duplicate groups by SuperMinHash signatures.

Texts become sets of word shingles. A set's signature keeps, per slot, the smallest (level + draw) over its elements; an element
visits the slots in an order of its own, one per level, so the slots of one set are correlated and vary less than
independent hashes. Levels are visited for all elements of a block of documents together and stop as soon as no slot can
still change. Bands of the signature give candidates; candidates are confirmed on the full sets; union-find over the
confirmed links gives the groups.

Scale: equal sets are one node, so copies never meet each other. A bucket is never paired with itself: in two rounds its members are
compared with one elected member, and links inside a group need no further proof. What is left are sets in buckets that still hold several groups;
links between those are found exactly, by the rarest items of each set, so that a template or passage of many texts
makes no pairs. Candidates, links and labels stay in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from scholia.llm.common import keep_listed, map_batches, release
from scholia.session import cut_lineage, scratch_path

BANDS, ROWS = 32, 5
BLOCK, NEARBY, CELLS = 200_000, 32, 512
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle, no words none.

    Words are runs without space and \\x09-\\x0D, A-Z in lower case.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mix(out * _GOLD + h[i:i + len(out)])
    return np.unique(out)


def digest_of(items: np.ndarray) -> bytes | None:
    return xxh3_128_digest(items.tobytes()) if len(items) else None


def parities(items: np.ndarray) -> np.ndarray:
    """Bits (as 64-bit numbers) that say which of CELLS cells get an odd number of the items. Two sets differ in as many items at least as in cells."""
    return np.packbits(np.bincount((items % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.uint8) & 1).view(np.int64)


def super_minhash(items: np.ndarray, owner: np.ndarray, owners: int, slots: int) -> np.ndarray:
    """Signatures (owners x slots) of all sets at once; ``owner`` says whose element each item is."""
    sig = np.full(owners * slots, np.inf)
    perm = first = None
    for level in range(slots):
        z = _mix(items + np.uint64((level + 1) * int(_GOLD) % 2**64))
        draw = (z >> np.uint64(11)) * 2.0**-53
        pick = level + (_mix(z + _GOLD) % np.uint64(slots - level)).astype(np.int64)
        if level:
            if perm is None:  # the first swap, made up for: position 0 and the first pick
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(items), 1))
                perm[np.arange(len(items)), first], perm[:, 0] = 0, first
            at = np.arange(len(items))
            slot = perm[at, pick]
            perm[at, pick] = perm[:, level]
            perm[:, level] = slot
        else:
            slot = pick
        np.minimum.at(sig, owner * slots + slot, level + draw)
        # Whatever is drawn from here on is at least level + 1.
        open_ = sig.reshape(owners, slots).max(axis=1) >= level + 1
        keep = open_[owner]
        if not keep.any():
            break
        if not keep.all():
            items, owner = items[keep], owner[keep]
            perm = perm[keep] if perm is not None else None
            pick = pick[keep]
        if not level:
            first = pick
    return sig.reshape(owners, slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2])
    for i in range(rows):
        key = _mix(key * _GOLD + bits[:, :, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int, rows: int, number: Column | None = None) -> DataFrame:
    """doc_id, rid, n (set size), digest of the set, keys (one per band); empty sets have no digest and no keys."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        release()
        texts, sizes, digests, keys = batch.column(2), [], [], []
        block: list[np.ndarray] = []

        def flush() -> None:
            full = [s for s in block if len(s)]
            if full:
                owner = np.repeat(np.arange(len(full)), [len(s) for s in full])
                found = iter(band_keys(super_minhash(np.concatenate(full), owner, len(full), bands * rows), bands, rows))
            for s in block:
                sizes.append(len(s))
                digests.append(digest_of(s))
                keys.append(next(found) if len(s) else None)
            block.clear()

        waiting = 0
        for text in texts:
            block.append(s := shingles(text.as_py(), k))
            waiting += len(s)
            if waiting >= BLOCK or len(block) >= 2000:
                flush()
                waiting = 0
        flush()
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                           pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "rid", "n", "digest", "keys"])

    numbered = docs.select("doc_id", (F.monotonically_increasing_id() if number is None else number).alias("rid"), "text")
    return map_batches(numbered, sign, "doc_id bigint, rid bigint, n bigint, digest binary, keys array<bigint>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, items (sorted shingle hashes), cells (their ``parities``) for the ``wanted`` rows: node, digest, doc_id."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = [shingles(t.as_py(), k) for t in batch.column(0)]
        return pa.RecordBatch.from_arrays([pa.array(map(digest_of, items), pa.binary()), pa.array([s.view(np.int64) for s in items], pa.list_(pa.int64())),
                                           pa.array([parities(s) for s in items], pa.list_(pa.int64()))], names=["digest", "items", "cells"])

    ids = cut_lineage(wanted.select("doc_id").distinct())
    found = map_batches(keep_listed(docs.select("doc_id", "text"), ids, "doc_id").select("text"), sets, "digest binary, items array<bigint>, cells array<bigint>")
    return found.join(wanted, "digest").select("node", "items", "cells").dropDuplicates(["node"])


# -- union-find --------------------------------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: each node but the smallest of its set, with that smallest one."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, comp for every node of ``edges`` (u > v) but the smallest of each component; comp is that smallest node.

    Partitions contract their own edges by union-find; neighbours of a node are then all hung on the smallest
    of them (first the larger ones, then the smaller ones) until every node hangs on a node that hangs on none.
    Memory: one partition's edges at most.
    """
    schema = "u bigint, v bigint"
    now = cut_lineage(edges.select("u", "v").distinct().mapInArrow(_forest, schema))
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut_lineage(small.select("e.u", "e.v").filter("u > v").distinct().mapInArrow(_forest, schema))
        many = now.groupBy("u").count().filter("count > 1").select("u")
        hung = now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
        if many.union(hung).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))


# -- groups ------------------------------------------------------------------------------------------


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u > v) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("u"), F.col("items").alias("iu"))
    right = sets.select(F.col("node").alias("v"), F.col("items").alias("iv"))
    both = F.size(F.array_intersect("iu", "iv")).cast("long")
    union = F.size("iu") + F.size("iv") - both
    return pairs.join(left, "u").join(right, "v").filter(100 * both >= percent * union).select("u", "v")


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """u > v: all pairs of different ``comp`` that may be linked, from node, comp, n, items, cells; exact.

    Sets that are alike enough share an item among the first n - ceil(percent/100 n) + 1 of both, in any order that is the same for all.
    Here the rarest items come first, so a passage or template that many texts share leads to no pairs between texts that differ otherwise. Of
    the common items of a pair the first one has the earliest places in both, so testing the places of each loses no pair; and it is the one with no other
    before it, where the pair is made. Sets whose cells differ too often have too many items apart, which spares most pairs that are just not
    alike enough, as among copies of one text that were edited more.
    """
    each = sets.select("node", F.explode("items").alias("item"))
    shared = each.groupBy("item").agg(F.count("*").alias("c")).filter("c > 1")
    # Items of one text only come first of all; they lead to nobody but take up places.
    held = each.join(shared, "item").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "item"))).alias("held"))
    alone = F.col("n") - F.size("held")
    room = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - alone
    # With each item go the ones before it: a pair that has one of these in common is made there. A slice bounds the rows of long texts; where
    # it ends too soon a pair comes more than once, none is lost.
    near = lambda i: F.transform(F.slice("held", F.greatest(i - NEARBY, F.lit(0)) + 1, F.least(i, F.lit(NEARBY))), lambda h: h["item"])
    numbered = F.transform(F.slice("held", F.lit(1), room.cast("int")), lambda h, i: F.struct(
        (F.col("alone") + i + 1).alias("place"), h["item"].alias("item"), near(i).alias("before")))
    first = (held.join(sets.select("node", "comp", "n", "cells"), "node").filter(room > 0)
             .withColumn("alone", alone).select("node", "comp", "n", "cells", F.inline(numbered)))
    other = first.select(F.col("node").alias("other"), F.col("comp").alias("rcomp"), F.col("n").alias("m"), F.col("place").alias("rplace"), F.col("item").alias("ritem"),
                         F.col("before").alias("rbefore"), F.col("cells").alias("rcells"))
    # A first common item this late in either set leaves too few for the intersection.
    left = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("rplace")) + 1
    apart = F.aggregate(F.zip_with("cells", "rcells", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    pairs = first.join(other, (F.col("item") == F.col("ritem")) & (F.col("comp") < F.col("rcomp")) & close(F.col("n"), F.col("m"), percent)
                       & ((100 + percent) * left >= percent * (F.col("n") + F.col("m"))) & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m"))) & ~F.arrays_overlap("before", "rbefore"))
    return pairs.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()


def close(a, b, percent: int):
    """Sets of these sizes can be alike enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    number: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and rid for every row of ``docs`` (doc_id, text; more columns are ignored).

    component_id is the smallest doc_id that links lead to; null ids come last. Null and empty texts, and texts without
    words, are linked with nothing. Of rows that repeat a doc_id within a group one is kept.
    rid is ``number`` (distinct bigints, a column of ``docs``), or else counted in this reading of ``docs`` and good for nothing outside the result.
    With the default bands a pair of likeness 0.8 is missed with probability (1 - 0.8^5)^32 = 3e-6, one of 0.9 with 1e-12.
    """
    signed = cut_lineage(signatures(docs, k, bands, rows, number))
    # Rows of a group are ordered by this, nulls last.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("rid"))
    nodes = cut_lineage(signed.filter("digest is not null").groupBy("digest").agg(F.min(order).alias("top")).withColumn("node", F.col("top.rid")))
    banded = (signed.join(nodes.select(F.col("node").alias("rid")), "rid", "left_semi")
              .select(F.col("rid").alias("node"), F.col("n"), F.explode("keys").alias("key")))
    shared = banded.groupBy("key").agg(F.count("*").alias("_c")).filter("_c > 1").select("key")
    members = cut_lineage(banded.join(shared, "key"))
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", "digest", F.col("top.doc_id").alias("doc_id"))
    sets = cut_lineage(shingle_sets(docs, wanted, k))

    links = tested = comp = None
    for step in range(3):
        labelled = members.withColumn("comp", F.col("node")) if comp is None else (
            members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        if step:  # buckets that hold one group only are settled
            open_ = labelled.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo < _hi").select("key")
            labelled = labelled.join(open_, "key")
        if step < 2:
            draw = F.struct((F.col("node") if not step else F.xxhash64(F.col("node"))).alias("h"), F.col("node"), F.col("n"), F.col("comp"))
            heads = labelled.groupBy("key").agg(F.min(draw).alias("head")).select("key", "head")
            pairs = (labelled.join(heads, "key").filter(F.col("comp") != F.col("head.comp")).filter(close(F.col("n"), F.col("head.n"), percent))
                     .select("node", F.col("head.node").alias("other")))
            pairs = pairs.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()
        else:
            unsettled = cut_lineage(labelled.select("node", "comp", "n").distinct().join(sets, "node"))
            pairs = prefix_pairs(unsettled, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = cut_lineage(pairs)
        found = cut_lineage(confirmed(pairs, sets, percent))
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            comp = components(links)
        tested = pairs if tested is None else tested.union(pairs)
    tops = nodes.select("node", "digest", "top")
    if comp is not None:
        grouped = tops.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        best = grouped.groupBy("comp").agg(F.min("top").alias("best"))
        tops = grouped.join(best, "comp").select("digest", "best")
    else:
        tops = tops.select("digest", F.col("top").alias("best"))
    out = signed.join(tops, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
                      F.coalesce(F.col("best.rid") == F.col("rid"), F.lit(True)).alias("kept"), "rid")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns.

    The rows are written once with their numbers, below the scratch path: a second reading may be split otherwise and number them anew.
    """
    path = scratch_path(docs.sparkSession, "numbered")
    docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")).write.parquet(path)
    numbered = docs.sparkSession.read.parquet(path)
    seen = numbered.select("row.doc_id", "row.text", "number")
    gone = cut_lineage(near_duplicates(seen, k, percent, number=F.col("number")).filter(~F.col("kept")).select("rid"))
    return keep_listed(numbered, gone, "number", "left_anti").select("row.*")
