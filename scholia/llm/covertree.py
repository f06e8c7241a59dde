"""Exact top-k search by integer inner product with a cover tree over queries and data together.

Top of the tree: a farthest-first traversal of a bounded sample, whose every prefix is a net (its points as far apart as it covers), gives the cells. Every
vector, query or not, goes to the cell of its nearest centre; radii are taken from all of its vectors, so bounds hold for all. A first round searches each query's
own cell. Its worst k-th score per cell then prunes pairs of cells by centres and covering radii: no product of a pair of nodes exceeds
``qc.rc + rq |rc| + rr |qc| + rq rr``. What is left goes out in tiles, a page of a query cell against a page of a data cell, and within a tile
the same goes on with a cover tree for each side, down to blocks that are multiplied.

A node has at most ``FANOUT`` children. Where a net of half its radius needs more, as among vectors of many dimensions, it is
covered less tightly and keeps its true radius: answers stay exact, and fewer pairs are pruned.

Scale: equal vectors are one, with their k + 1 smallest ids (more cannot be among the answers). A tile is the only thing that a task holds whole. The driver
sees the sample and one row per cell. Where nothing can be pruned, tiles cover all pairs of queries and data, as any exact search then must.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.ordered import top_per_key
from scholia.llm.common import map_batches, stored

# The driver holds SAMPLE vectors and at most CELLS centres.
SAMPLE, CELLS, CELL = 2048, 256, 8192
PAGE, BATCH = 16384, 2048
FANOUT, BASE, LEAF, QUERY_LEAF = 16, 2.0, 256, 64
SALTS = 8


class Node(NamedTuple):
    """Rows ``start`` to ``end`` of the tree's order, their centre (a row) and the largest distance from it."""

    start: int
    end: int
    centre: np.ndarray
    radius: float
    children: list[int]


def distances(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(rows - centre).sum(axis=1))


def net(rows: np.ndarray, most: int, within: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Farthest-first traversal from the first row until all rows are ``within`` a centre, or to ``most`` centres: their row numbers, the centre
    nearest to each row, and how far that is."""
    centres, near, far = [0], np.zeros(len(rows), np.int64), distances(rows, rows[0])
    while len(centres) < most and far.max() > within:
        new = int(far.argmax())
        d = distances(rows, rows[new])
        closer = d < far
        near[closer], far[closer] = len(centres), d[closer]
        centres.append(new)
    return np.array(centres), near, far


def cover_tree(rows: np.ndarray, leaf: int) -> tuple[np.ndarray, list[Node]]:
    """The rows' order and the nodes, the root first. Each node's first row is its centre, and that of its first child."""
    order, nodes, todo = np.arange(len(rows)), [], [(0, len(rows), -1)]
    while todo:
        start, end, parent = todo.pop()
        own = rows[order[start:end]]
        far = distances(own, own[0])
        nodes.append(Node(start, end, own[0], float(far.max()), []))
        if parent >= 0:
            nodes[parent].children.append(len(nodes) - 1)
        if end - start > leaf and far.max() > 0:
            centres, near, _ = net(own, FANOUT, far.max() / BASE)
            first = np.ones(len(own), bool)
            first[centres] = False
            by = np.lexsort((first, near))
            order[start:end] = order[start:end][by]
            at = start
            for size in np.bincount(near):
                todo.append((at, at + int(size), len(nodes) - 1))
                at += int(size)
    return order, nodes


def bound(q: np.ndarray, q_radius: np.ndarray, r: np.ndarray, r_radius: np.ndarray) -> np.ndarray:
    """At least as much as any product of a row of each query node with a row of each data node (all of the first with all of the second)."""
    top = (q @ r.T + q_radius[:, None] * np.linalg.norm(r, axis=1) + np.linalg.norm(q, axis=1)[:, None] * r_radius + q_radius[:, None] * r_radius)
    return top + 1 + 1e-9 * np.abs(top)


def dual_search(queries: np.ndarray, data: np.ndarray, ids: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, score, row of data): for each query at least those of its ``k`` best (ties to smaller ``ids``) that score its floor or more."""
    exact = len(queries) and float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, data.shape[1]) < 2**53
    q_order, q_nodes = cover_tree(queries.astype(float), QUERY_LEAF)
    r_order, r_nodes = cover_tree(data.astype(float), LEAF)
    number = float if exact else np.int64
    q, r, r_ids, floor = queries[q_order].astype(number), data[r_order].astype(number), ids[r_order], floors[q_order].copy()
    best: list[list[tuple[int, int, int]]] = [[] for _ in range(len(q))]
    leaves: dict[int, list[tuple[float, int]]] = {}
    todo = {0: [0]}
    while todo:
        after: dict[int, list[int]] = {}
        for a, others in todo.items():
            node = q_nodes[a]
            held = [r_nodes[b] for b in others]
            tops = bound(node.centre[None], np.array([node.radius]), np.array([x.centre for x in held]), np.array([x.radius for x in held]))[0]
            for b, top in zip(others, tops):
                if top < floor[node.start:node.end].min():
                    continue
                if not node.children and not r_nodes[b].children:
                    leaves.setdefault(a, []).append((top, b))
                for c in node.children or [a]:
                    if node.children or r_nodes[b].children:
                        after.setdefault(c, []).extend(r_nodes[b].children or [b])
        todo = after
    for a, found in leaves.items():
        at, end = q_nodes[a].start, q_nodes[a].end
        for top, b in sorted(found, reverse=True):
            if top < floor[at:end].min():
                break
            lo, hi = r_nodes[b].start, r_nodes[b].end
            scores = q[at:end] @ r[lo:hi].T
            for i in np.flatnonzero(scores.max(axis=1) >= floor[at:end]):
                new = np.flatnonzero(scores[i] >= floor[at + i])
                mine = best[at + i]
                mine.extend((-int(scores[i, j]), int(r_ids[lo + j]), int(r_order[lo + j])) for j in new)
                mine.sort()
                del mine[k:]
                if len(mine) == k:
                    floor[at + i] = max(floor[at + i], -mine[-1][0])
    for i, mine in enumerate(best):
        for score, _, row in mine:
            yield int(q_order[i]), -score, row


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column; all are of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(column[0])) if len(column) else np.empty((0, 0), np.int64)


def routed(df: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Adds cell and its distance ``far`` to df's ``v``. Lengths that no centre has form one cell each, numbered below zero, around the origin."""
    place = df.columns.index("v")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in batch.column(place)], np.int64)
        cell, far = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            rows = matrix(batch.column(place).take(pa.array(at))).astype(float)
            if size in centres:
                first, own = centres[size]
                cell[at] = (np.square(own).sum(axis=1) - 2 * rows @ own.T).argmin(axis=1)
                far[at] = np.sqrt(np.square(rows - own[cell[at]]).sum(axis=1))
                cell[at] += first
            else:
                cell[at], far[at] = -1 - size, np.sqrt(np.square(rows).sum(axis=1))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return map_batches(df, run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", cell bigint, far double")


def nets(sample: list[list[int]], n: int) -> dict[int, tuple[int, np.ndarray]]:
    """Per length of vectors in the sample: the number of its first cell and the centres, some CELL of the ``n`` vectors to each, CELLS at most."""
    out, first = {}, 0
    for size in sorted({len(x) for x in sample}):
        rows = np.array([x for x in sample if len(x) == size], float).reshape(sum(len(x) == size for x in sample), size)
        most = max(1, min(CELLS * len(rows) // len(sample), n * len(rows) // len(sample) // CELL))
        centres = rows[net(rows, most, 0.0)[0]]
        out[size] = (first, centres)
        first += len(centres)
    return out


def tiles(queries: DataFrame, data: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """qid, score, id: of each query the best ``k`` data vectors of each tile, with all their ids. ``pairs`` lists the cells (qcell, rcell) that meet."""
    key = ["qcell", "qpage", "rcell", "rpage"]
    pages = lambda df, size, name: df.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias(name))
    q_pages = pages(queries, BATCH, "qpages").withColumnRenamed("cell", "qcell")
    r_pages = pages(data, PAGE, "rpages").withColumnRenamed("cell", "rcell")
    # One row per pair of cells: CELLS squared at most.
    meet = F.broadcast(stored(pairs.join(q_pages, "qcell").join(r_pages, "rcell"), "pairs"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    left = (queries.join(meet, F.col("cell") == F.col("qcell")).select("qcell", own("qid", "qpages").alias("qpage"), "rcell", each("rpages").alias("rpage"), "qid", "v", "floor"))
    right = (data.join(meet, F.col("cell") == F.col("rcell")).select("qcell", each("qpages").alias("qpage"), "rcell", own("nid", "rpages").alias("rpage"), "ids", "v"))
    # Both sides hold columns of ``meet``; new names tell them apart.
    right = right.toDF("_qcell", "_qpage", "_rcell", "_rpage", "ids", "v")

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        found = []
        if mine.num_rows and theirs.num_rows:
            ids = theirs.column("ids").combine_chunks()
            lists, first = ids.to_pylist(), np.array([x[0] for x in ids.to_pylist()], np.int64)
            floors = mine.column("floor").to_numpy()
            qids = mine.column("qid").to_pylist()
            found = [(qids[i], score, lists[row]) for i, score, row in dual_search(matrix(mine.column("v")), matrix(theirs.column("v")), first, floors, k)]
        qid, score, many = zip(*found) if found else ((), (), ())
        return pa.table({"qid": pa.array(qid, pa.int64()), "score": pa.array(score, pa.int64()), "ids": pa.array(many, pa.list_(pa.int64()))})

    found = left.groupBy(*key).cogroup(right.groupBy(*[f"_{c}" for c in key])).applyInArrow(run, "qid bigint, score bigint, ids array<bigint>")
    return found.select("qid", "score", F.explode("ids").alias("id"))


def vectors(df: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: every component times ``scale``, rounded down. Rows without id, without vector, or with a component null or not finite are left out."""
    good = F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return df.filter(good).select("vec_id", F.when(good, whole).alias("v"))


def top_k(rows: DataFrame, asks: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of largest inner product, ties to smaller ids, for each row of ``rows`` (vec_id, v) that ``asks``.

    Every row but the query's own is a candidate, rows that repeat its id or vector too. Vectors of another length than the query's are not
    compared with it. Products must stay within 64 bits. An empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = stored(rows.select("vec_id", "v", asks.alias("asks")), "vectors")
    firsts = top_per_key(rows.select("v", "vec_id"), ["v"], [F.col("vec_id")], k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    data = stored(firsts.select(F.monotonically_increasing_id().alias("nid"), "ids", "v"), "distinct")
    asking = rows.filter("asks").select("v").distinct()
    self_ = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    asking = stored(asking.select(F.monotonically_increasing_id().alias("qid"), "v", self_.alias("self")), "asking")
    sample = [r["v"] for r in data.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()]
    centres = nets(sample, data.count()) if sample else {}
    data = stored(routed(data, centres), "cells")
    asking = stored(routed(asking, centres), "asking-cells")
    nothing = F.lit(float("-inf"))
    best = lambda df: top_per_key(df, ["qid"], [F.col("score").desc(), F.col("id")], k + 1).drop("rank")

    home = data.select(F.col("cell").alias("qcell")).distinct().withColumn("rcell", F.col("qcell"))
    near = stored(best(tiles(asking.withColumn("floor", nothing), data, home, k + 1)), "near")
    full = near.groupBy("qid").agg(F.when(F.count("*") == k + 1, F.min("score").cast("double")).alias("floor"))
    asking = stored(asking.join(full, "qid", "left").withColumn("floor", F.coalesce("floor", nothing)), "floors")
    pairs = surviving(centres, asking, data)
    if pairs:
        rest = tiles(asking, data, spark.createDataFrame(pairs, "qcell bigint, rcell bigint"), k + 1)
        near = best(near.unionByName(rest))
    found = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("id")))).alias("found"))

    # A vector that many queries share is repeated, and they are salted.
    spread = asking.select("qid", "v", "self", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    told = spread.join(found, "qid").drop("qid")
    mine = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    at = F.array_position("found", F.struct((-F.col("self")).alias("less"), F.col("query_id").alias("id"))).cast("int")
    others = F.when(at > 0, F.concat(F.slice("found", F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice("found", at + 1, F.lit(k)))).otherwise(F.slice("found", 1, k))
    out = mine.join(told, ["v", "salt"]).select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def surviving(centres: dict[int, tuple[int, np.ndarray]], asking: DataFrame, data: DataFrame) -> list[tuple[int, int]]:
    """Pairs of different cells of which the bound reaches the query cell's worst k-th score."""
    seen = {r["cell"]: (r["far"], r["floor"]) for r in asking.filter("cell >= 0").groupBy("cell").agg(F.max("far").alias("far"), F.min("floor").alias("floor")).collect()}
    there = {r["cell"]: r["far"] for r in data.filter("cell >= 0").groupBy("cell").agg(F.max("far").alias("far")).collect()}
    out = []
    for first, own in centres.values():
        numbers = range(first, first + len(own))
        q, r = [c for c in numbers if c in seen], [c for c in numbers if c in there]
        if q and r:
            tops = bound(own[[c - first for c in q]], np.array([seen[c][0] for c in q]), own[[c - first for c in r]], np.array([there[c] for c in r]))
            keep = (tops >= np.array([seen[c][1] for c in q])[:, None]) & (np.array(q)[:, None] != np.array(r)[None])
            out += [(q[i], r[j]) for i, j in zip(*map(list, np.nonzero(keep)))]
    return out
