"""Vector expressions, the default encoder, and exact top-k search in blocks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIM = 64


def dot(a: Column, b: Column) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_zero(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.coalesce(cosine_raw(a, b), F.lit(0.0))


def cosine_raw(a: Column, b: Column) -> Column:
    """NULL where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_percent(a: Column, b: Column) -> Column:
    """Guarded by a tiny term in the denominator, in percent with one decimal, half to even."""
    return F.bround(dot(a, b) / (norm(a) * norm(b) + F.lit(1e-9)) * 100, 1)


# -- encoders ----------------------------------------------------------------------------------

Encoder = Callable[[list[str]], np.ndarray]


@lru_cache(maxsize=200_000)
def _slot(token: str, dim: int) -> tuple[int, float]:
    h = hashlib.md5(token.encode()).digest()
    return int.from_bytes(h[:4], "big") % dim, 1.0 if h[4] % 2 == 0 else -1.0


def hashing_encoder(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Signed feature hashing of lower-case words, unit length: works offline and is deterministic."""
    out = np.zeros((len(texts), dim))
    for row, text in enumerate(texts):
        for token in re.findall(r"\w+", (text or "").lower()):
            i, sign = _slot(token, dim)
            out[row, i] += sign
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def embed(df: DataFrame, text: str, encoder: Encoder = hashing_encoder, name: str = "embedding") -> DataFrame:
    """Adds the vector of a text column, one encoder call per Arrow batch. Scales by ``df``'s partitions."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).fill_null("").to_pylist()
            vectors = encoder(texts).astype("float32")
            offsets = pa.array(np.arange(len(texts) + 1, dtype="int32") * vectors.shape[1])
            column = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(encode, f"{schema}, `{name}` array<float>")


# -- search --------------------------------------------------------------------------------------


def topk_one(items: DataFrame, query: DataFrame, order: list[str], k: int) -> DataFrame:
    """Best k items for one query vector (a single row) by rounded score; equal scores in the given order."""
    one = query.limit(1).select(F.col("embedding").alias("_q"))
    scored = items.join(F.broadcast(one), F.lit(True)).withColumn("score", cosine_percent(F.col("embedding"), F.col("_q")))
    best = scored.drop("embedding", "_q").orderBy(F.col("score").desc(), *order).limit(k)
    # At most k rows reach this window.
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), *order)))


TILE = 2048


def exact_scores(a: np.ndarray, b: np.ndarray, percent: bool) -> np.ndarray:
    """Rounded cosines of the rows of a with those of b."""
    scale = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    d = np.einsum("ij,ij->i", a, b)
    return np.round(d / (scale + 1e-9) * 100, 1) if percent else np.round(np.divide(d, scale, out=np.zeros_like(d), where=scale > 0), 9)


def first_k(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every row the k highest scores, ties to the smaller column, not-a-numbers last."""
    order = np.lexsort((cols, -scores, rows))
    rows = rows[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[order][keep], scores[order][keep]


def best_pairs(a: np.ndarray, b: np.ndarray, k: int, percent: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of a, row of b, rounded cosine: for every row of a the k best of b, ties to the smaller row.

    Products in single precision, tile by tile, leave out what is clearly below the k best so far; only the rest is scored in double precision.
    Where they cannot tell (tiny lengths, components that are no numbers) everything is scored. Memory: some tiles, whatever the lengths of a and b.
    """
    lengths = [np.linalg.norm(x, axis=1) for x in (a, b)]
    least = [n[n > 0].min(initial=1.0) for n in lengths]
    # Single precision and the guard of the denominator move a cosine by less than 1e-5 each; rounding by half a step.
    margin = 3e-5 + (6e-4 if percent else 1e-8)
    plain = all(np.isfinite(n).all() for n in lengths) and least[0] * least[1] >= 1e-4 and max(n.max(initial=0.0) for n in lengths) < 1e18
    if plain:
        u, v = [np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0).astype("float32") for x, n in zip((a, b), lengths)]
    found = []
    for top in range(0, len(a), TILE // 2):
        part = a[top:top + TILE // 2]
        kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        least_of = np.full(len(part), -np.inf, np.float32)
        for at in range(0, len(b), TILE):
            if plain:
                near = u[top:top + TILE // 2] @ v[at:at + TILE].T
                if not at and near.shape[1] > k:  # both the last of the best and one below it may be rounded
                    least_of = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - np.float32(2 * margin)
                hits = np.flatnonzero(near >= least_of[:, None])
            else:
                hits = np.arange(len(part) * len(b[at:at + TILE]))
            width = len(b[at:at + TILE])
            for some in range(0, len(hits), 1 << 17):
                rows, cols = np.divmod(hits[some:some + (1 << 17)], width)
                cols += at
                scores = exact_scores(part[rows], b[cols], percent)
                kept = first_k(*[np.concatenate(x) for x in zip(kept, (rows, cols, scores))], k)
            if plain and len(hits):
                rows, _, scores = kept
                full = np.flatnonzero(np.bincount(rows, minlength=len(part)) == k)
                last = np.searchsorted(rows, full, side="right") - 1
                least_of[full] = scores[last] / (100 if percent else 1) - margin
        found.append((kept[0] + top, *kept[1:]))
    return tuple(np.concatenate(x) for x in zip(*found))


def topk_blocks(queries: DataFrame, items: DataFrame, k: int, order: list[str], group: str | None = None,
                block: int = 8192, percent: bool = True) -> DataFrame:
    """Exact best k items for every query (within the same ``group`` if given).

    ``queries``: query_id, embedding; ``items``: the ``order`` columns and embedding. Both sides are cut into
    hash blocks of about ``block`` rows, as many as the group needs, and each pair of blocks is multiplied in its own
    task, tile by tile. A cell passes on k rows per query, never its pairs, so a group
    that holds most rows only means more cells.
    """
    g = "_g"
    own = F.col(group) if group else F.lit(0)
    # Fresh aliases: both sides may come from the same table.
    fresh = lambda df, cols: df.select(own.alias(g), *[F.col(c).alias(c) for c in cols])
    queries, items = fresh(queries, ["query_id", "embedding"]), fresh(items, [*order, "embedding"])
    count = F.ceil(F.count("*") / block).cast("int")
    if group:
        sizes = queries.groupBy(g).agg(count.alias("_nq")).join(items.groupBy(g).agg(count.alias("_ni")), g)
        sized = lambda df: df.join(sizes, g)
    else:
        at_least_one = F.greatest(count, F.lit(1))
        nq, ni = queries.agg(at_least_one).scalar(), items.agg(at_least_one).scalar()
        sized = lambda df: df.withColumn("_nq", nq).withColumn("_ni", ni)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = (sized(queries).withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.col("_nq")).cast("int"))
         .withColumn("_ib", spread("_ni")).drop("_nq", "_ni"))
    i = (sized(items).withColumn("_ib", F.pmod(F.xxhash64(*order), F.col("_ni")).cast("int"))
         .withColumn("_qb", spread("_nq")).drop("_nq", "_ni"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["query_id", *order, "score"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=cols)
        right = right.sort_values(order, kind="stable").reset_index(drop=True)
        a = np.stack(left["embedding"].to_numpy()).astype("float64")
        b = np.stack(right["embedding"].to_numpy()).astype("float64")
        rows, at, scores = best_pairs(a, b, k, percent)
        out = right.loc[at, order].reset_index(drop=True)
        out.insert(0, "query_id", left["query_id"].to_numpy()[rows])
        out["score"] = scores
        return out[cols]

    types = dict(items.dtypes)
    schema = ", ".join([f"query_id {dict(queries.dtypes)['query_id']}", *[f"{c} {types[c]}" for c in order], "score double"])
    cells = q.groupBy(g, "_qb", "_ib").cogroup(i.groupBy(g, "_qb", "_ib")).applyInPandas(cell, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *order)
    return cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
