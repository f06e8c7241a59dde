"""Toxicity by averaged subword embeddings under a linear softmax, both trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (word ends marked), so a misspelt word shares most of a known one; a linear softmax over
toxic and clean turns it into a logit. Labels belong to whole texts, so a text's logit is the soft maximum over its distinct words, which a few insults in
a very long text still lift. Training anneals from the plain mean over words to that maximum. Words are cut at white space and most
punctuation, A-Z in lower case.

Scale: class counts cover all labelled rows. The fit takes at most ``SAMPLE`` rows per class (those whose ids have the smallest hashes), which
tasks first turn into bags of all their distinct words. The driver gets these bags and nothing else; ``SAMPLE`` bounds them. The
model is one number per bucket and is broadcast. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import Named, held, keep_listed, map_batches
from scholia.session import cut_lineage

BUCKETS, DIM, GRAMS = 1 << 16, 8, (3, 4, 5)
SAMPLE = 1500
EPOCHS, RATE, DECAY, COLDEST = 100, 0.05, 0.01, 0.5
REMEMBERED = 100_000
_BREAKS = bytes(32 if c < 33 or chr(c) in "\"#%&'()+,-./:;<=>?[\\]^_`{|}~" else c for c in range(256))


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "replace").lower().translate(_BREAKS).split())


def gram_buckets(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram of the words, and whose it is."""
    buffer = np.frombuffer(b"<" + b"><".join(found) + b">", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 2
    owner = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
    buckets, owners = [], []
    for n in GRAMS:
        if len(buffer) < n:
            continue
        h = np.full(len(buffer) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(1099511628211) + buffer[i:i + len(h)] + np.uint64(1)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        inside = owner[:len(h)] == owner[n - 1:]
        buckets.append((h >> np.uint64(48)).astype(np.int32)[inside])
        owners.append(owner[:len(h)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


class Model:
    """Vectors of the buckets and the softmax; ``logits`` needs only their product."""

    def __init__(self, gains: np.ndarray, bias: float) -> None:
        self.gains, self.bias = gains, bias
        self.known: dict[bytes, float] = {}
        self.older: dict[bytes, float] = {}

    def logits(self, found: list[bytes]) -> np.ndarray:
        bucket, owner = gram_buckets(found)
        return np.bincount(owner, self.gains[bucket], len(found)) / np.bincount(owner, minlength=len(found))

    def scores(self, texts: list[str | None]) -> list[float]:
        bags = [words(t) for t in texts]
        known, older = self.known, self.older
        if new := [w for w in set().union(*bags) if w not in known]:
            fresh = [w for w in new if w not in older]
            known.update((w, older[w]) for w in new if w in older)
            if fresh:
                known.update(zip(fresh, self.logits(fresh).tolist()))
        out = []
        for bag in bags:
            z = 0.0
            if bag:
                zs = np.fromiter(map(known.__getitem__, sorted(bag)), float, len(bag))
                a = np.exp((zs - zs.max()) / COLDEST)
                z = float(a @ zs / a.sum())
            out.append(round(1 / (1 + math.exp(-max(-500.0, min(500.0, z + self.bias)))), 9))
        if len(known) > REMEMBERED:
            self.known, self.older = {}, known
        return out


def fit(bags: Iterable[list[bytes]], toxic: list[int], shares: tuple[float, float]) -> Model:
    """Full-batch Adam on bucket vectors and softmax together. ``shares`` of both classes among all labelled rows set the bias right, as the
    sample's differ. Without rows of both classes there is nothing to learn, and every score is 0."""
    y = np.array(toxic, float)
    prior = math.log(shares[1] / shares[0])
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), -500.0)
    # Words become numbers bag by bag, so the bags themselves are never held together.
    index: dict[bytes, int] = {}
    sizes, numbers = [], array("i")
    for bag in bags:
        sizes.append(len(bag))
        numbers.extend([index.setdefault(w, len(index)) for w in bag])
    word, doc = np.frombuffer(numbers, np.int32), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    bucket, owner = gram_buckets(list(index))
    per_word = np.bincount(owner, minlength=len(index)).astype(float)
    rng = np.random.default_rng(7)
    vectors, soft, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    used = np.unique(bucket)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, soft, bias)]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for epoch in range(EPOCHS):
        u = soft[:, 1] - soft[:, 0]
        z_word = np.bincount(owner, (vectors @ u)[bucket], len(index)) / per_word
        cold = (EPOCHS - epoch) / EPOCHS * 4
        cold = COLDEST if cold < COLDEST else (math.inf if epoch < EPOCHS // 8 else cold)
        z = z_word[word]
        top = np.full(len(y), -np.inf)
        np.maximum.at(top, doc, z)
        a = np.exp((z - top[doc]) / cold)
        a /= np.bincount(doc, a, len(y))[doc]
        p = 1 / (1 + np.exp(-(np.bincount(doc, a * z, len(y)) + bias[1] - bias[0])))
        error = (p - y) * weight
        g_word = np.bincount(word, error[doc] * a, len(index)) / per_word
        g_bucket = np.bincount(bucket, g_word[owner], BUCKETS)
        g_u = vectors[used].T @ g_bucket[used]
        g_b = error.sum()
        grads = (np.outer(g_bucket, u) + DECAY * vectors / len(y), np.stack([-g_u, g_u], 1), np.array([-g_b, g_b]))
        for param, grad, (m, v) in zip((vectors, soft, bias), grads, state):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= RATE * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-8)
    gains = np.zeros(BUCKETS)
    gains[used] = vectors[used] @ (soft[:, 1] - soft[:, 0])
    return Model(gains, float(bias[1] - bias[0]) + prior)


def held_out():
    """Rows whose labels are never looked at; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from labels(doc_id, toxic) outside the held-out part. Null labels and ids are left out; a doc_id with several labels is toxic if one says so."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = cut_lineage(known)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values()) + 2
    chosen = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = cut_lineage(chosen[0].union(chosen[1]))

    def bags(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [b" ".join(sorted(words(t.as_py()))) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "bag"])

    taken = map_batches(keep_listed(docs.select("doc_id", "text"), chosen.select("doc_id"), "doc_id"), bags, "doc_id bigint, bag binary")
    rows = taken.join(F.broadcast(chosen), "doc_id").filter("octet_length(bag) > 0").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit((bytes(r["bag"]).split() for r in rows), [r["toxic"] for r in rows],
               ((counts.get(0, 0) + 1) / total, (counts.get(1, 0) + 1) / total))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every row; null texts are empty, and an empty text gets the prior alone."""
    shipped = Named(docs.sparkSession, (model.gains, model.bias))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _model(shipped)
        texts = batch.column(1)
        out: list[float] = []
        for at in range(0, len(texts), 200):
            out += own.scores(texts.slice(at, 200).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _received(shipped: Named) -> Model:
    return Model(*shipped.sent.value)


def _model(shipped: Named) -> Model:
    """One per worker and model, so that known words outlive a task."""
    return held(_received, shipped)


def keep_clean(docs: DataFrame, model: Model, at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``at_least``, with all their columns."""
    shipped = Named(docs.sparkSession, (model.gains, model.bias))
    place = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _model(shipped)
        keep: list[bool] = []
        for at in range(0, batch.num_rows, 200):
            keep += [s < at_least for s in own.scores(batch.column(place).slice(at, 200).to_pylist())]
        return batch.filter(pa.array(keep))

    return map_batches(docs, run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
