"""I-Match fingerprints over randomised lexicons.

The lexicon is the terms whose document frequency lies within a band, given as shares of all documents. A text is reduced to its distinct lexicon terms,
sorted. Seeded hashes put each term into several random subsets of the lexicon, of a few densities; every subset hashes the terms of
the text that it holds, in order. Texts that share their band terms agree in all subsets; texts that share most of them agree in
most sparse subsets, so the share of agreeing subsets is a likeness. A text without a lexicon term is fingerprinted on all of its terms.

Scale: document frequencies are counted in tasks and summed by term. A lexicon has at most (mean distinct terms of a document) /
(lower share) terms however many documents there are; it is counted, checked against ``LARGEST`` and broadcast as that. The next document is found by
one range shuffle on doc_id; only the first row of each partition travels apart.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh32_hexdigest

from scholia.llm.common import Named, held, map_batches

BAND = (0.0005, 0.1)
LARGEST = 2_000_000
#: One subset per entry: it takes a term with probability 2^-entry.
SUBSETS = tuple(density for density in range(1, 10) for _ in range(8))
_BREAKS = bytes(32 if c < 48 or 58 <= c < 97 or 123 <= c < 128 else c for c in range(256))
FLUSH = 600_000


def terms(text: str) -> set[bytes]:
    """Distinct runs of letters a-z, digits and non-ASCII characters, A-Z in lower case."""
    return set(text.encode("utf-8", "replace").lower().translate(_BREAKS).split())


def memberships(term: bytes) -> tuple[int, ...]:
    """The subsets that hold the term: one of density d takes it if d bits of its seeded hash are zero."""
    h = [xxh3_64_intdigest(term, seed) for seed in range(8)]
    return tuple(k for k, d in enumerate(SUBSETS) if not (h[k % 8] >> (6 * d)) & ((1 << d) - 1))


class Lexicon:
    """The terms of a lexicon with the subsets that hold each, looked up when first met."""

    def __init__(self, terms_: list[bytes]) -> None:
        self.held: dict[bytes, tuple[int, ...] | None] = dict.fromkeys(terms_)

    def own(self, found: set[bytes]) -> list[tuple[bytes, tuple[int, ...]]]:
        out = []
        for t in self.held.keys() & found:
            subsets = self.held[t]
            if subsets is None:
                subsets = self.held[t] = memberships(t)
            out.append((t, subsets))
        return sorted(out) or sorted((t, memberships(t)) for t in found)


def fingerprint(text: str, lexicon_: Lexicon) -> str:
    """Eight hex digits per subset, "-" where it holds no term of the text, joined by dots; all subsets are empty for a text without terms."""
    rows: list[list[bytes]] = [[] for _ in SUBSETS]
    for t, subsets in lexicon_.own(terms(text)):
        for k in subsets:
            rows[k].append(t)
    return ".".join([xxh32_hexdigest(b"\n".join(r), k) if r else "-" for k, r in enumerate(rows)])


def likeness(a: str, b: str) -> float:
    """Weighted share of agreeing subsets among those not empty on both sides; 1 for two texts without terms.

    A subset weighs by how few terms it can hold: dense ones change with any edit, so each density counts half as much as the next sparser.
    """
    if a == b:
        return 1.0
    same = full = 0.0
    for x, y, d in zip(a.split("."), b.split("."), SUBSETS):
        if x != "-" or y != "-":
            full += 1 << d
            same += (1 << d) * (x == y)
    return round(same / full, 9) if full else 1.0


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, df over all documents; tasks send sums over what they have seen, flushed as soon as that is large."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(terms(t.as_py() or ""))
                if len(seen) >= FLUSH:
                    yield sums(seen)
                    seen.clear()
        yield sums(seen)

    def sums(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(count, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> list[bytes]:
    """Terms that occur in at least band[0] (and in two documents) and at most band[1] of the documents."""
    n = docs.count()
    low, high = max(2, math.ceil(band[0] * n)), band[1] * n
    rows = document_frequencies(docs).filter((F.col("df") >= low) & (F.col("df") <= high)).select("term").limit(LARGEST + 1).collect()
    if len(rows) > LARGEST:
        raise ValueError(f"the band {band} holds more than {LARGEST} terms; raise its lower share")
    return [bytes(r[0]) for r in rows]


def _received(named: Named) -> Lexicon:
    return Lexicon(named.sent.value)


def shipped(df: DataFrame, words: list[bytes]):
    """A function that gives the lexicon inside a task; each worker builds it once."""
    sent = Named(df.sparkSession, words)
    return lambda: held(_received, sent)


def fingerprints(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """doc_id and fingerprint of the whole text of every row; null texts are empty."""
    get = shipped(docs, words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = get()
        out = [fingerprint(t.as_py() or "", own) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """The rows dealt out in parts of consecutive doc_ids, sorted, each part followed by the first row of the next one.

    part, wrap, doc_id, halo, packed (the compressed text): halo rows are the copies that follow a part; the last part is followed by the very
    first row (wrap). There are eight parts for each shuffle partition, so hashing parts deals them evenly. Parts come from quantiles
    of doc_id. Nulls come first; ties of doc_id are in the order of their compressed texts.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / (8 * tasks) for i in range(1, 8 * tasks)]
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", shares, 100 * tasks)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))

    def part_of(column: pa.Array) -> np.ndarray:
        known = column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return np.searchsorted(bounds, known, side="right")

    def parts(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(part_of(batch.column(0)), pa.int64())], names=["doc_id", "part"])

    lowest = F.min(F.struct("doc_id"))  # a struct, as nulls count as smallest
    heads = sorted((r["part"], r["low"]["doc_id"]) for r in map_batches(ids, parts, "doc_id bigint, part bigint").groupBy("part").agg(lowest.alias("low")).collect())
    # For each first id: the part that it follows, and whether that is around the end.
    follows: dict[int | None, list[tuple[int, int]]] = {}
    for i, (_, low) in enumerate(heads):
        before = heads[i - 1][0]
        follows.setdefault(low, []).append((before, int(i == 0)))

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3).compress
        rows = []
        for part, doc_id, text in zip(part_of(batch.column(0)).tolist(), batch.column(0).to_pylist(), batch.column(1)):
            packed = pack((text.as_py() or "").encode("utf-8", "surrogatepass"))
            rows.append((part, 0, doc_id, 0, packed))
            rows += [(before, wrap, doc_id, 1, packed) for before, wrap in follows.get(doc_id, ())]
        columns = zip(*rows)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "wrap", "doc_id", "halo", "packed"])

    dealt = map_batches(docs.select("doc_id", "text"), deal, "part bigint, wrap int, doc_id bigint, halo int, packed binary")
    return dealt.repartition(tasks, "part").sortWithinPartitions("part", "wrap", F.col("doc_id").asc_nulls_first(), "halo", "packed")


def edited_fingerprints(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text is the text whose last floor(n_chars / 2) code points are replaced by the first as many, or all, of the next document. A
    table of one row is followed by itself; an empty table gives no rows.
    """
    get = shipped(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unpack, last = get(), zstandard.ZstdDecompressor().decompress, None
        for batch in batches:
            rows = []
            for part, doc_id, halo, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                text = unpack(packed.as_py()).decode("utf-8", "surrogatepass")
                print_ = fingerprint(text, own)
                if last and last[0] == part:
                    rows.append(compared(*last[1:], text, print_, own))
                last = None if halo else (part, doc_id, text, print_)
            if rows:
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def compared(doc_id, text: str, print_: str, next_text: str, next_print: str, own: Lexicon) -> tuple:
        half = len(text) // 2
        edited = text[:len(text) - half] + next_text[:half]
        edited_print = fingerprint(edited, own)
        return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_, edited_print,
                likeness(print_, edited_print), likeness(print_, next_print))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return in_order(docs).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                          "near_edited double, near_next double")
