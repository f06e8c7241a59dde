"""Global shuffle into shards in two passes; native expressions only.

Pass 1 scatters the records into buckets by a seeded hash, as many as keep each near ``BYTES`` bytes and ``ROWS`` rows, and writes them, a bucket to a record.
Pass 2 reads them, shuffles each by Fisher-Yates with draws from the seed, the bucket and the step, and writes the buckets one after the other: a record's
place in that order gives its shard, a run of places, and its slot. Law ``rows``: shards differ by at most one row.

Scale: records are shuffled once and written twice. A task of pass 2 holds one bucket and writes to the one or two shards its places lie in. The hash also
takes the row's number, so equal ids or texts spread over all buckets. Offsets of buckets are summed in spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from scholia.functions.text import let
from scholia.llm.common import running_sums, stored
from scholia.session import scratch_path

# Bytes and rows of a bucket, buckets of a task, buckets of a span of offsets. The rows bound the draws, which cost their square.
SEED, BYTES, ROWS, TOGETHER, SPAN = 20240229, 4 << 20, 2048, 16, 1024


def fisher_yates(n: Column, seed: Column) -> Column:
    """A permutation of 0 .. n-1: for each place from the last one down, a draw among the places not yet settled is swapped into it."""
    def swap(order: Column, i: Column) -> Column:
        def to(j: Column) -> Column:
            # order[:j] + order[i] + order[j+1:i] + order[j] + order[i+1:]
            return F.when(j == i, order).otherwise(F.concat(
                F.slice(order, F.lit(1), j), F.array(F.get(order, i)), F.slice(order, j + 2, i - j - 1), F.array(F.get(order, j)),
                F.slice(order, i + 2, F.size(order))))
        return let(F.pmod(F.xxhash64(seed, i), i + 1).cast("int"), to)

    start = F.sequence(F.lit(0), n - 1)
    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, swap)


def size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and one."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def scatter(docs: DataFrame, seed: int = SEED, bytes_: int = BYTES, rows: int = ROWS) -> DataFrame:
    """Pass 1: bucket, n and rows (array of the whole records) of every bucket that has any, written."""
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(size(F.col("text"))), F.lit(0)).alias("bytes")).first()
    buckets = max(1, -(-total["n"] // rows), -(-total["bytes"] // bytes_))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.monotonically_increasing_id()), F.lit(buckets))
    dealt = docs.select(bucket.alias("bucket"), F.struct(*docs.columns).alias("row")).repartition(-(-buckets // TOGETHER), "bucket")
    return stored(dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.collect_list("row").alias("rows")), "buckets", compression="zstd")


def write(docs: DataFrame, path: str, shards: int = 16, seed: int = SEED, bytes_: int = BYTES, rows: int = ROWS) -> None:
    """Writes the records of ``docs`` as folders shard=0 .. of Parquet files with ``slot`` and ``row``, the record whole, so that its own columns may have any name.

    The order is fixed by the seed and the layout of the input. An empty table gives no shard; with fewer rows than shards some stay empty.
    """
    buckets = scatter(docs, seed, bytes_, rows)
    counts = buckets.select("bucket", "n")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    offsets = running_sums(counts, "bucket", ["n"], SPAN).select("bucket", F.col("n_before").alias("offset"))
    order = fisher_yates(F.size("rows"), F.xxhash64(F.lit(seed), F.col("bucket")))
    shuffled = F.transform(order, lambda j, i: F.struct(i.alias("i"), F.get("rows", j).alias("row")))
    placed = buckets.join(offsets, "bucket").select("offset", F.inline(shuffled)).withColumn("place", F.col("offset") + F.col("i"))
    # Whole numbers throughout: shard k begins at the first place p with p * shards >= k * total.
    out = placed.withColumn("shard", F.expr(f"(place * {shards}) div {max(1, total)}").cast("int"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    out.select("shard", (F.col("place") - first).alias("slot"), "row").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """shard, slot and row of what ``write`` wrote, rows as those of ``like``."""
    row = StructType([StructField("row", like.schema), StructField("slot", LongType()), StructField("shard", IntegerType())])
    return spark.read.schema(row).parquet(path)


def assign(docs: DataFrame, shards: int = 16, seed: int = SEED, bytes_: int = BYTES, rows: int = ROWS) -> DataFrame:
    """doc_id, size, text_crc32 (null: of the empty text), law, shard, slot, grown_shard (null under this law) of every record, read from written shards."""
    path = scratch_path(docs.sparkSession, "shards")
    write(docs, path, shards, seed, bytes_, rows)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return read(docs.sparkSession, path, docs).select(
        F.col("row.doc_id").alias("doc_id"), size(text).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
