"""Exact running positions that no single hot key can pin to one task.

A plain ``row_number() over (partition by key order by ...)`` sends a whole key to one task.
Here rows are range-partitioned by (key, order), which cuts a hot key into many partitions; each
partition is numbered on its own and shifted by the rows of the same key in earlier partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.session import cut_lineage


def add_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "position",
             partitions: int | None = None) -> DataFrame:
    """1-based position of every row within its key; ``order`` must end in a unique column."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys] + order
    # The partition number is part of the answer, so it is fixed in the shared folder once.
    placed = cut_lineage(df.repartitionByRange(n, *by).withColumn("_pid", F.spark_partition_id()))
    counts = placed.groupBy("_pid", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # A key shifts only where it runs over a partition edge: at most n - 1 rows, safe to broadcast.
    shifts = (counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .filter(F.col("_shift") > 0).select(F.col("_pid").alias("_p"), *[F.col(k).alias(f"_{k}") for k in keys],
                                                  "_shift"))
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_pid") == F.col("_p"))
    local = F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order))
    return (placed.withColumn(name, local.cast("long"))
            .join(F.broadcast(shifts), match, "left")
            .withColumn(name, F.col(name) + F.coalesce("_shift", F.lit(0)))
            .drop("_pid", "_p", "_shift", *[f"_{k}" for k in keys]))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key. Spark trims each input partition to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def latest(df: DataFrame, keys: list[str], order: list[str], newest: bool = True) -> DataFrame:
    """One whole row per key, by partial aggregation instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if newest else F.min_by
    return (df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]))
