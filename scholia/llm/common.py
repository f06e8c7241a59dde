"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Arrow batches in slices of ``SLICE`` rows, one out for each: no state is carried, so a lost task is simply run again, and
    executors and workers hold what one slice needs. The session's limit of rows per Arrow batch is lowered to that, if larger.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(ARROW_ROWS)) <= SLICE:
        conf.set(ARROW_ROWS, SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield fn(batch.slice(at, SLICE))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


SLICE, ARROW_ROWS = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"

_HELD: dict[tuple, Any] = {}


def held(make: Callable[..., Any], *key: Any) -> Any:
    """``make(*key)``, kept by a Python worker over its tasks until another one is asked for: a worker serves many operators, and
    their tables must not add up."""
    name = (make, *key)
    if name not in _HELD:
        release()
        _HELD[name] = make(*key)
    return _HELD[name]


def release() -> None:
    """For operators that hold nothing: what others have left in this worker goes."""
    _HELD.clear()


class Named:
    """A broadcast value that equals another of the same name."""

    def __init__(self, spark: SparkSession, value: Any) -> None:
        self.name, self.sent = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Named) and other.name == self.name

    def __hash__(self) -> int:
        return hash(self.name)


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` as a new table in the shared folder: computed once, and there for whoever reads it after an executor is lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL_KEYS = 1_000_000


def keep_listed(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Rows whose ``on`` occurs in ``keys`` (written already, one row per value), nulls included; with ``left_anti`` the other rows.

    Up to a million keys are sent to the executors (some 30 MB); more are joined by a shuffle.
    """
    listed = keys.select(F.col(keys.columns[0]).alias("_listed"))
    if listed.limit(SMALL_KEYS + 1).count() <= SMALL_KEYS:
        listed = F.broadcast(listed)
    return df.join(listed, F.col(on).eqNullSafe(F.col("_listed")), how)


def running_sums(df: DataFrame, order: str, values: list[str], span: int, after: bool = False) -> DataFrame:
    """Adds ``<value>_before`` (or ``_after``): the sum over all rows whose integer ``order`` is smaller (larger).

    ``order`` is unique. Rows are cut into spans of the order; one window runs within spans and one over
    the span totals, so no task holds more than a span or the list of spans.
    """
    way = (lambda c: F.col(c).desc()) if after else F.col
    suffix = "after" if after else "before"
    df = df.withColumn("_span", F.floor(F.col(order) / span))
    totals = df.groupBy("_span").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    # A second level keeps the window over span totals as small: it sees one row per span * span values.
    totals = totals.withColumn("_top", F.floor(F.col("_span") / span))
    tops = totals.groupBy("_top").agg(*[F.sum(f"_{v}").alias(f"_{v}") for v in values])
    over_tops = Window.partitionBy(F.lit(0)).orderBy(way("_top")).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_top", *[F.coalesce(F.sum(f"_{v}").over(over_tops), F.lit(0)).alias(f"_top_{v}") for v in values])
    over_spans = Window.partitionBy("_top").orderBy(way("_span")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_top", "_span", *[F.coalesce(F.sum(f"_{v}").over(over_spans), F.lit(0)).alias(f"_in_{v}") for v in values])
    shifts = totals.join(tops, "_top").select("_span", *[(F.col(f"_in_{v}") + F.col(f"_top_{v}")).alias(f"_shift_{v}") for v in values])
    within = Window.partitionBy("_span").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({f"_own_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}).join(shifts, "_span")
    return out.select(*[c for c in df.columns if c != "_span"],
                      *[(F.col(f"_own_{v}") + F.col(f"_shift_{v}")).alias(f"{v}_{suffix}") for v in values])
