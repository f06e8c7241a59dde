"""Start a streaming query over files that are there, wait for it, read what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.session import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1000) -> DataFrame:
    """A supplied table as a stream; event times become zoned, because watermarks need them so."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{sf_dir}/{name}[.]parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in s.columns else s


def plain_time(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


class Feed:
    """A supplied table of events as a stream that can be closed.

    ``close`` adds records far beyond the last event, one for each value of ``kinds``. They move the watermark past all that came before, so windows
    close, timers ring and waiting rows come out; nothing that they start themselves is ever reached.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, name: str = "events", kinds: str = "event_type", beyond: str = "400 days", max_files: int = 1000,
                 files: DataFrame | None = None) -> None:
        self.table, self.kinds, self.beyond = spark.read.parquet(f"{sf_dir}/{name}.parquet"), kinds, beyond
        self.folder = scratch_path(spark, f"{name}-closing")
        self.table.limit(0).write.parquet(self.folder)
        late = spark.readStream.schema(self.table.schema).parquet(self.folder)
        files = stream_table(spark, sf_dir, name, max_files) if files is None else files
        self.stream = files.withColumn("ts", F.col("ts").cast("timestamp")).unionByName(late.withColumn("ts", F.col("ts").cast("timestamp")))

    def close(self) -> None:
        rest = [c for c in self.table.columns if c not in ("ts", self.kinds)]
        last = F.broadcast(self.table.agg(F.max("ts").alias("ts")))  # one row
        one = self.table.groupBy(self.kinds).agg(F.first(F.struct(*rest)).alias("r")).select(self.kinds, "r.*")
        shifted = one.join(last, F.lit(True)).withColumn("ts", F.col("ts") + F.expr(f"interval {self.beyond}"))
        shifted.select(*self.table.columns).coalesce(1).write.mode("append").parquet(self.folder)


def drain(stream: DataFrame, mode: str, label: str, each: Callable[[DataFrame, int], None] | None = None, feed: Feed | None = None) -> DataFrame:
    """Run to the end of the input, close the ``feed`` if there is one, and run to the end again. Appended results add to the sink."""
    spark = stream.sparkSession
    path, check = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", check)
        writer = writer.foreachBatch(each) if each is not None else writer.format("parquet").option("path", path)
        if feed is None:
            writer.trigger(availableNow=True).start().awaitTermination()
        else:
            query = writer.trigger(processingTime="0 seconds").start()
            query.processAllAvailable()
            feed.close()
            query.processAllAvailable()
            query.stop()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(path) if each is None else None
