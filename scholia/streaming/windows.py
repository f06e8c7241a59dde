"""Windowed and keyed streaming aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators.reports import path_bucket
from scholia.operators.retrieval import embed_corpus
from scholia.sources.writers import replace_buckets


def offered_load(requests: DataFrame, window: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Requests per key in sliding windows, accepted or not."""
    return (requests.withWatermark("ts", late).groupBy("key", F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n"))
            .select("key", F.col("w.start").alias("window_start"), "n"))


TASK = "task_id bigint, event_id bigint, status string, progress bigint, message string, updated_at timestamp"


def newest_updates(updates: DataFrame) -> DataFrame:
    """Newest state of each task, with the update that brought it."""
    clamp = F.least(F.greatest(F.coalesce("progress", F.lit(0)), F.lit(0)), F.lit(100))
    row = F.struct("event_id", "status", clamp.cast("bigint").alias("progress"), "message", F.col("ts").alias("updated_at"))
    return updates.groupBy("task_id").agg(F.max_by(row, F.struct("ts", "event_id")).alias("r")).select("task_id", "r.*")


def log_newest(path: str):
    """Batch function that adds the newest state of each task of the batch to a log, one folder per batch. Nothing is kept in state, no batch
    touches what others wrote, and one that is run again writes the same folder."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        newest_updates(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return apply


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """Newest state of each task over all batches. Replayed and late updates change nothing, since the newest wins."""
    log = spark.read.schema(TASK + ", batch int").parquet(path)
    row = F.struct("status", "progress", "message", "updated_at")
    return log.groupBy("task_id").agg(F.max_by(row, F.struct("updated_at", "event_id")).alias("r")).select("task_id", "r.*")


def request_metrics(requests: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    ms = F.greatest(F.col("duration_ms").cast("long"), F.lit(0))
    return (requests.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), path_bucket(F.col("path")).alias("bucket"), "status")
            .agg(F.count("*").alias("n"), F.sum(ms).alias("ms"))
            .select(F.col("w.start").alias("window_start"), "bucket", "status", "n", F.bround(F.col("ms") / F.col("n"), 2).alias("avg_ms")))


def study_daily(sessions: DataFrame, late: str = "1 day") -> DataFrame:
    rest = F.lower("session_type").contains("break")
    minutes = F.coalesce("duration_minutes", F.lit(0))
    return (sessions.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day").alias("w"))
            .agg(F.sum(F.when(rest, 0).otherwise(minutes)).alias("study_minutes"), F.sum(F.when(rest, minutes).otherwise(0)).alias("break_minutes"),
                 F.count("*").alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd").alias("date"), "study_minutes", "break_minutes", "n"))


def active_sessions(activity: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Activity extends a session by the gap."""
    return (activity.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
            .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events"))


def event_audit(events: DataFrame) -> DataFrame:
    """Audit rows with their ``k=v; k=v`` details taken apart; a part without ``=`` is the reason."""
    parts = F.filter(F.split("details", "; "), lambda p: p.contains("="))
    details = F.str_to_map(F.array_join(parts, ";"), F.lit(";"), F.lit("="))
    rest = F.array_join(F.filter(F.split("details", "; "), lambda p: ~p.contains("=")), "; ")
    return events.select("user_id", "action", details["email"].alias("email"), details["status"].alias("status"),
                         F.nullif(rest, F.lit("")).alias("reason"), "ts")


CHUNKS = "resource_id bigint, chunk_index int, text string, position int, embedding array<float>"


def embed_changes(table_path: str):
    """Batch function that rebuilds the chunks of changed resources in a versioned, bucketed table.

    The newest text of a resource within the batch counts; one that is blank or null by then loses its chunks. A batch that is run again writes
    the same version.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        docs = batch.groupBy("doc_id").agg(F.max_by("text", "version").alias("text"))
        replace_buckets(table_path, embed_corpus(docs), docs.select(F.col("doc_id").alias("resource_id")), "resource_id", batch_id)
    return apply
