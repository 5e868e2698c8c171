"""Event streams: daily and per-store counts and figures, distinct sessions within a watermark, and upserts in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.records import property_or
from ..operators.upsert import upserted
from ..sources import buckets


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def daily_counts(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events by day. With ``late``, days that are older than the latest event by more are closed, and events for them lost;
    without it none is, and the state is a row for each day."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n_events")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n_events")


def store_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(property_or(F.col("props"), "k", "unknown").alias("store")).agg(F.count(F.lit(1)).alias("n"))


def store_stats(events: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Counts of each kind of event by store and the store's name in its first event, whatever order they come in.

    A row of state for each store; each task merges its events of a store before they move, so a busy one is no burden.
    """
    counts = [F.count_if(F.col("event") == kind).alias(name) for name, kind in kinds.items()]
    of_kind = events.where(F.col("event").isin(*kinds.values()))
    return of_kind.groupBy(property_or(F.col("props"), "k", "unknown").alias("store")).agg(F.min_by("name", F.struct("ts", "event_id")).alias("store_name"), *counts)


def distinct_sessions(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first event of each session within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id"])


def each_batch(out: DataFrame, mode: str, checkpoint: str, f: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run to the end of what is there, a batch at a time."""
    return out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(f).start()


def latest(spark: SparkSession, out: DataFrame, key: str, folder: str, mode: str = "update") -> DataFrame:
    """Run a stream with available data and give the last value of each key.

    Batches are written as tables numbered by batch, so a repeated batch replaces its own table.
    """
    query = each_batch(out, mode, f"{folder}/checkpoint", lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    query.awaitTermination()
    found = spark.read.parquet(f"{folder}/out/*")
    values = [c for c in found.columns if c not in (key, "_batch")]
    return found.groupBy(key).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(key, "v.*")


def last_rows(batch: DataFrame, order: str | None = None) -> DataFrame:
    """Of rows with one handle the last by ``order``, of equal ones (and without an order) the greatest by all columns."""
    row = F.struct(*batch.columns)
    return batch.groupBy("handle").agg(F.max_by(row, F.struct(order, row) if order else row).alias("r")).select("r.*")


def upsert_stream(changes: DataFrame, root: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Apply each micro-batch of rows to the newest snapshot under ``root`` and write the next one (numbered by batch).

    Each snapshot is the whole table; :func:`upsert_buckets` writes only what a batch touches. Of a batch's rows with one
    handle one counts (see :func:`last_rows`), so a repeated batch gives the same snapshot.
    """

    def apply(batch: DataFrame, n: int) -> None:
        existing = batch.sparkSession.read.parquet(f"{root}/v={n:08d}")
        upserted(existing, last_rows(batch, order)).write.mode("overwrite").parquet(f"{root}/v={n + 1:08d}")

    return each_batch(changes, "append", checkpoint, apply)


def upsert_buckets(changes: DataFrame, root: str, checkpoint: str, order: str | None = None, writer: str = "stream") -> StreamingQuery:
    """Apply each micro-batch of rows to the bucketed table at ``root`` (see ``sources.buckets``), each batch once.

    ``writer`` names the stream: batches of one name are told apart by their numbers, so another checkpoint needs another.
    """

    def apply(batch: DataFrame, n: int) -> None:
        buckets.apply(batch.sparkSession, root, last_rows(batch, order), upserted, writer, n)

    return each_batch(changes, "append", checkpoint, apply)
