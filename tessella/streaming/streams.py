"""Streaming counterparts of polling: folders, event folding under a watermark, backfill batches, a job table."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def folder_stream(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """New files of a folder as they come (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(root)


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A Parquet folder as a stream of its files."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def folded(events: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("event_type",), window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Repeats of a window in one row; rows later than the watermark are left out, state is bounded by it."""
    w = F.window(time, window)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))


def in_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch goes through step once; what is there now, then the query ends (run it again for more)."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watched(spark: SparkSession, root: str, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "10 seconds", pattern: str = "*") -> StreamingQuery:
    """New files of a folder go through step in batches: every so often until the query is stopped, or with None what is there now.

    Stopping it loses nothing: finished batches are in the checkpoint, and the
    next run goes on behind them.
    """
    writer = folder_stream(spark, root, pattern).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def backfill_step(embed: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], retries: int = 5, wait: float = 60.0) -> Callable[[DataFrame, int], None]:
    """A step for in_batches that embeds chunks and writes them, tried again so often if the provider fails."""

    def step(batch: DataFrame, _: int) -> None:
        for turn in range(retries + 1):
            try:
                return write(embed(batch))
            except Exception:
                if turn == retries:
                    raise
                time.sleep(wait)

    return step


#: Minutes between two polls of a source, by its kind; others are not polled.
POLLS = {"jira": 15, "folder": 60}


def due_sources(sources: DataFrame, now: Column, polls: dict[str, int] | None = None) -> DataFrame:
    """Enabled sources (connector, last_sync) whose poll is due; one that never ran is."""
    every = F.create_map(*[F.lit(x) for kv in (POLLS if polls is None else polls).items() for x in kv])[F.col("connector")]
    waited = F.unix_timestamp(now) - F.unix_timestamp("last_sync")
    return sources.where(F.col("enabled") & (every > 0) & (F.col("last_sync").isNull() | (waited >= every * 60)))


def changed_listing(now: DataFrame, before: DataFrame) -> DataFrame:
    """rel and change (added, changed, removed) between two listings; an empty new listing changes nothing."""
    a = now.select("rel", F.struct("mtime_ms", "size").alias("_n"))
    b = before.select("rel", F.struct("mtime_ms", "size").alias("_b"))
    some = now.agg((F.count("*") > 0).alias("_some"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_n") != F.col("_b"), "changed")
    found = a.join(b, "rel", "full_outer").select("rel", change.alias("change")).where("change IS NOT NULL")
    return found.join(F.broadcast(some)).where("_some").drop("_some")  # one row


def admit_jobs(jobs: DataFrame, running: int = 2) -> DataFrame:
    """Queued jobs that may start: oldest first, one per source, none for a source that runs, at most so many at once."""
    busy = jobs.where("status = 'running'")
    free = jobs.where("status = 'queued'").join(busy.select("source_id"), "source_id", "left_anti")
    first = free.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("job_id"))).where("_n = 1")
    place = first.withColumn("_p", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("job_id")))
    count = busy.agg(F.count("*").alias("_busy"))
    return place.join(F.broadcast(count)).where(F.col("_p") + F.col("_busy") <= running).select("job_id", "source_id")  # one row


def last_queries(log: DataFrame, most: int = 20) -> DataFrame:
    """The latest queries of the log."""
    return log.orderBy(F.desc("at"), F.desc("id")).limit(most)
