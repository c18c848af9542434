"""Pending changes: a journal keyed by path, kept up by a stream and acknowledged by a rebuild.

The batch functions define the journal; the stream keeps the same state with
Structured Streaming.  The watermark is a sequence number, not an event time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(events: DataFrame, key: str, seq: str, seen: str) -> DataFrame:
    """(key, first_seq, latest_seq, first_seen, latest_seen) per path with any change; null paths are no changes."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(seq).alias("first_seq"), F.max(seq).alias("latest_seq"), F.min(seen).alias("first_seen"), F.max(seen).alias("latest_seen"))


def acknowledge(journal: DataFrame, snapshot: DataFrame, key: str, watermark: int, unparsed: DataFrame | None = None) -> DataFrame:
    """The journal without what a rebuild from ``snapshot`` has done: paths up to the watermark that weren't touched again and could be parsed."""
    done = snapshot.where(F.col("latest_seq") <= watermark).select(key, F.col("latest_seq").alias("_seq"))
    if unparsed is not None:
        done = done.join(unparsed.select(key).distinct(), key, "left_anti")
    matched = journal.join(done, key, "left")
    return matched.where(F.col("_seq").isNull() | (F.col("_seq") != F.col("latest_seq"))).drop("_seq")


def pending_stream(stream: DataFrame, key: str = "path", seq: str = "seq", seen: str = "seen_ms") -> DataFrame:
    """The journal of a streaming input, for output mode update or complete; its state has one row per path."""
    return pending(stream, key, seq, seen)


def start_sync(stream: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = "100 milliseconds"):
    """Starts the debounced rebuild: each micro-batch's journal goes to ``publish`` with the batch's number.

    ``publish`` must write under that number (a repeated batch overwrites
    itself), so that a lost executor or driver leads to no second effect.
    Without ``interval`` all that is there is processed once.
    """
    def once(batch: DataFrame, number: int) -> None:
        publish(pending(batch, "path", "seq", "seen_ms"), number)

    writer = stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
