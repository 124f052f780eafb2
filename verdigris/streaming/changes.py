"""Change sets that arrive as a stream, each batch becoming a version of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators.store import Store


def version_of_batch(batch: int) -> str:
    return f"batch-{batch:09d}"


def follow_changes(changes: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply a stream of (uid, text, at) to ``store``; a null text deletes its uid, of one uid's rows the latest counts.

    A batch is one version named after its number, so a batch that is delivered again after a failure replaces
    itself.  ``trigger`` goes to the writer, such as ``availableNow=True``.
    """

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.where("uid IS NOT NULL").groupBy("uid").agg(F.max_by(F.struct("text"), "at").alias("r")).select("uid", "r.text")
        store.add_version(version_of_batch(number), last, source="stream", partial=True, replace=True)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def outcome_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, end, event_type, n, mean_value) of a stream of (ts, event_type, value) in tumbling windows.

    Rows later than ``late`` behind the newest one are dropped, and a window is final when that time has passed.
    """
    window = F.window("ts", every)
    counted = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return counted.select("w.start", "w.end", "event_type", "n", "mean_value")
