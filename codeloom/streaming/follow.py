"""A stored index that follows a stream of file events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.sync import sync
from codeloom.sources.files import SUFFIXES
from codeloom.sources.store import Store


def settled(events: DataFrame, quiet: str = "500 milliseconds", late: str = "1 minute", suffixes: tuple[str, ...] = tuple(SUFFIXES)) -> DataFrame:
    """path, change, changed_at, n_events of files that were quiet for a while: one row for each run of events(event_id, path, change, ts), with its last change.

    At equal times `deleted` wins, then the greater id. Events of one id count once; paths of other suffixes, and events without a path or time, are left out.
    On a stream a run is emitted when the watermark has passed its end, so events may come in any order within `late`; on a table all runs are.
    """
    e = events.where(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1).isin(list(suffixes)) & F.col("ts").isNotNull())
    e = e.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else e.dropDuplicates(["event_id"])
    rank = F.struct("ts", F.coalesce(F.col("change") == "deleted", F.lit(False)), "event_id")
    g = e.groupBy(F.session_window("ts", quiet).alias("w"), "path").agg(F.max_by("change", rank).alias("change"), F.max("ts").alias("changed_at"), F.count("*").alias("n_events"))
    return g.select("path", "change", "changed_at", "n_events")


def follow(
    store: Store, events: DataFrame, read: Callable[[], DataFrame], checkpoint: str, name: str, names: list[str] = (), decorators: list[str] = (),
    quiet: str = "500 milliseconds", late: str = "1 minute", once: bool = False,
) -> StreamingQuery:
    """Brings the store up to date with read() and then with each batch of settled events of a stream.

    Events only say where to look: what a file holds, or that it is gone, is read from read(), so batches may be replayed, and each is applied
    once by the stream's `name` and its number. A new checkpoint needs a new name. A batch that fails ends the stream with the
    store as it was, and is tried again when the stream is started again.
    """
    sync(store, read(), names, decorators)

    def apply(batch: DataFrame, batch_id: int) -> None:
        sync(store, read(), names, decorators, batch.select("path"), f"{name}:{batch_id}")

    w = settled(events, quiet, late).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=quiet)).start()
