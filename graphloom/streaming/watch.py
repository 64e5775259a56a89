"""Change events: bursts by a gap in time, and syncing when one ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

WATCHED = r"(?i)\.(md|canvas|rs)$"
SKIPPED = r"(^|/)(\.git|target|node_modules|\.brain)(/|$)"


def interesting(events: DataFrame, path: str = "path") -> DataFrame:
    return events.where(F.col(path).rlike(WATCHED) & ~F.col(path).rlike(SKIPPED))


def bursts(events: DataFrame, key: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, started, ended, n): events of a key that follow each other within the gap; for streams and tables.

    On a stream a burst is given out once the watermark, `late` behind the newest
    event, is past its end; state is a row an open burst.
    """
    kind = events.schema[ts].dataType
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events  # watermarks need an instant
    out = e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.min(ts).alias("started"), F.max(ts).alias("ended"))
    return out.select(key, F.col("started").cast(kind), F.col("ended").cast(kind), "n")


def bursts_by_lag(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """The same of a table by looking back a row."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    d = events.withColumn("_s", F.sum(F.when(gap >= seconds * 1_000_000, 1).otherwise(0)).over(w))
    return d.groupBy(key, "_s").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n")).drop("_s")


def watch(changes: DataFrame, sync: Callable[[DataFrame, int], None], checkpoint: str, every: str = "300 milliseconds", once: bool = False) -> StreamingQuery:
    """Calls sync with each quiet interval's interesting changes; a failure of sync leaves the stream going, and the next batch syncs again."""

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        try:
            sync(batch, number)
        except Exception as e:  # noqa: BLE001 - the watcher outlives a failed sync
            print(f"sync of batch {number} failed: {e}")

    w = interesting(changes).writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
