"""Structured Streaming in front of a store: beyond what the batch engine's model asks for.

A stream of events is written to the store's Parquet files, partitioned by event type; queries over the files see what the
finished batches hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from chronofold.sources.store import COLUMNS, EventStore


#: Keeps the seen ids on disk rather than in memory.
_STATE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append_stream(events: DataFrame, path: str, checkpoint: str, *, trigger_once: bool = False) -> StreamingQuery:
    """Appends each event id once, its first delivery, however late. A repeat may come at any time, so there is no watermark: the state holds the id of
    every event, on disk, and grows with the store. Events without id pass unchecked. The file sink commits whole batches, so a restart
    repeats none."""
    shaped = EventStore._normal(events)
    known = shaped.filter("event_id is not null").dropDuplicates(["event_id"])
    rows = known.unionByName(shaped.filter("event_id is null")).select(*COLUMNS)
    writer = rows.writeStream.format("parquet").partitionBy("event_type").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    conf = events.sparkSession.conf
    before = conf.get(_STATE, None)
    conf.set(_STATE, _ROCKSDB)  # a query keeps the settings that it starts with
    try:
        return (writer.trigger(availableNow=True) if trigger_once else writer).start()
    finally:
        conf.unset(_STATE) if before is None else conf.set(_STATE, before)
