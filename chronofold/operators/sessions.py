"""Activity sessions by inactivity gaps, built in time chunks.

Each entity's events are cut into chunks of time; local sessions are built in each chunk, so that a hot entity spreads
over as many tasks as it has chunks. Only the first and the last local session of a chunk can go on in a neighbour, so
only these are brought together per entity, where adjacent ones whose gap is at most the threshold merge.

Defined cases: events without time or entity id give no session; an entity type without a rule gives none; equal times
stay in one session; a gap of exactly the threshold does not end a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def _split(df: DataFrame, keys: list[str], start: str, end: str, n: Column) -> DataFrame:
    """Rows joined to sessions within ``keys``: a row starts one if it begins later than the gap after the end before it."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    begins = (F.col(start) - F.lag(end).over(w) > F.col("gap_us")).cast("int")
    numbered = df.withColumn("_new", F.coalesce(begins, F.lit(1))).withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "gap_us", "_no").agg(F.min(start).alias("start_us"), F.max(end).alias("end_us"), F.sum(n).alias("n_events"))


def sessions(events: DataFrame, chunk_us: int = DAY_US) -> DataFrame:
    """``events``: ``entity_type, entity_id`` string, ``us`` bigint (time), ``gap_us`` bigint (inactivity that ends a session). Returns
    ``entity_type, entity_id, start_us, end_us, n_events``. The result does not depend on ``chunk_us``."""
    key = ["entity_type", "entity_id"]
    usable = events.select(*key, "us", "gap_us").dropna()
    chunked = usable.withColumn("chunk", F.floor(F.col("us") / F.lit(chunk_us)))
    local = _split(chunked, [*key, "chunk"], "us", "us", F.lit(1))
    w = Window.partitionBy(*key, "chunk")
    marked = local.withColumn("_edge", (F.col("_no") == 1) | (F.col("_no") == F.max("_no").over(w)))
    inner = marked.filter(~F.col("_edge")).select(*key, "start_us", "end_us", "n_events")
    edges = marked.filter("_edge").select(*key, "gap_us", F.col("start_us").alias("s"), F.col("end_us").alias("e"), F.col("n_events").alias("n"))
    merged = _split(edges, key, "s", "e", F.col("n")).select(*key, "start_us", "end_us", "n_events")
    return inner.unionByName(merged)
