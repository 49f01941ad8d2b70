"""One row per entity with count, recency and total for each of hundreds of event types.

Two stages: rows are pre-aggregated by entity, type and salt, so that a heavy pair spreads over several tasks, the partial
statistics are merged by entity and type, and each entity's statistics are expanded to the complete list of types.

Defined cases: rows without entity or type are left out; null amounts count as 0 in the total; rows without time count but
give no recency; types that an entity never had get count 0, total 0 and no recency; the number of types is not limited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8


def entity_type_stats(rows: DataFrame, salt: Column, salts: int = SALTS) -> DataFrame:
    """``entity, event_type`` string, ``us, cents`` bigint by event -> ``entity, event_type, n, last_us, cents``. ``salt`` is any well-spread value."""
    spread = rows.dropna(subset=["entity", "event_type"]).withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    partial = spread.groupBy("entity", "event_type", "_salt").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("last_us"), F.sum(F.coalesce("cents", F.lit(0))).alias("cents"))
    return partial.groupBy("entity", "event_type").agg(F.sum("n").alias("n"), F.max("last_us").alias("last_us"), F.sum("cents").alias("cents"))


def feature_table(stats: DataFrame, types: DataFrame) -> DataFrame:
    """``entity`` and ``features``, a map from every type of ``types`` to (n, cents, seconds_since_last). ``types``: ``event_type`` and ``us``, its latest
    time, a row per type; recency is measured from the latest of all. Both are read by a subquery, the list as long as every row of the result."""
    whole = types.agg(F.struct(F.array_sort(F.collect_set("event_type")).alias("names"), F.max("us").alias("as_of"))).scalar()
    since = ((F.col("as_of") - F.col("last_us")) / 1e6).alias("seconds_since_last")
    had = stats.withColumn("as_of", whole["as_of"]).groupBy("entity").agg(F.collect_list(F.struct("event_type", F.struct("n", "cents", since).alias("f"))).alias("had"))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("cents"), F.lit(None).cast("double").alias("seconds_since_last"))
    lacking = F.array_except("names", F.transform("had", lambda h: h["event_type"]))
    full = F.concat("had", F.transform(lacking, lambda t: F.struct(t.alias("event_type"), none.alias("f"))))
    return had.withColumn("names", whole["names"]).select("entity", F.map_from_entries(F.array_sort(full)).alias("features"))
