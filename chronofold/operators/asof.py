"""Attributes as known at event time: for each observation and attribute the latest version that held and was known.

A version counts from the moment it both holds and is known, so a shard of an entity's time needs only the best version
that came into sight before it. Entities are sharded by time; each shard gets that carry-in per attribute, and the
shards run independent merges of versions and observations in time order, keeping a running best.

Defined cases: versions or observations without entity, time or known-time never match; a null attribute name is no
attribute; a null flag is false; equal event and known times go to the highest id; an observation without any version
gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_US = 14 * 86_400_000_000
#: A shard with more rows is split into parts of about so many. At most one shard of so many rows is, so the list of them fits every task.
SHARD_ROWS = 1_000_000
#: Numbers of the parts of a shard.
_PARTS = 1 << 20


def _sharded(rows: DataFrame, crowded: DataFrame, shard_us: int) -> DataFrame:
    """Adds ``shard``: the number of the time shard and, in crowded ones, of the part, in the order of time."""
    own = rows.withColumn("shard", F.floor(F.col("us") / F.lit(shard_us))).join(F.broadcast(crowded), ["entity", "shard"], "left")
    part = F.floor((F.col("us") - F.col("shard") * shard_us) * F.least("parts", F.lit(_PARTS)) / shard_us)
    return own.withColumn("shard", F.col("shard") * _PARTS + F.coalesce(F.least(part, F.lit(_PARTS - 1)), F.lit(0))).drop("parts")


def as_known(versions: DataFrame, observations: DataFrame, shard_us: int = SHARD_US, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``versions``: ``entity, attr`` string, ``held_us, known_us, id`` bigint, ``value``; ``observations``: ``obs_id, entity, us, inclusive``.
    Returns ``obs_id, attr, id, value``. The result does not depend on ``shard_us`` and ``shard_rows``."""
    v = versions.select("entity", "attr", "held_us", "known_us", "id", "value").dropna(subset=["entity", "attr", "held_us", "known_us", "id"])
    v = v.select(
        "entity", "attr", F.greatest("held_us", "known_us").alias("us"), F.struct(F.col("held_us"), F.col("known_us"), F.col("id"), F.col("value")).alias("best")
    )
    o = observations.select("obs_id", "entity", "us", F.coalesce("inclusive", F.lit(False)).alias("inclusive")).dropna()
    counts = v.select("entity", "us").unionByName(o.select("entity", "us")).groupBy("entity", F.floor(F.col("us") / F.lit(shard_us)).alias("shard")).count()
    crowded = counts.filter(F.col("count") > shard_rows).select("entity", "shard", F.ceil(F.col("count") / F.lit(shard_rows)).alias("parts"))
    v, o = _sharded(v, crowded, shard_us), _sharded(o, crowded, shard_us)
    # per entity and attribute: a shard's best version, and a mark for each shard that has observations
    own = v.groupBy("entity", "attr", "shard").agg(F.max("best").alias("best")).withColumn("asked", F.lit(False))
    asked = o.select("entity", "shard").distinct()
    marks = asked.join(own.select("entity", "attr").distinct(), "entity").select("entity", "attr", "shard", F.lit(None).cast(own.schema["best"].dataType).alias("best"), F.lit(True).alias("asked"))
    steps = own.unionByName(marks).groupBy("entity", "attr", "shard").agg(F.max("best").alias("best"), F.bool_or("asked").alias("asked"))
    before = Window.partitionBy("entity", "attr").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = steps.withColumn("best", F.max("best").over(before)).filter("asked").drop("asked")
    # local merges: carry-in first, then by time; at one time exclusive observations, versions, inclusive observations
    no = F.lit(None).cast("bigint")
    rows = (
        carry.select("entity", "attr", "shard", F.lit(-(2**63)).cast("bigint").alias("us"), F.lit(0).alias("turn"), no.alias("obs_id"), "best")
        .unionByName(v.select("entity", "attr", "shard", "us", F.lit(1).alias("turn"), no.alias("obs_id"), "best"))
        .unionByName(
            o.join(carry.select("entity", "attr", "shard"), ["entity", "shard"]).select(
                "entity", "attr", "shard", "us", F.when(F.col("inclusive"), 2).otherwise(0).alias("turn"), "obs_id", F.lit(None).cast(own.schema["best"].dataType).alias("best")
            )
        )
    )
    local = Window.partitionBy("entity", "attr", "shard").orderBy("us", "turn").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("best", F.max("best").over(local)).filter("obs_id is not null and best is not null").select("obs_id", "attr", "best.id", "best.value")
