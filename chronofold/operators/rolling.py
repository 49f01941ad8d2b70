"""Rolling totals over trailing periods, kept as versioned daily state.

The state has a row per entity and day from its first to its last active day: the day's own count and amount, and the
totals of each trailing window. Today's totals are yesterday's plus today's arrivals minus what the expiring day brought,
which over a whole history is one running sum of arrivals less expiries. ``advance`` takes the next batch of arrivals and
corrections into a new version. It reads again only the days around the affected dates, from the longest window before the
first day of an entity's batch to the longest window after its last one; all other rows go on as they are. Only where a
batch takes something back or comes before the first day, which can change where an entity's days begin and end, all days of that entity
are made anew.

Defined cases: rows without entity or day are left out; a null amount counts as an event of amount 0; amounts are whole
numbers (cents), so that sums are exact in any order; an empty batch gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = (7, 30)


def daily(rows: DataFrame) -> DataFrame:
    """``entity, day`` date, ``cents`` bigint by event -> ``entity, day, n, cents``. The shuffle is by entity and day, so a hot entity
    spreads, and partial sums come first."""
    return rows.dropna(subset=["entity", "day"]).groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"))


def rolling_state(days: DataFrame, windows: tuple[int, ...] = WINDOWS, version: int = 0) -> DataFrame:
    """``entity, day, n, cents`` (a row per active day) -> the state: every day from the entity's first to its last with ``n_W``, ``cents_W`` of
    each window W, ``since_first`` in days, and ``version``."""
    by = Window.partitionBy("entity").orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(by), 1), F.col("day"))
    spine = (
        days.withColumn("_until", until)
        .withColumn("_day", F.explode(F.sequence("day", "_until")))
        .select("entity", F.col("_day").alias("day"), *(F.when(F.col("_day") == F.col("day"), F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("n", "cents")))
    )
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    totals = {f"{c}_{w}": F.sum(F.col(c) - F.col(f"_out_{c}_{w}")).over(so_far) for w in windows for c in ("n", "cents")}
    expiring = {f"_out_{c}_{w}": F.lag(c, w, 0).over(by) for w in windows for c in ("n", "cents")}
    first = F.min("day").over(Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return spine.withColumns(expiring).withColumns(totals | {"since_first": F.date_diff("day", first), "version": F.lit(version)}).drop(*expiring)


def advance(state: DataFrame, batch: DataFrame, version: int, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """The next version. ``batch``: ``entity, day, n, cents`` to add, negative for what is taken back, of any day. Rows whose totals stay as
    they were keep their version; days that only a withdrawn event held active go from the ends."""
    batch, reach = daily_sum(batch), max(windows) - 1
    columns = [c for c in state.columns if c != "version"]
    touched = batch.groupBy("entity").agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"), F.min(F.least("n", F.lit(0))).alias("_back"))
    ends = state.join(touched, "entity", "left_semi").groupBy("entity").agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    plan = touched.join(ends, "entity", "left").select(
        "entity",
        "_first",
        F.coalesce((F.col("_back") < 0) | (F.col("_lo") < F.col("_first")) | F.col("_first").isNull(), F.lit(True)).alias("_whole"),
        F.least("_lo", F.date_add("_last", 1)).alias("_from"),
        F.date_add("_hi", reach).alias("_to"),
    )
    old = state.join(plan, "entity", "left")
    again = F.col("_whole") | F.col("day").between(F.date_sub("_from", reach), F.col("_to"))
    remade = F.col("_whole") | F.col("day").between(F.col("_from"), F.col("_to"))
    kept = old.filter(~F.coalesce(remade, F.lit(False))).select(*columns, "version")
    before = old.filter(again).select("entity", "day", "n", "cents")
    days = daily_sum(before.unionByName(batch)).join(plan, "entity")
    # the ends of whole entities are their active days; inside, quiet days stay
    days = days.filter(~F.col("_whole") | (F.col("n") != 0) | (F.col("cents") != 0)).select("entity", "day", "n", "cents")
    fresh = rolling_state(days, windows, version).join(plan, "entity").filter(F.col("_whole") | (F.col("day") >= F.col("_from")))
    fresh = fresh.withColumn("since_first", F.when(F.col("_whole"), F.col("since_first")).otherwise(F.date_diff("day", "_first"))).select(*columns, "version")
    was = old.filter(remade).select("entity", "day", F.struct(*columns).alias("_old"), F.col("version").alias("_was"))
    same = F.col("_old").eqNullSafe(F.struct(*columns))
    fresh = fresh.join(was, ["entity", "day"], "left").select(*columns, F.when(same, F.col("_was")).otherwise(F.lit(version)).alias("version"))
    return kept.unionByName(fresh)


def daily_sum(days: DataFrame) -> DataFrame:
    return days.groupBy("entity", "day").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
