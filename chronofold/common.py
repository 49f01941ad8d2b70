"""Helpers shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, as a lazy scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp that means UTC; the session must run in UTC (see ``use_utc``)."""
    return F.unix_micros(ts.cast("timestamp"))


def use_utc(spark: SparkSession) -> None:
    """Zone-free timestamps mean UTC, so casts between the two timestamp types must not shift them."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def counted(rows: DataFrame, row_id: str, *columns: Column) -> DataFrame:
    """Rows that count: of the rows of one ``event_id`` only the one with the earliest ``ingested_at`` (ties: the lowest
    ``row_id``; a null ``ingested_at`` comes last), picked over all rows, and of these the ones without an experiment.
    Rows without an id all count. ``columns`` are what is kept; prune early, for every row is shuffled once.

    Null ids are keyed by their own row id, so that they spread over all tasks; a hot id is thinned before the shuffle
    by the partial group limit that Spark derives from the rank filter.
    """
    picked = rows.select(
        F.col("event_id").alias("_id"),
        F.when(F.col("event_id").isNull(), F.col(row_id)).alias("_own"),
        F.col("ingested_at").alias("_in"),
        F.col(row_id).alias("_row"),
        F.col("experiment_id").isNotNull().alias("_exp"),
        *columns,
    )
    first = Window.partitionBy("_id", "_own").orderBy(F.col("_in").asc_nulls_last(), F.col("_row"))
    return (
        picked.withColumn("_rank", F.row_number().over(first))
        .filter((F.col("_rank") == 1) & ~F.col("_exp"))
        .drop("_id", "_own", "_in", "_exp", "_rank", "_row")
    )


def settled(df: DataFrame) -> DataFrame:
    """The rows, worked out now and written to the shared folder that the session names in ``spark.checkpoint.dir``, so that they are worked out once
    and lost executors don't matter. A local session without such a folder gets one; a cluster without one works the rows out anew at each use."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            return df
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="chronofold"))
    return df.checkpoint()
