"""Queries of this package against their SQL and each other."""

import pathlib

import pytest
from compare import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry

SOURCE = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SOURCE.exists(), reason="no test tables")


def test_percentiles_equal_sql(spark):
    compare(spark, SOURCE, "p5_percentiles")


def test_merged_is_near_in_every_grouping(spark):
    compare(spark, SOURCE, "p5_error")


def test_merged_days_are_near_the_whole(spark):
    q = entry.queries()
    whole = q["p5_percentiles"](spark, str(SOURCE)).filter("grouping = 'event_type'").select("event_type", "permille", "n", F.col("value").alias("true"))
    both = q["p5_merged"](spark, str(SOURCE)).filter("grouping = 'event_type'").join(whole, ["event_type", "permille", "n"]).collect()
    assert len(both) == whole.count() and all(abs(r.value - r.true) <= abs(r.true) * 2.0**-12 for r in both)
