"""Every training query over tables that are empty, and over rows that are all null but for their ids."""

import pathlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SOURCE = pathlib.Path("/root/testdata/sf0.001")
TABLES = "app_event profile_change observation raw_event raw_observation attribute_value_type reading feed event_file session_rule documents".split()
IDS = {"row_id", "change_id", "obs_id", "raw_id", "req_id", "reading_id", "doc_id"}
NAMES = [n for n in entry.queries() if n[0] == "p" and n[1].isdigit()]
pytestmark = pytest.mark.skipif(not SOURCE.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("edges")
    for t in TABLES:
        df = spark.read.parquet(str(SOURCE / f"{t}.parquet"))
        df.limit(0).write.parquet(str(root / "empty" / f"{t}.parquet"))
        nulls = df.limit(20).select(*(F.col(c) if c in IDS else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns))
        nulls.unionByName(df.limit(40)).withColumns({c: F.lit("clash") for c in ("key", "digit", "n", "block", "us", "entity", "value", "size", "_id", "chunk", "text_")}).write.parquet(str(root / "null" / f"{t}.parquet"))
    return root


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("kind", ["empty", "null"])
def test_runs(spark, folders, name, kind):
    df = entry.queries()[name](spark, str(folders / kind))
    n = len(df.collect())
    assert n == 0 if kind == "empty" else n >= 0
    spark.catalog.clearCache()
