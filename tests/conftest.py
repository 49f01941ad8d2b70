import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(pathlib.Path(__file__).parents[1]), str(pathlib.Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s
