import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__  # noqa: E402, F401  (ships the Python helpers with the tasks)
from jobdelta.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("jobdelta-tests").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "8g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield prepare(s)
    s.stop()


@pytest.fixture
def rows(spark):
    def make(schema, data):
        return spark.createDataFrame(data, schema)

    return make
