import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


# Column functions need a session when a test module is read.
SESSION = (
    SparkSession.builder.master("local[8]")
    .appName("tests")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.driver.memory", "8g")
    .getOrCreate()
)
SESSION.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture
def evaluate(spark):
    """Values of an expression over one column ``x``, in order."""

    def run(values, expression, kind="string"):
        rows = list(enumerate(values))
        df = spark.createDataFrame(rows, f"i int, x {kind}").coalesce(1)
        return [r.y for r in df.select("i", expression.alias("y")).orderBy("i").collect()]

    return run
