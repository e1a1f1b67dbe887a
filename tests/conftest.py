import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[*]")
        .appName("pagesift-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def pages(spark):
    """Make a pages table of one or more (url, html)."""

    def make(*rows):
        numbered = [(n, url, html) for n, (url, html) in enumerate(rows)]
        return spark.createDataFrame(numbered, "page_id bigint, url string, html string")

    return make


@pytest.fixture
def values(spark):
    """Evaluate a column expression over a list of values."""

    def run(build, inputs, kind="string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(n, v) for n, v in enumerate(inputs)], f"n int, v {kind}")
        rows = df.select("n", build(F.col("v")).alias("out")).orderBy("n").collect()
        return [r["out"] for r in rows]

    return run
