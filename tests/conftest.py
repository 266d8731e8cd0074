import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("ledgerprep-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Table of text columns from a dict of lists."""

    def make(data, row_id=True):
        names = list(data)
        rows = [list(r) for r in zip(*data.values())]
        types = [f"`{n}` string" for n in names]
        if row_id:
            rows = [[i, *r] for i, r in enumerate(rows)]
            types = ["row_id long", *types]
        return spark.createDataFrame(rows, ", ".join(types))

    return make
