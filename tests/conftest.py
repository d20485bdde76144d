import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TOY_EDGES = [(1, 2), (1, 3), (2, 3), (2, 4), (2, 6), (3, 5), (3, 7), (4, 5), (5, 6)]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from sparkcover.session import ensure_checkpoint_dir

    s = (
        SparkSession.builder.master("local[*]")
        .appName("sparkcover-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture
def toy(spark):
    pairs = TOY_EDGES + [(b, a) for a, b in TOY_EDGES]
    return spark.createDataFrame(pairs, "src bigint, dst bigint")
