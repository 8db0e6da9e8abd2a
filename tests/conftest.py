import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__  # noqa: E402,F401


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def interactions_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "user_id string, item_id string, timestamp bigint")

    return make


@pytest.fixture
def factors_of(spark):
    def make(matrix):
        rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
        return spark.createDataFrame(rows, "idx bigint, vec array<double>")

    return make


def matrix_of(factors):
    import numpy as np

    return np.array([row["vec"] for row in factors.orderBy("idx").collect()])
