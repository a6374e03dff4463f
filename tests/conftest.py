import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from ratingloom.session import local_conf, session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", **{**local_conf(8, "8g"), "spark.sql.shuffle.partitions": "4"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


MATRIX = [
    [5, 5, 0, 5],
    [5, 0, 3, 4],
    [3, 4, 0, 3],
    [0, 0, 5, 3],
    [5, 4, 4, 5],
    [5, 4, 5, 5],
]

BASKETS = [[1, 2, 5], [2, 4], [2, 3], [1, 2, 4], [1, 3], [2, 3], [1, 3], [1, 2, 3, 5], [1, 2, 3]]


@pytest.fixture(scope="session")
def ratings(spark):
    rows = [(u, i, float(r)) for u, row in enumerate(MATRIX) for i, r in enumerate(row) if r]
    return spark.createDataFrame(rows, "user long, item long, rating double").cache()


@pytest.fixture(scope="session")
def unrated(spark):
    rows = [(u, i) for u, row in enumerate(MATRIX) for i, r in enumerate(row) if not r]
    return spark.createDataFrame(rows, "user long, item long").cache()


@pytest.fixture(scope="session")
def baskets(spark):
    rows = list(enumerate(BASKETS))
    return spark.createDataFrame(rows, "basket long, items array<int>").cache()
