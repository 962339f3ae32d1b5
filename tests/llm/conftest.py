import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hostloom.session import ship_package  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, score double, rest string, label int, bucket string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def frame(spark):
    """(doc_id, text) rows as a table with further columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(d, t, "x", 0.5, "r", 1, "b") for d, t in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


ODD = [
    (None, "text without an id and some words to fill the line up to thirteen or more words"),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (6, "zero one two three four five six seven eight nine ten eleven twelve thirteen end"),
    (7, "ünïcode 漢字 😀 text with odd　spaces " * 9),
    (8, "same same same same " * 2000),
    (9, "A b C"),
    (10, "a B c"),
]


@pytest.fixture(scope="session")
def odd(frame):
    return frame(ODD)


@pytest.fixture(scope="session")
def odd_rows():
    return list(ODD)


@pytest.fixture(scope="session")
def empty(frame, spark):
    return spark.createDataFrame([], SCHEMA)
