"""Edge rows shared by the operators' tests: nulls, empty and long texts, repeats, clashing columns."""

import pytest

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score DOUBLE, component_id STRING, labels INT"
LONG = "word " * 40_000 + "x" * 5_000
TEXTS = [(1, "The quick brown fox, jumps over!\nIt's lazy  dogs"), (2, None), (3, ""), (4, "   \n\t "), (5, LONG),
         (1, "The quick brown fox, jumps over!\nIt's lazy  dogs"), (None, "no id but text"), (7, "... 123 %%%"),
         (8, "Ünïcödé 漢字 😀 naïve space \x1c odd"), (9, "a"), (10, " lead and trail  ")]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, None, None, None, 0.5, "clash", 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain(spark):
    """A piece of the given documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
