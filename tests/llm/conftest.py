from __future__ import annotations

import pathlib

import pytest
from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark: SparkSession) -> DataFrame:
    if not pathlib.Path(SF).exists():
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def odd(spark: SparkSession) -> DataFrame:
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    rows = [
        (1, "the same text, again and again", "x", 1, "a"),
        (2, "the same text, again and again", None, 2, None),
        (2, "the same text, again and again", None, 2, None),
        (None, "the same text, again and again", "y", None, "b"),
        (None, None, None, None, None),
        (4, None, "z", 4, "c"),
        (5, "", "z", 5, "d"),
        (6, " \n\t ", "z", 6, "e"),
        (7, "long words and letters; " * 9000, "w", 7, "f"),
        (8, "a" * 70_000, "w", 8, "g"),
        (9, "naïve 日本語 😀 <|endoftext|> +1 (415) 555-2671 bob@mail.example.com", "w", 9, "h"),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, fingerprint string, score long, sequence_id string"
    )


@pytest.fixture
def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, text string")
