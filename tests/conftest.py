from __future__ import annotations

import os
import pathlib
import sys
from collections.abc import Callable, Iterator

import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from cairnlog.functions.fields import is_log_frame  # noqa: E402
from cairnlog.session import configure, ship_package  # noqa: E402

JSON_LINES = [
    '{"timestamp":"2031-03-09T23:58:10","level":"WARN","message":"queue at 91%","shard":7}',
    '{"timestamp":"2031-03-09T23:59:40","level":"ERROR","message":"lost peer fe80::1","peer":{"up":false,"zone":"b"}}',
    '{"timestamp":"2031-03-10T00:00:02","level":"WARN","message":"queue at 40%","shard":7}',
    '{"timestamp":"2031-03-10T00:04:00","level":"DEBUG","message":"compacted","took":1.25}',
    '{"timestamp":"2031-03-10T00:05:31","level":"ERROR","message":"lost peer fe80::9","peer":null}',
]
ACCESS_LINES = [
    '2001:db8::7 - - [09/Mar/2031:23:58:11 +0100] "HEAD /health HTTP/2.0" 204 -',
    'cache-3.example - kim [09/Mar/2031:23:58:12 +0100] "DELETE /cart/17?x=1 HTTP/1.1" 503 88 "" "probe/2"',
]
SYSLOG_LINES = [
    "Mar  9 23:58:13 edge7 dhclient[4021]: bound to 10.9.8.7",
    "Mar 10 00:00:00 edge7 systemd: rotated",
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> Iterator[SparkSession]:
    os.environ.setdefault("PYTHONHASHSEED", "0")
    session = (
        configure(SparkSession.builder.master("local[4]").appName("tests"))
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def lines(spark: SparkSession) -> Callable[[list[str]], DataFrame]:
    """Lines in the given order, as one file."""
    from pyspark.sql import functions as F

    from cairnlog.sources.lines import lines_from

    def make(texts: list[str]) -> DataFrame:
        table = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
        return lines_from(table, F.col("t"), F.col("i"))

    return make


@pytest.fixture
def entries(spark: SparkSession) -> Callable[[list[dict]], DataFrame]:
    """A log frame of the given entries, in order."""

    def make(dicts: list[dict]) -> DataFrame:
        rows = [
            ("f", 0, i, "", "custom", {k: None if v is None else str(v) for k, v in d.items()})
            for i, d in enumerate(dicts)
        ]
        return spark.createDataFrame(
            rows,
            "file string, block_start long, seq long, raw string, format string, fields map<string,string>",
        )

    return make


def dicts(frame: DataFrame) -> list[dict]:
    """The entries of a log frame in order."""
    assert is_log_frame(frame)
    return [r.fields for r in frame.orderBy("file", "block_start", "seq").collect()]
