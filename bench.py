"""Benchmark of the headline operators; prints one JSON line.

Reads ``$BENCH_SF_DIR`` (default sf0.1) on ``local[$BENCH_CPUS]``.  Text input is
derived from the tables before the clock starts: NDJSON lines with the five keys
``timestamp, level, message, request_id, latency_ms`` from ``lineitem``, and
mixed-format lines from ``events``.
"""

from __future__ import annotations

import json
import os
import pathlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.operators import alerts, anomaly, counting, numeric, search
from cairnlog.operators.predicates import field_equals
from cairnlog.plans import event_logs as logs
from cairnlog.plans.catalog import QUERIES
from cairnlog.session import configure, ship_package, workspace
from cairnlog.sources import parse
from cairnlog.sources.lines import read_lines

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
REPEATS = 3

TABLE_QUERIES = (
    "regex_any_field", "regex_one_field", "time_range_orders", "substring_search", "top_n_ties",
    "group_buckets", "percentile_summary", "percentile_in_blocks", "anomaly_scores",
    "anomaly_scores_in_blocks", "anomaly_by_key", "alerts_fired", "html_rows", "stream_level_counts",
    "stream_anomaly", "stream_alerts",
)


def session() -> SparkSession:
    builder = (
        configure(SparkSession.builder.master(f"local[{CPUS}]").appName("bench"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ndjson_lines(spark: SparkSession) -> str:
    path = workspace(spark, "bench-ndjson")
    number = F.col("l_orderkey")
    levels = F.array(*[F.lit(x) for x in ("INFO", "WARN", "ERROR", "DEBUG")])
    line = F.format_string(
        '{"timestamp": "%s", "level": "%s", "message": "synthetic log entry %d", "request_id": "req-%08x", "latency_ms": %d}',
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"),
        levels[(number % 4).cast("int")],
        number,
        number,
        F.col("l_quantity").cast("long") + 10,
    )
    logs.table(spark, SF_DIR, "lineitem").repartition(int(CPUS)).select(line.alias("value")).write.text(path)
    return path


def mixed_lines(spark: SparkSession) -> str:
    path = workspace(spark, "bench-mixed")
    events = logs.events(spark, SF_DIR).repartition(int(CPUS))
    events.select(logs.mixed_line().alias("value")).write.text(path)
    return path


def seconds(run: Callable[[], DataFrame]) -> float:
    best = float("inf")
    for _ in range(REPEATS):
        begin = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - begin)
    return round(best, 3)


def main() -> None:
    spark = session()
    ndjson, mixed = ndjson_lines(spark), mixed_lines(spark)
    lines = read_lines(spark, ndjson).count()
    mixed_count = read_lines(spark, mixed).count()
    frame_path = workspace(spark, "bench-frame")
    parse.parse_json(read_lines(spark, ndjson)).write.parquet(frame_path)
    frame = spark.read.parquet(frame_path)
    errors = alerts.Rule("errors", field_equals("level", "ERROR"), cooldown=3600)

    text: dict[str, tuple[int, Callable[[], DataFrame]]] = {
        "parse_json": (lines, lambda: parse.parse_json(read_lines(spark, ndjson))),
        "parse_json_exact": (lines, lambda: parse.parse_json(read_lines(spark, ndjson), exact=True)),
        "parse_auto_line": (mixed_count, lambda: parse.parse_auto(read_lines(spark, mixed), mode="line")),
        "parse_auto_file": (lines, lambda: parse.parse_auto(read_lines(spark, ndjson), mode="file")),
        "text_to_top_levels": (lines, lambda: counting.top(parse.parse_json(read_lines(spark, ndjson)), "level")),
        "text_search": (lines, lambda: search.search(parse.parse_json(read_lines(spark, ndjson)), "entry 77", limit=100)),
        "frame_top_levels": (lines, lambda: counting.top(frame, "level")),
        "frame_summary": (lines, lambda: numeric.summary(frame, "latency_ms")),
        "frame_anomaly": (lines, lambda: anomaly.score_anomalies(frame, "latency_ms").select("seq", "z_score")),
        "frame_alerts": (lines, lambda: alerts.evaluate_rules(frame, [errors]).select("seq", "rule")),
    }
    timed = {name: seconds(run) for name, (_, run) in text.items()}
    rates = {name: round(count / timed[name]) for name, (count, _) in text.items()}
    timed |= {name: seconds(lambda name=name: QUERIES[name](spark, SF_DIR)) for name in TABLE_QUERIES}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "sf": pathlib.Path(SF_DIR).name.removeprefix("sf"),
                "lines_per_sec": rates,
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
